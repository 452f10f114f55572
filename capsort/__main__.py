"""``python -m capsort sort INPUT OUTPUT [options]``: exit code 0 when done, 1 on failure, 2 on a command that can't be read."""

from __future__ import annotations

import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from capsort.command import Command, CommandError, from_arguments, from_url
from capsort.plans import sorting
from capsort.sources.reader import read_photos
from capsort.sources.staging import place_all

USAGE = "usage: python -m capsort sort INPUT OUTPUT [--overlap N] [--max-per-group N] [--min-per-group N] [--time-gap S] [--group-threshold X] [--min-sharpness X] [--duplicate-distance N] [--link hardlink|copy|symlink] [--no-recursive] [--dry-run]"
MANIFEST = "manifest.json"


def sort(spark: SparkSession, command: Command, say=print) -> int:
    """Read, sort, place and write the manifest; the number of files placed (planned, in a dry run)."""
    request = command.request.validate()
    if not os.path.isdir(command.input):
        raise ValueError(f"not a folder: {command.input}")
    photos, unreadable = read_photos(spark, command.input, request.recursive, command.output)
    say("progress=0.600")
    if photos.isEmpty():
        raise ValueError(f"no image in {command.input}")
    done = sorting.sort_photos(photos, request, unreadable=unreadable)
    say("progress=0.800")
    for severity, code, message in sorting.diagnose(done, request):
        say(f"note={severity} {code}: {message}")
    if not request.dry_run:
        os.makedirs(command.output, exist_ok=True)
        place_all(sorting.placements(done), command.input, command.output, request.link)
        with open(os.path.join(command.output, MANIFEST), "w", encoding="utf-8") as f:
            f.write(sorting.manifest(done, request, command.input, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")))
    say("progress=1.000")
    return sorting.placement_total(done)


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    if not arguments or {"-h", "--help"} & set(arguments):
        print(USAGE)
        return 0 if arguments else 2
    try:
        command = from_url(arguments[0]) if "://" in arguments[0] else from_arguments(arguments)
    except CommandError as wrong:
        print(wrong, file=sys.stderr)
        return 2
    try:
        n = sort(spark or SparkSession.builder.appName("capsort").config("spark.sql.session.timeZone", "UTC").getOrCreate(), command)
        print(f"note={json.dumps({'placed': n})}")
        print("ok")
        return 0
    except KeyboardInterrupt:
        print("cancelled")
        return 0
    except Exception as wrong:  # noqa: BLE001
        print(f"{type(wrong).__name__}: {wrong}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
