"""Commands as URLs and as arguments: ``sort`` with its options. Names and types are one table for both forms."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields
from urllib.parse import parse_qsl, urlsplit

from capsort.config import LINKS, SortRequest

SCHEME = "capsort"


class CommandError(ValueError):
    pass


@dataclass(frozen=True)
class Command:
    input: str
    output: str
    request: SortRequest


def whole(raw: str) -> int:
    if not re.fullmatch(r"[+-]?[0-9]+", raw):
        raise ValueError(raw)
    return int(raw)


def finite(raw: str) -> float:
    if raw.strip() != raw or "_" in raw or not math.isfinite(float(raw)):
        raise ValueError(raw)
    return float(raw)


def truth(raw: str) -> bool:
    return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[raw.lower()]


def link(raw: str) -> str:
    return LINKS[LINKS.index(raw)]


#: Field -> (URL name, option, reader). Options of truth values are flags that state the second value.
OPTIONS = {
    "overlap": ("overlap", "--overlap", whole), "max_per_group": ("maxPerGroup", "--max-per-group", whole), "min_per_group": ("minPerGroup", "--min-per-group", whole),
    "time_gap": ("timeGap", "--time-gap", finite), "group_threshold": ("groupThreshold", "--group-threshold", finite), "minimum_sharpness": ("minSharpness", "--min-sharpness", finite),
    "duplicate_distance": ("duplicateDistance", "--duplicate-distance", whole), "link": ("link", "--link", link),
}
FLAGS = {"recursive": ("recursive", "--no-recursive", False), "dry_run": ("dryRun", "--dry-run", True)}


def _value(name: str, raw: str, reader):
    try:
        return reader(raw)
    except (ValueError, KeyError):
        raise CommandError(f"{name}: {raw!r} is not a valid value") from None


def from_url(url: str, scheme: str = SCHEME) -> Command:
    """``scheme://sort?input=..&output=..``: of a repeated name the last value counts; unknown names are ignored."""
    parts = urlsplit(url)
    if parts.scheme != scheme or parts.netloc != "sort":
        raise CommandError(f"unsupported command: {url}")
    given = dict(parse_qsl(parts.query.replace("+", "%2B"), keep_blank_values=True))
    for name in ("input", "output"):
        if not given.get(name):
            raise CommandError(f"missing parameter: {name}")
    readers = {k: (name, reader) for k, (name, _, reader) in OPTIONS.items()} | {k: (name, truth) for k, (name, _, _) in FLAGS.items()}
    return Command(given["input"], given["output"], SortRequest(**{k: _value(name, given[name], reader) for k, (name, reader) in readers.items() if name in given}))


def from_arguments(arguments: list[str]) -> Command:
    if arguments[:1] != ["sort"]:
        raise CommandError(f"unsupported command: {' '.join(arguments[:1])}")
    valued, flags = {option: (k, reader) for k, (_, option, reader) in OPTIONS.items()}, {option: (k, value) for k, (_, option, value) in FLAGS.items()}
    places, found, rest = [], {}, iter(arguments[1:])
    for word in rest:
        if word in valued:
            raw = next(rest, None)
            if raw is None:
                raise CommandError(f"missing parameter: {word}")
            found[valued[word][0]] = _value(word, raw, valued[word][1])
        elif word in flags:
            found[flags[word][0]] = flags[word][1]
        elif word.startswith("-"):
            raise CommandError(f"unknown option: {word}")
        else:
            places.append(word)
    if len(places) != 2:
        raise CommandError("sort needs an input and an output folder")
    return Command(*places, SortRequest(**found))


def to_arguments(command: Command) -> list[str]:
    """The arguments that give the command again; automatic thresholds are left out, the time gap is in whole seconds."""
    out = ["sort", command.input, command.output]
    for f in fields(SortRequest):
        value = getattr(command.request, f.name)
        if f.name in FLAGS:
            out += [FLAGS[f.name][1]] if value == FLAGS[f.name][2] else []
        elif value is not None:
            out += [OPTIONS[f.name][1], str(math.floor(value + 0.5) if f.name == "time_gap" else value)]
    return out
