"""Files on the driver's side: placing sorted photos, and local copies of an input folder."""

from __future__ import annotations

import contextlib
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from capsort.functions.texts import CLOUD
from capsort.sources.photos import IMAGE_EXTENSIONS

STALE_SECONDS = 24 * 3600.0


@dataclass(frozen=True)
class Staged:
    folder: Path
    files: int
    size: int


def place_file(source: str, target: str, link: str = "hardlink") -> None:
    """Put one file at ``target``, replacing what is there. A hard link that can't be made becomes a copy."""
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    if os.path.lexists(target):
        os.remove(target)
    if link == "symlink":
        os.symlink(source, target)
        return
    if link == "hardlink":
        with contextlib.suppress(OSError):
            os.link(source, target)
            return
    shutil.copy2(source, target)


def place_all(placements: DataFrame, source: str, target: str, link: str = "hardlink") -> None:
    """Carry out rows of (bucket, relative_path, file_name) where the executors see both folders; rerun tasks replace."""

    def run(rows) -> None:
        for r in rows:
            found = os.path.join(source, r.relative_path)
            if os.path.exists(found):
                place_file(found, os.path.join(target, r.bucket, r.file_name), link)

    placements.foreachPartition(run)


def needs_staging(folder: str) -> bool:
    """A folder of cloud storage is always copied first."""
    return any(part in f"{os.path.abspath(folder)}/" for part in CLOUD)


def image_names(folder: str) -> list[str]:
    """Names of the images directly in the folder, sorted, hidden ones left out."""
    return sorted(n for n in os.listdir(folder) if not n.startswith(".") and n.rpartition(".")[2].lower() in IMAGE_EXTENSIONS)


def staged_name(folder: str, unique: str) -> str:
    base = os.path.basename(os.path.abspath(folder)).replace(":", "_") or "input"
    return f"{base[:64]}-{unique}"


def purge_stale(root: str, now: float | None = None, age: float = STALE_SECONDS) -> int:
    """Remove entries older than ``age`` seconds; how many went. Hidden ones and those that can't go stay."""
    if not os.path.isdir(root):
        return 0
    now, removed = time.time() if now is None else now, 0
    for entry in [e for e in Path(root).iterdir() if not e.name.startswith(".")]:
        with contextlib.suppress(OSError):
            if now - entry.stat().st_mtime > age:
                shutil.rmtree(entry) if entry.is_dir() else entry.unlink()
                removed += 1
    return removed


def stage(folder: str, root: str, cancelled: Callable[[], bool] = lambda: False) -> Staged | None:
    """Copy the folder's images under ``root``; null if there are none. A stop or an error leaves no copy behind."""
    purge_stale(root)
    names = image_names(folder) if os.path.isdir(folder) else []
    if not names:
        return None
    target, size = Path(root) / staged_name(folder, uuid.uuid4().hex), 0
    target.mkdir(parents=True)
    try:
        for name in names:
            if cancelled():
                raise InterruptedError("staging was cancelled")
            size += os.path.getsize(shutil.copy2(os.path.join(folder, name), target / name))
    except BaseException:
        shutil.rmtree(target, ignore_errors=True)
        raise
    return Staged(target, len(names), size)


@contextlib.contextmanager
def staged_input(folder: str, root: str, wanted: bool = False, cancelled: Callable[[], bool] = lambda: False) -> Iterator[str]:
    """The folder to read: a copy if asked for or needed, which always goes at the end."""
    copy = stage(folder, root, cancelled) if wanted or needs_staging(folder) else None
    try:
        yield str(copy.folder) if copy else folder
    finally:
        if copy:
            shutil.rmtree(copy.folder, ignore_errors=True)
