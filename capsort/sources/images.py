"""Image folders: scan rules over a file listing, and EXIF fields from TIFF directories."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsort.functions import columns as C
from capsort.functions.texts import is_cloud_path
from capsort.sources.photos import IMAGE_EXTENSIONS

RESERVED = r"(^|/)(group-[^/]*|_excluded|_unassigned)/"


def is_image(path: Column) -> Column:
    return C.extension(path).isin(*IMAGE_EXTENSIONS)


def visible(path: Column) -> Column:
    return ~path.rlike(r"(^|/)\.")


def scan(spark: SparkSession, folder: str, recursive: bool = True, output: str | None = None) -> DataFrame:
    """path, relative_path, source_folder, length, modificationTime of the images to sort, without their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    return select_images(files.withColumn("plain", F.regexp_replace("path", "^file:", "")), folder.rstrip("/"), output)


def select_images(files: DataFrame, folder: str, output: str | None = None) -> DataFrame:
    """The scan rules on any listing with columns path and plain."""
    relative = F.substring(F.col("plain"), len(folder) + 2, 1 << 30)
    rows = files.filter(F.col("plain").startswith(folder + "/")).withColumn("relative_path", relative)
    rows = rows.filter(is_image(F.col("relative_path")) & visible(F.col("relative_path")) & ~F.col("relative_path").rlike(RESERVED))
    if output:
        rows = rows.filter(~F.col("plain").startswith(output.rstrip("/") + "/"))
    return rows.withColumn("source_folder", C.parent_folder(F.col("relative_path"))).drop("plain")


def folder_summary(files: DataFrame, *keys: str) -> DataFrame:
    """images, placeholders and whether any path is in a cloud folder, of all files or by ``keys``."""
    stub = C.extension(F.col("path")) == "icloud"
    cloud = is_cloud_path(F.col("path"))
    return files.groupBy(*keys).agg(F.count_if(is_image(F.col("path"))).alias("images"), F.count_if(stub).alias("placeholders"), F.coalesce(F.bool_or(cloud), F.lit(False)).alias("cloud"))


def stale(files: DataFrame, now: Column, age_hours: int = 24) -> DataFrame:
    """Leftovers older than the age, strictly."""
    return files.filter(F.col("modificationTime") < now - F.expr(f"INTERVAL {age_hours} HOURS"))


SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif(data: bytes) -> dict[int, object]:
    """Tags of a JPEG's EXIF block (main, EXIF and GPS directories); empty if there is none."""
    at = data.find(b"Exif\x00\x00")
    if at < 0:
        return {}
    tiff = data[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return {}
    out: dict[int, object] = {}
    todo = [struct.unpack_from(order + "I", tiff, 4)[0]]
    while todo:
        start = todo.pop()
        if start + 2 > len(tiff):
            continue
        for k in range(struct.unpack_from(order + "H", tiff, start)[0]):
            entry = start + 2 + 12 * k
            if entry + 12 > len(tiff):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
            size = SIZES.get(kind, 1) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
            raw = tiff[place : place + size]
            if len(raw) < size:
                continue
            if tag in (0x8769, 0x8825):
                todo.append(struct.unpack(order + "I", raw[:4])[0])
            elif kind == 2:
                out[tag] = raw.split(b"\x00")[0].decode("ascii", "replace")
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
                out[tag] = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            elif kind in (3, 4, 9):
                out[tag] = list(struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * count, raw))
            else:
                out[tag] = raw
    return out
