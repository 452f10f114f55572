"""From a folder of image files to photo rows: what can't be read is kept apart, not lost."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsort.functions import columns as C
from capsort.operators import raster
from capsort.sources import images
from capsort.sources.photos import capture_order

#: Bytes of a file's head in which its tags are looked for.
HEAD = 1 << 18
#: Longest side of the gray image that statistics are taken of.
GRAY = 256
#: First bytes of image files; HEIC and HEIF have ``ftyp`` from byte 4.
MAGIC = (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"II*\x00", b"MM\x00*", b"BM")
#: Tags by name (main, EXIF and GPS directories), and the kind of their value.
TAGS = {
    "date": (0x9003, "text"), "offset": (0x9011, "text"), "fraction": (0x9291, "text"), "model": (0x0110, "text"), "orientation": (0x0112, "number"), "width": (0xA002, "number"), "height": (0xA003, "number"),
    "focal": (0xA405, "number"), "aperture": (0x829D, "number"), "seconds": (0x829A, "number"), "iso": (0x8827, "number"), "brightness": (0x9203, "number"),
    "lat_ref": (1, "text"), "lat": (2, "degrees"), "lon_ref": (3, "text"), "lon": (4, "degrees"), "alt_ref": (5, "byte"), "alt": (6, "number"), "fix_clock": (7, "clock"), "fix_date": (0x1D, "text"),
    "direction": (0x11, "number"), "accuracy": (0x1F, "number"),
}
TEXTS = {k for k, (_, kind) in TAGS.items() if kind in ("text", "clock")}
SCHEMA = "path string, known boolean, " + ", ".join(f"{k} {'string' if k in TEXTS else 'double'}" for k in TAGS)


def _value(raw: object, kind: str) -> object:
    """One tag's value, or None if it is not of the kind."""
    if raw is None:
        return None
    if kind == "text":
        return raw.strip() if isinstance(raw, str) else None
    if kind == "byte":
        return float(raw[0]) if len(raw) else None
    if not isinstance(raw, list) or any(x is None for x in raw):
        return None
    if kind == "number":
        return float(raw[0]) if raw else None
    if len(raw) != 3:
        return None
    if kind == "degrees":
        return raw[0] + raw[1] / 60 + raw[2] / 3600
    return f"{int(raw[0]):02d}:{int(raw[1]):02d}:{raw[2]:06.3f}"


def fields(head: bytes) -> dict[str, object]:
    """known (it looks like an image) and the tags' values of a file's first bytes; damaged tags are none."""
    known = head.startswith(MAGIC) or head[4:8] == b"ftyp"
    tags: dict[int, object] = {}
    if known:
        try:
            tags = images.exif(b"Exif\x00\x00" + head if head.startswith(MAGIC[2:4]) else head)
        except Exception:  # noqa: BLE001  a damaged directory: the file still is a photo
            tags = {}
    return {"known": known} | {k: _value(tags.get(tag), kind) for k, (tag, kind) in TAGS.items()}


def read_tags(files: DataFrame) -> DataFrame:
    """path, known and the tags of each of ``files`` (path, content); only heads of files go to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p.as_py()} | fields(b.as_py() or b"") for p, b in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("known", pa.bool_())] + [(k, pa.string() if k in TEXTS else pa.float64()) for k in TAGS]))

    return files.select("path", F.substring("content", 1, HEAD).alias("head")).mapInArrow(run, SCHEMA)


def gray_image(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Gray values, the longest side at most GRAY pixels, of rows of blue, green, red (and alpha) or gray bytes."""
    pixels = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels)
    plain = pixels[:, :, 0] if channels < 3 else ((pixels[:, :, :3].astype(np.uint32) @ np.array([114, 587, 299], np.uint32) + 500) // 1000).astype(np.uint8)
    scale = max(1.0, max(height, width) / GRAY)
    return raster.box_downsample(plain, max(1, round(width / scale)), max(1, round(height / scale)))


def read_pixels(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """pixel_path, shape and statistics of the images that the JVM can decode; the others have no row."""
    decoded = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", str(recursive).lower()).load(folder).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, h, w, c, data in zip(*batch.columns, strict=True):
                gray = gray_image(data.as_buffer(), h.as_py(), w.as_py(), c.as_py())
                _, high, low = raster.luminance(gray)
                rows.append({"pixel_path": path.as_py(), "image_width": w.as_py(), "image_height": h.as_py(), "sharpness": raster.laplacian_variance(gray), "highlights": high, "shadows": low, "fingerprint": raster.difference_hash(gray)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("pixel_path", pa.string()), ("image_width", pa.int32()), ("image_height", pa.int32()), ("sharpness", pa.float64()), ("highlights", pa.float64()), ("shadows", pa.float64()), ("fingerprint", pa.int64())]))

    return decoded.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "pixel_path string, image_width int, image_height int, sharpness double, highlights double, shadows double, fingerprint long")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def read_photos(spark: SparkSession, folder: str, recursive: bool = True, output: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Photo rows in capture order, and the relative paths of files that no reader knows (empty or not an image).

    Tags come from the files' heads, pixels from the JVM's decoder; a photo whose pixels can't be decoded (HEIC, DNG, damaged
    ones) has no statistics and no hash, and its size is that of its tags. A fix is dated only if the capture time has
    a zone. Without one the capture time is taken as UTC.
    """
    folder = folder.rstrip("/")
    wanted = images.scan(spark, folder, recursive, output).select("path", "relative_path", "source_folder")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    tags = read_tags(files.join(F.broadcast(wanted.select("path")) if wanted.isEmpty() else wanted.select("path"), "path", "left_semi"))
    pixels = read_pixels(spark, folder, recursive).withColumn("plain_", _plain(F.col("pixel_path"))).drop("pixel_path")
    rows = wanted.join(tags, "path").withColumn("plain", _plain(F.col("path")))
    full = rows.join(pixels, F.col("plain") == F.col("plain_"), "left")
    c = F.col
    dated = C.capture_time(c("date"), c("offset"), c("fraction"))
    located = c("lat").isNotNull() & c("lon").isNotNull()
    here = lambda x: F.when(located, x)
    turned = c("orientation").between(5, 8)
    size = lambda own, other, tag: F.coalesce(F.when(turned, c(other)).otherwise(c(own)), c(tag).cast("int"), F.lit(0))
    fix = F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", F.replace(c("fix_date"), F.lit("-"), F.lit(":")), F.substring_index("fix_clock", ".", 1)), F.lit("yyyy:MM:dd HH:mm:ss"))) / 1e6
    photos = full.filter("known").select(
        "relative_path", "source_folder", dated.alias("t"), c("direction").alias("heading"), C.exposure_value(c("aperture"), c("seconds"), c("iso"), c("brightness")).alias("exposure_value"), "sharpness", "fingerprint",
        c("fingerprint").alias("near_hash"), size("image_width", "image_height", "width").alias("pixel_width"), size("image_height", "image_width", "height").alias("pixel_height"), "highlights", "shadows",
        here(C.signed_coordinate(c("lat"), c("lat_ref"))).alias("latitude"), here(C.signed_coordinate(c("lon"), c("lon_ref"))).alias("longitude"), here(F.when(c("alt_ref") == 1, -c("alt")).otherwise(c("alt"))).alias("altitude"),
        here(c("accuracy")).alias("accuracy"), here(F.when(c("offset").isNotNull() & c("fix_date").isNotNull() & c("fix_clock").isNotNull(), fix)).alias("fix_t"), c("focal").alias("focal_length"), c("model").alias("camera_model"),
        C.sequence_number(c("relative_path")).alias("sequence_number"))
    # File sources leave empty files out of their rows, but not out of their listing.
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string").withColumn("plain", _plain(F.col("path")))
    empty = images.select_images(listed, folder, output).select("relative_path").join(wanted.select("relative_path"), "relative_path", "left_anti")
    return capture_order(photos), full.filter("NOT known").select("relative_path").unionAll(empty).orderBy("relative_path")
