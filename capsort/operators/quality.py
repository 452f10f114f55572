"""Quality stage: shape and exposure rules, blur threshold with its safety valve, near-duplicate runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsort.config import QualitySettings
from capsort.functions import columns as C
from capsort.operators.stats import otsu
from capsort.sources.photos import dense_index

#: Reasons in order, with their display names.
REASONS = {"blur": "blurred", "overexposed": "overexposed", "underexposed": "underexposed", "tooSmall": "too small", "panorama": "panorama", "duplicate": "near duplicate", "unreadable": "unreadable"}


def shape_reason(s: QualitySettings) -> Column:
    """The first rule that excludes a photo, or null."""
    w, h = F.col("pixel_width"), F.col("pixel_height")
    return (
        F.when((w > 0) & (h > 0) & (F.greatest(w, h) < s.minimum_long_side), "tooSmall")
        .when(C.aspect(w, h) > s.maximum_aspect_ratio, "panorama")
        .when(F.col("highlights") > s.maximum_clipping, "overexposed")
        .when(F.col("shadows") > s.maximum_clipping, "underexposed")
    )


def shape_filter(photos: DataFrame, s: QualitySettings) -> DataFrame:
    """``photos`` with columns reason and score (null: kept)."""
    w, h = F.col("pixel_width"), F.col("pixel_height")
    by = {"tooSmall": F.greatest(w, h).cast("double"), "panorama": C.aspect(w, h), "overexposed": F.col("highlights"), "underexposed": F.col("shadows")}
    score = F.lit(None).cast("double")
    for reason, value in by.items():
        score = F.when(F.col("reason") == reason, value).otherwise(score)
    return photos.withColumn("reason", shape_reason(s)).withColumn("score", score)


def blur_threshold(survivors: DataFrame, s: QualitySettings) -> tuple[float | None, float | None, bool]:
    """(threshold, median, suppressed) from the sharpness of what passed shape and exposure.

    Three scalars reach the driver. The valve: an automatic threshold that would drop too large a part is not used.
    """
    n, median, rows = survivors.agg(F.count("sharpness"), F.median("sharpness"), F.count(F.lit(1))).first()
    if s.minimum_sharpness is not None:
        return s.minimum_sharpness, median, False
    if n < 8 or not median or median <= 0:
        return None, median, False
    found = otsu(survivors, "sharpness").first()
    clear = found is not None and found.separability >= 0.55 and found.lower_fraction <= 0.35
    threshold = min(found.threshold, 0.6 * median) if clear else 0.2 * median
    dropped = survivors.filter(F.col("sharpness") < threshold).count()
    suppressed = dropped > s.maximum_blur_fraction * rows
    return (None if suppressed else threshold), median, suppressed


def running_sum(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the sum of ``column`` up to each dense idx: within blocks of idx, plus the sums of earlier blocks."""
    block = F.shiftright("idx", 16)
    sums = df.groupBy(block.alias("__b")).agg(F.sum(column).alias("__s"))
    offsets = sums.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum(column).over(Window.partitionBy("__block").orderBy("idx"))
    joined = df.withColumn("__block", block).withColumn("__own", own).join(offsets, F.col("__block") == F.col("__b"))
    return joined.withColumn(name, F.col("__own") + F.col("__before")).drop("__b", "__before", "__block", "__own")


def run_heads(photos: DataFrame, distance: int, hash_col: str = "near_hash") -> DataFrame:
    """(idx, run): runs of photos within ``distance`` bits of the run's FIRST photo, in capture order.

    A photo without a hash always breaks the run, so stretches between such photos are folded apart; within a stretch the
    fold is sequential, with one hash of state. Photos further apart than one step of ``distance`` also break it:
    a run's head differs from each member by at most ``distance``, so two neighbours that differ by more than twice
    that can't share one. Those safe cuts make the stretches short on real data.
    """
    previous = photos.select((F.col("idx") + 1).alias("idx"), F.col(hash_col).alias("before"))
    h = F.col("h")
    breaks = h.isNull() | F.col("before").isNull() | (C.hamming(h, F.col("before")) > 2 * distance)
    marked = photos.select("idx", F.col(hash_col).alias("h")).join(previous, "idx", "left").select("idx", "h", F.when(breaks, 1).otherwise(0).alias("cut"))
    cut = running_sum(marked, "cut", "stretch")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = head = run = None
        for batch in batches:
            out = []
            for idx, value, stretch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stretch != at or head is None or value is None or ((value ^ head) & (1 << 64) - 1).bit_count() > distance:
                    at, head, run = stretch, value, idx
                out.append(run)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["idx", "run"])

    # Tasks get whole stretches in order: one pass over many stretches, not a call for each.
    return cut.select(F.col("idx").cast("long"), "h", "stretch").repartition("stretch").sortWithinPartitions("stretch", "idx").mapInArrow(fold, "idx long, run long")


def duplicate_losers(photos: DataFrame, distance: int, hash_col: str = "near_hash") -> DataFrame:
    """(idx, run, keeper, score): photos that lose to the sharpest of their run (first of equals), with their distance to it."""
    rows = photos.select("idx", F.coalesce("sharpness", F.lit(0.0)).alias("sharp"), F.col(hash_col).alias("h"))
    # Photos dropped before leave gaps in idx; those on both sides of a gap are neighbours.
    rows = dense_index(rows, F.shiftright("idx", 16), F.col("idx"), name="place")
    heads = run_heads(rows.select(F.col("place").alias("idx"), "h"), distance, "h").withColumnRenamed("idx", "place_")
    runs = rows.join(heads, F.col("place") == F.col("place_")).withColumn("run", F.min("idx").over(Window.partitionBy("run")))
    best = Window.partitionBy("run").orderBy(F.desc("sharp"), "idx")
    named = runs.withColumn("keeper", F.first("idx").over(best)).withColumn("keeper_h", F.first("h").over(best))
    return named.filter("idx <> keeper").select("idx", "run", "keeper", C.hamming_or_zero(F.col("h"), F.col("keeper_h")).alias("score"))


def quality_outcome(photos: DataFrame, s: QualitySettings, hash_col: str = "near_hash") -> DataFrame:
    """``photos`` with reason and score after all stages; null reason: kept."""
    shaped = shape_filter(photos, s)
    survivors = shaped.filter("reason IS NULL")
    threshold, _, _ = blur_threshold(survivors, s)
    if threshold is not None:
        blurred = F.coalesce(F.col("sharpness") < threshold, F.lit(False)) & F.col("reason").isNull()
        shaped = shaped.withColumn("score", F.when(blurred, F.col("sharpness")).otherwise(F.col("score"))).withColumn("reason", F.when(blurred, "blur").otherwise(F.col("reason")))
    losers = duplicate_losers(shaped.filter("reason IS NULL"), s.duplicate_distance, hash_col).select(F.col("idx").alias("lost"), F.col("score").alias("bits"))
    joined = shaped.join(losers, shaped.idx == losers.lost, "left")
    return joined.withColumn("reason", F.when(F.col("lost").isNotNull(), "duplicate").otherwise(F.col("reason"))).withColumn("score", F.coalesce("bits", "score")).drop("lost", "bits")
