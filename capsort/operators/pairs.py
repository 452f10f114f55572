"""Candidate pairs and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsort.config import GroupingSettings
from capsort.functions import columns as C
from capsort.operators.graph import checkpointed

#: Hashes in one broadcast block of the neighbour search.
BLOCK = 1_000_000
#: Hashes of a chunk, queries searched at once, and rows of a task of the neighbour search.
CHUNK, QUERIES, ROWS = 8192, 64, 4096


def band_pairs(photos: DataFrame, width: int) -> DataFrame:
    """All (i, j) with 1 <= j - i <= width: each i names its partners, then an equi-join; never a range join."""
    near = photos.select(F.col("idx").alias("i"), F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + width)).alias("j"))
    return near.join(photos.select(F.col("idx").alias("j")), "j").select("i", "j")


def _nearest_of(queries: np.ndarray, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the k hashes of ``table`` nearest to each of ``queries``, ties to the smaller place.

    The table is met in chunks of rising places, so once k are known only what is strictly nearer than the last of them counts.
    """
    none = np.int64(1) << 60
    best = np.full((len(queries), k), none)
    rows = np.repeat(np.arange(len(queries)), k)
    for at in range(0, len(table), CHUNK):
        part = table[at : at + CHUNK]
        d = np.bitwise_count(queries[:, None] ^ part[None])
        if at == 0:
            key = d.astype(np.int64) << 40 | np.arange(len(part))[None]
            some = min(k, len(part))
            best[:, :some] = np.sort(np.partition(key, some - 1, axis=1)[:, :some], axis=1)
            continue
        r, c = np.nonzero(d < np.minimum(best[:, -1] >> 40, 255).astype(np.uint8)[:, None])
        if len(r):
            which, key = np.concatenate([rows, r]), np.concatenate([best.ravel(), d[r, c].astype(np.int64) << 40 | (c + at)])
            order = np.lexsort((key, which))
            first = np.searchsorted(which[order], np.arange(len(queries)))
            best = key[order][first[:, None] + np.arange(k)[None]]
    return best & ((1 << 40) - 1), best >> 40


def nearest(photos: DataFrame, k: int, hash_col: str = "fingerprint") -> DataFrame:
    """(i, j, distance, rank): the k nearest hashes of each photo, ties to the smaller index.

    Exact. Hashes go out in blocks of bounded size, against all rows; a task keeps k per row and block. Of equal hashes only the k + 1 with
    the least indices can be among the nearest of any photo, and equal hashes of a batch are searched once.
    """
    rows = checkpointed(photos.select(F.col("idx").cast("long").alias("i"), F.col(hash_col).alias("h")).filter("h IS NOT NULL"))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    # By rows, not bytes: a few MB of hashes are much work.
    dealt = rows.repartition(max(1, min(10_000, -(-n // ROWS))), "h")
    out = None
    for b in range(blocks):
        own = rows.filter(F.pmod("i", F.lit(blocks)) == b).toArrow()
        ids, hashes = own["i"].to_numpy(), own["h"].to_numpy()
        order = np.lexsort((ids, hashes))
        ids, hashes = ids[order], hashes[order]
        place = np.arange(len(ids))
        kept = place - np.searchsorted(hashes, hashes) <= k
        order = np.argsort(ids[kept])
        shared = photos.sparkSession.sparkContext.broadcast((ids[kept][order], hashes[kept][order].view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, hashes = shared.value
            for batch in batches:
                i, (distinct, of) = batch.column(0).to_numpy(), np.unique(batch.column(1).to_numpy().view(np.uint64), return_inverse=True)
                for at in range(0, len(distinct), QUERIES):
                    found, far = _nearest_of(distinct[at : at + QUERIES], hashes, k + 1)
                    mine = np.flatnonzero((of >= at) & (of < at + QUERIES))
                    which, dist = found[of[mine] - at], far[of[mine] - at]
                    known = dist <= 64
                    others = known & (ids[np.where(known, which, 0)] != i[mine][:, None]) if len(ids) else known
                    keep = others & (np.cumsum(others, axis=1) <= k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i[mine], keep.sum(1))), pa.array(ids[which[keep]]), pa.array(dist[keep])], ["i", "j", "distance"])

        part = dealt.mapInArrow(run, "i long, j long, distance long")
        out = part if out is None else out.unionAll(part)
    order = Window.partitionBy("i").orderBy("distance", "j")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidates(photos: DataFrame, settings: GroupingSettings, visual: bool = True) -> DataFrame:
    """Distinct (i, j), i < j, from the band and, if wanted, the nearest hashes."""
    band = band_pairs(photos, settings.neighbor_window)
    if not visual:
        return band
    near = nearest(photos, settings.visual_neighbors).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    # The band has all pairs that are close.
    return band.unionAll(near.filter(F.col("j") - F.col("i") > settings.neighbor_window).distinct())


def coverage(photos: DataFrame, settings: GroupingSettings) -> DataFrame:
    """One row: the share of photos that have each evidence; folder is 1 or 0."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    trusted = trusted_gps(settings)
    has = lambda name: F.col(name).isNotNull()
    return photos.agg(
        (F.count_distinct("source_folder") > 1).cast("double").alias("folder"), share(has("t")).alias("time"), share(has("sequence_number")).alias("sequence"),
        share(trusted).alias("gps"), share(trusted & has("altitude")).alias("altitude"), share(has("heading")).alias("heading"),
        share(has("exposure_value")).alias("exposure"), share(has("fingerprint")).alias("visual"),
    )


def usable(row, settings: GroupingSettings) -> set[str]:
    """Evidence with weight and enough coverage; time makes sequence numbers superfluous."""
    found = {k for k, w in settings.weights.items() if w > 0 and row[k] >= settings.minimum_evidence_coverage}
    return found - {"sequence"} if "time" in found else found


def trusted_gps(settings: GroupingSettings, prefix: str = "") -> Column:
    c = lambda name: F.col(f"{prefix}{name}")
    return C.trusted_location(c("latitude"), c("accuracy"), c("fix_t"), c("t"), settings.maximum_gps_accuracy, settings.maximum_gps_age)


FIELDS = ("source_folder", "t", "sequence_number", "latitude", "longitude", "altitude", "accuracy", "fix_t", "heading", "exposure_value", "fingerprint")


def scored(pairs: DataFrame, photos: DataFrame, settings: GroupingSettings, kinds: set[str]) -> DataFrame:
    """(i, j, score): the mean of available similarities, weighted by what this pair has.

    Terms that are not used are never built, so their columns are pruned from the scan.
    """
    side = lambda p: photos.select(F.col("idx").alias(f"{p}idx"), *[F.col(x).alias(p + x) for x in FIELDS])
    both = pairs.join(side("a_"), F.col("i") == F.col("a_idx")).join(side("b_"), F.col("j") == F.col("b_idx"))
    a, b = (lambda x: F.col(f"a_{x}")), (lambda x: F.col(f"b_{x}"))
    gps = trusted_gps(settings, "a_") & trusted_gps(settings, "b_")
    radius = F.greatest(F.lit(float(settings.gps_radius)), (F.coalesce(a("accuracy"), F.lit(0.0)) + F.coalesce(b("accuracy"), F.lit(0.0))) / 2)
    terms = {
        "folder": F.when(a("source_folder") == b("source_folder"), 1.0).otherwise(0.0),
        "time": C.decay(a("t") - b("t"), settings.time_gap),
        "sequence": C.decay((a("sequence_number") - b("sequence_number")).cast("double"), settings.sequence_span),
        "gps": F.when(gps, F.exp(-C.haversine(a("latitude"), a("longitude"), b("latitude"), b("longitude")) / F.greatest(F.lit(1.0), radius))),
        "altitude": F.when(gps, C.decay(C.vertical(a("altitude"), b("altitude")), 2 * settings.floor_height, 0.5)),
        "heading": C.turn(a("heading"), b("heading")),
        "exposure": C.decay(a("exposure_value") - b("exposure_value"), settings.exposure_span, 0.5),
        "visual": C.decay(C.hamming_share(a("fingerprint"), b("fingerprint")), settings.visual_span, 0.01),
    }
    total = weight = F.lit(0.0)
    for kind, w in settings.weights.items():
        if kind in kinds:
            total = total + F.coalesce(w * terms[kind], F.lit(0.0))
            weight = weight + F.when(terms[kind].isNotNull(), F.lit(float(w))).otherwise(0.0)
    return both.select("i", "j", F.when(weight > 0, total / weight).otherwise(0.0).alias("score"))
