"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``VNODES`` points of a 64-bit ring; a document's id hashes to a point of the ring and belongs to
the next virtual node clockwise. A shard's load is bounded: with n documents, floor(n / shards) and, for the first
n mod shards of them, one more, so the law ``rows`` holds exactly. What overflows a full shard continues clockwise
to the next shard with room, as a whole stretch of the ring.

The walk needs no document: documents are counted per virtual node (shards x VNODES counts, whatever
the corpus), the driver walks the ring over the counts, and gives each node a list of (from rank, shard, first slot).
Documents are then ranked within their node by hash. Rows that repeat id, size and text are counted
first and expanded after, so a document repeated for a third of all rows is one row until then.

Defined cases: null texts have 16 bytes and the crc32 of the empty text; null ids are placed by
size and crc32.
Equal rows are interchangeable: they get slots of their own. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsort.llm.common import cut

SHARDS = 40
VNODES = 256
OVERHEAD = 16


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points and the shard of each; a shard's points do not depend on the number of shards."""
    points = sorted((xxhash.xxh64_intdigest(f"shard-{s}-{v}".encode(), 7), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.uint64), np.array([s for _, s in points], np.int64)


def walk(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches (node, from rank, to rank, shard, first slot) of all nodes' documents.

    First each node fills its own shard, in ring order; then what is left over goes clockwise, node by
    node, to the next shard that has room.
    """
    n = int(counts.sum())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    out, over = [], []
    for node, (count, s) in enumerate(zip(counts.tolist(), owner.tolist(), strict=True)):
        own = min(count, room[s] - used[s])
        if own:
            out.append((node, 0, own, s, used[s]))
            used[s] += own
        if count > own:
            over.append((node, own, count))
    for node, start, end in over:
        at = node
        while start < end:
            at = (at + 1) % len(owner)
            s = int(owner[at])
            take = min(end - start, room[s] - used[s])
            if take:
                out.append((node, start, start + take, s, used[s]))
                used[s] += take
                start += take
    return out


def _node(docs: DataFrame, shards: int):
    points, _ = ring(shards)
    shared = docs.sparkSession.sparkContext.broadcast(points)

    def run(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for h in hashes:
            at = np.searchsorted(shared.value, h.to_numpy(zero_copy_only=False).view(np.uint64), "left")
            yield pa.array((at % len(shared.value)).astype(np.int32))

    return F.arrow_udf(run, "int")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark, node = docs.sparkSession, _node(docs, shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64(F.col("doc_id").cast("string")))
    rows = cut(read.withColumn("place", place))  # texts are read once
    counts = np.zeros(shards * VNODES, np.int64)
    for r in rows.select(node(F.col("place")).alias("node")).groupBy("node").count().collect():  # one row a node
        counts[r[0]] = r[1]
    kinds = {"node_": pa.int32(), "low": pa.int64(), "high": pa.int64(), "shard": pa.int32(), "base": pa.int64()}
    found = zip(*(walk(counts, ring(shards)[1], shards) or [(-1, 0, 0, 0, 0)]), strict=True)
    # From an Arrow table: rows of Python's would start workers of another kind, which stay beside the others.
    stretches = spark.createDataFrame(pa.table([pa.array(x, k) for x, k in zip(found, kinds.values(), strict=True)], list(kinds)))
    distinct = rows.groupBy("doc_id", "size", "text_crc32", "place").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("node").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = distinct.withColumn("node", node(F.col("place"))).withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # One row per stretch that the run of equal rows meets; nearly always one.
    start = F.col("end") - F.col("n")
    met = ranked.join(F.broadcast(stretches), (F.col("node") == F.col("node_")) & (F.col("end") > F.col("low")) & (start < F.col("high")))
    first, last = F.greatest(start, F.col("low")), F.least(F.col("end"), F.col("high")) - 1
    each = met.withColumn("rank", F.explode(F.sequence(first, last)))
    return each.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
