"""Shared pieces of the training-data operators: scratch tables, small-side joins, sampling."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in the contracts: space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of its own is made only where none is set and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="capsort-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    The table survives lost executors, is columnar (later readers prune), and is written once however
    many consumers it has.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/capsort-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, tables: Iterable[DataFrame]) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def hand_back() -> None:
    """Give what a worker has freed back to the system: workers stay after their tasks, and would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and what its task held is handed back at its end: an idle worker keeps only what it imported."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        hand_back()

    return whole


#: Bits of the bitmap of ``perhaps_in``: 2 MB, whatever the size of the tables.
BITMAP = 1 << 24


def perhaps_in(keys: DataFrame, name: str) -> Callable[[Column], Column] | None:
    """A test of long columns that is true for all hashes in the column ``name``, and for few others; None if it would keep most.

    For joins of wide rows with a set of hashes: rows that can't match are kept out of the exchange. The bitmap has a
    fixed size, so beyond some millions of hashes there is None, and the join deals all rows.
    """
    place = F.pmod(F.col(name), F.lit(BITMAP)).alias("place")
    words = keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(BITMAP // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    if 2 * int(np.bitwise_count(table.view(np.uint64)).sum()) > BITMAP:
        return None
    shared = keys.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def hit(hashes: pa.Array) -> pa.Array:
        hand_back()
        at = hashes.to_numpy(zero_copy_only=False) % BITMAP
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return F.arrow_udf(hit, "boolean")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def bounded_texts(rows: DataFrame, most_rows: int, most_bytes: int) -> list[tuple[int, object, str]]:
    """(place, label, text) of ``rows`` in the order of place and text hash, at most so many rows and bytes; never more reach the driver.

    A text that does not fit any more is passed over. Rows that repeat place and text are one. The result does not depend on partitioning.
    """
    named = rows.withColumn("mark", F.xxhash64("text"))
    sizes = named.groupBy("place", "mark").agg(F.max(F.octet_length("text")).alias("size")).orderBy("place", "mark").limit(most_rows).collect()
    left, chosen = most_bytes, []
    for r in sizes:
        if r.size <= left:
            left -= r.size
            chosen.append((r.place, r.mark))
    if not chosen:
        return []
    some = named.filter(F.col("place").isin([p for p, _ in chosen])).groupBy("place", "mark").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    wanted = set(chosen)
    return sorted((r.place, r.label, r.text) for r in some.filter(F.col("mark").isin([m for _, m in chosen])).collect() if (r.place, r.mark) in wanted)


def bounded_sample(rows: DataFrame, label: str, size: int, most_labels: int, most_bytes: int) -> list[tuple[str, object]]:
    """At most ``size`` (text, label) rows of ``most_bytes``, about as many of each label, chosen by hash of id and text.

    Narrow passes: labels are counted first, then the texts of the chosen rows are read. The result is
    sorted, so that a model fitted on it does not depend on partitioning. More labels than ``most_labels`` are an error.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels + 1).collect()}
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} different values of {label}")
    if not counts:
        return []
    share = max(1, size // len(counts))
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * share / n))])
    place = F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text"))
    chosen = rows.filter(F.pmod(place, F.lit(1_000_000)) < F.element_at(rates, F.col(label)) * 1_000_000)
    found: dict[object, list] = {}
    for p, k, text in bounded_texts(chosen.select(place.alias("place"), F.col(label).alias("label"), "text"), 2 * size, most_bytes):
        found.setdefault(k, []).append((p, text))
    return [(text, k) for k in sorted(found) for _, text in sorted(found[k])[:share]]
