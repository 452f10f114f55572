"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last keep the columns of ``documents``; the last is the manifest of the shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsort.llm import decontam, langid, mixing, sharding, simhash
from capsort.llm.common import cut, read


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; those without a letter or text (``und``) go.

    The model learns from the labels of the documents themselves; the column ``lang`` is kept as it is.
    """
    tagged = langid.predict(docs, langid.train(docs), "__capsort_pred", "__capsort_score")
    return tagged.filter(F.col("__capsort_pred") != "und").drop("__capsort_pred", "__capsort_score")


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id: pairs by SimHash and multi-index hashing, checked
    on their shingle sets, and similar pairs whose fingerprints lie further apart by an exact search."""
    return simhash.keep_representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every emitted document."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", identified),
    ("near_dedup", near_deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Shingles by XXH64 and the fitted model have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the whole pipeline over ``documents``; each stage's table is in the shared folder."""
    last = len(STAGES) - 1
    step = lambda docs, at: (out := at[1][1](spark, docs, sf_dir), out if at[0] == last else cut(out))[1]
    return reduce(step, enumerate(STAGES), read(spark, sf_dir, "documents"))
