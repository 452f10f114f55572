"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source (partial aggregation before the shuffle: a source holding a third of all rows is one
row per task). Targets share the whole by weight, capped at ``MOST`` times a source's size, and the excess is
reshared by weight: with sources in the order of cap over weight, a prefix is capped, and the first level that
fits the rest is the fixed point. Each document is then emitted floor(rate) times, plus once more if its
hash, uniform in [0, 1), is under the fraction. The hash depends on the seed and the id alone, so reruns agree.

Rates are one row a source. They are broadcast if there are at most ``BROADCAST_ROWS`` of them (counted), else
joined by a shuffle in which each source is dealt over ``SALTS`` keys.

Defined cases: a null text has size 0 and null is a source of its own, last in order. A source of size 0 has target 0
and rate 0 (its documents weigh nothing and are not emitted). Repeated ids get the same draw. Extra columns, also
ones named like the results, are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsort.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
BROADCAST_ROWS = 50_000
SALTS = 64


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size): also weight, target and rate. One row a source in and out.

    The windows order sources, not documents: their input is the aggregate.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ratio = (F.col("source_size") * most).cast("double") / F.col("weight")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # left, rest: what remains for this source and all later ones if all earlier ones are capped.
    stepped = weighed.withColumn("ratio", ratio).withColumns({
        "left": F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(up_to), F.lit(0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0)),
    })
    # The cap of the first source that is not over it ends the prefix of capped ones.
    fits = F.col("left") * F.col("weight") <= F.col("source_size") * most * F.col("rest")
    level = F.min(F.when(fits, F.struct("ratio", F.col("source").isNull().alias("last"), "source", "left", "rest"))).over(everything)
    capped = F.struct("ratio", F.col("source").isNull().alias("last"), "source") < F.struct("level.ratio", "level.last", "level.source")
    shared = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.rest")
    target = F.when(F.col("level").isNull() | F.coalesce(capped, F.lit(False)), (F.col("source_size") * most).cast("double")).otherwise(shared)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return stepped.withColumn("level", level).withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("int")


def _rates(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Targets of all sources as a small table, and whether it may be broadcast."""
    sizes = docs.select(F.col("source"), words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = cut(sizes)
    small = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    table = cut(targets(sizes)).select(F.struct(F.col("source").alias("s"), "source_size", "target", "rate").alias("__capsort_mix"))
    return table, small


def _with_rates(docs: DataFrame) -> DataFrame:
    table, small = _rates(docs)
    same = docs["source"].eqNullSafe(table["__capsort_mix.s"])
    if small:
        return docs.join(F.broadcast(table), same)
    salted = table.withColumn("__capsort_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = docs.withColumn("__capsort_salt_", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt["source"].eqNullSafe(salted["__capsort_mix.s"]) & (F.col("__capsort_salt_") == F.col("__capsort_salt"))).drop("__capsort_salt", "__capsort_salt_")


def plan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, rate, n_copies."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source"))
    mix = F.col("__capsort_mix")
    out = _with_rates(rows).select("doc_id", words(F.col("text")).alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"), mix["rate"].alias("rate"), copies(mix["rate"], F.col("doc_id")).alias("n_copies"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "rate", "n_copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns of ``docs``."""
    n = copies(F.col("__capsort_mix.rate"), F.col("doc_id"))
    dealt = _with_rates(docs).withColumn("__capsort_n", n).filter(F.col("__capsort_n") > 0)
    out = dealt.withColumn("__capsort_k", F.explode(F.sequence(F.lit(1), F.col("__capsort_n"))))
    return out.drop("__capsort_mix", "__capsort_n", "__capsort_k")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST) AS place FROM sources),
stepped AS (
  SELECT *, CAST(SUM(source_size) OVER () - 3 * COALESCE(SUM(source_size) OVER w, 0) AS BIGINT) AS rem,
         CAST(SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0) AS BIGINT) AS rest
  FROM ordered WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT place AS first_free, rem AS level_rem, rest AS level_rest FROM stepped
  WHERE rem * weight <= source_size * 3 * rest ORDER BY place LIMIT 1),
rated AS (
  SELECT source, source_size,
         CASE WHEN first_free IS NULL OR place < first_free THEN CAST(source_size * 3 AS DOUBLE)
              ELSE CAST(level_rem * weight AS DOUBLE) / level_rest END AS target
  FROM stepped LEFT JOIN level ON TRUE),
drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || SUBSTR(MD5('17:' || COALESCE(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (FLOOR(rate) + CASE WHEN draw < rate - FLOOR(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(rate AS DOUBLE) AS rate,
       CAST(FLOOR(rate) + CASE WHEN draw < rate - FLOOR(rate) THEN 1 ELSE 0 END AS INTEGER) AS n_copies
FROM drawn
"""
