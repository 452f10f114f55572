"""Distribution statistics: histogram, percentile, and Otsu's threshold over 64 bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 64


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) of all bins; values outside are counted at the ends."""
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col(column) - low) / width).cast("int"), F.lit(0)), F.lit(bins - 1))
    counts = df.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def percentile(df: DataFrame, column: str, *shares: float) -> DataFrame:
    return df.agg(*[F.percentile(column, s).alias(f"p{round(100 * s)}") for s in shares])


def otsu(df: DataFrame, column: str) -> DataFrame:
    """One row (threshold, separability, lower_fraction); none without two different values.

    Values meet only as 64 bin counts. Bin centres stand for values; of cuts that tie within 1e-12 of the best,
    the middle one is taken.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("total")).filter("total >= 2 AND high > low")
    width = (F.col("high") - F.col("low")) / BINS
    at = F.least(F.greatest(F.floor((F.col("v") - F.col("low")) / width).cast("int"), F.lit(0)), F.lit(BINS - 1))
    binned = values.join(F.broadcast(ends)).groupBy("low", "high", "total", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = F.broadcast(ends).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    full = grid.join(binned.select("bin", "n"), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    full = full.withColumn("centre", F.col("low") + (F.col("bin") + 0.5) * width)
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moments = full.withColumns({
        "w0": F.sum("n").over(up) / F.col("total"),
        "s0": F.sum(F.col("n") * F.col("centre")).over(up) / F.col("total"),
        "mean": F.sum(F.col("n") * F.col("centre")).over(whole) / F.col("total"),
        "square": F.sum(F.col("n") * F.col("centre") * F.col("centre")).over(whole) / F.col("total"),
    })
    split = F.when((F.col("w0") > 0) & (F.col("w0") < 1), F.pow(F.col("mean") * F.col("w0") - F.col("s0"), F.lit(2.0)) / (F.col("w0") * (1 - F.col("w0"))))
    cuts = moments.filter(F.col("bin") < BINS - 1).withColumn("between", F.coalesce(split, F.lit(0.0))).withColumn("best", F.max("between").over(whole))
    tied = cuts.filter(F.col("between") >= F.col("best") - 1e-12)
    variance = F.col("square") - F.col("mean") * F.col("mean")
    ranked = tied.withColumn("r", F.row_number().over(Window.orderBy("bin")) - 1).withColumn("k", F.count(F.lit(1)).over(whole))
    chosen = ranked.filter((F.col("r") == F.floor(F.col("k") / 2)) & (variance > 0))
    return chosen.select((F.col("low") + (F.col("bin") + 1) * width).alias("threshold"), F.least(F.lit(1.0), F.col("best") / variance).alias("separability"), F.col("w0").alias("lower_fraction"))


OTSU_SQL = """vals AS (SELECT CAST({column} AS DOUBLE) AS v FROM {table} WHERE {column} IS NOT NULL),
ends AS (SELECT MIN(v) AS low, MAX(v) AS high, COUNT(*) AS total FROM vals HAVING COUNT(*) >= 2 AND MAX(v) > MIN(v)),
binned AS (SELECT LEAST(GREATEST(CAST(FLOOR((v - low) / ((high - low) / 64)) AS INTEGER), 0), 63) AS bin, COUNT(*) AS n FROM vals, ends GROUP BY 1),
grid AS (SELECT g AS bin, low, high, total, (high - low) / 64 AS width, low + (g + 0.5) * ((high - low) / 64) AS centre, COALESCE(n, 0)::DOUBLE AS n
  FROM ends CROSS JOIN RANGE(64) t(g) LEFT JOIN binned b ON b.bin = g),
moments AS (SELECT *, SUM(n) OVER u / total AS w0, SUM(n * centre) OVER u / total AS s0, SUM(n * centre) OVER () / total AS mean,
  SUM(n * centre * centre) OVER () / total AS square FROM grid WINDOW u AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
cuts AS (SELECT *, CASE WHEN w0 > 0 AND w0 < 1 THEN POW(mean * w0 - s0, 2) / (w0 * (1 - w0)) ELSE 0 END AS between_ FROM moments WHERE bin < 63),
tied AS (SELECT *, ROW_NUMBER() OVER (ORDER BY bin) - 1 AS r, COUNT(*) OVER () AS k FROM (SELECT *, MAX(between_) OVER () AS best FROM cuts) WHERE between_ >= best - 1e-12),
otsu AS (SELECT low + (bin + 1) * width AS threshold, LEAST(1.0, best / (square - mean * mean)) AS separability, w0 AS lower_fraction
  FROM tied WHERE r = k // 2 AND square - mean * mean > 0)"""
