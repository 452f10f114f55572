"""The photo table: a view of ``embeddings`` joined to ``events`` in capture order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsort.functions import columns as C

#: File name endings of images.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "heic", "heif", "tiff", "tif", "bmp", "dng"]
#: Seconds of one ordering bucket.
BUCKET = 3600


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dense_index(df: DataFrame, bucket: Column, *keys: Column, name: str = "idx") -> DataFrame:
    """``df`` with a dense number from 0 in the order of ``keys``.

    ``bucket`` must rise with the keys. Rows are numbered within their bucket, in parallel, and shifted by the
    sizes of all earlier buckets; only bucket counts meet in one task.
    """
    marked = df.withColumn("__bucket", bucket)
    sizes = marked.groupBy("__bucket").count()
    before = Window.orderBy(F.col("__bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys)) - 1
    joined = marked.withColumn("__own", own).join(offsets, F.col("__bucket").eqNullSafe(F.col("__b")))
    return joined.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before", "__bucket", "__b")


def capture_order(df: DataFrame) -> DataFrame:
    """Time, then folder, sequence number and path; unknown times and numbers last (a total order)."""
    keys = (F.col("t").asc_nulls_last(), "source_folder", F.col("sequence_number").asc_nulls_last(), "relative_path")
    return dense_index(df, F.floor(F.col("t") / BUCKET), *keys)


def photo_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a photo; some GPS fields, focal lengths and hashes are null by rule, so null handling is seen."""
    m = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    e = read(spark, sf_dir, "events").select("event_id", "ts", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("vec_id")
    rows = m.join(e, v == F.col("event_id")).select(
        v,
        F.concat(F.lit("src"), F.col("label").cast("string")).alias("source_folder"),
        F.concat(F.lit("src"), F.col("label").cast("string"), F.lit("/IMG_"), F.format_string("%04d", v), F.lit(".HEIC")).alias("relative_path"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        (k * 3.6).alias("heading"),
        F.log2(F.col("value") + 1).alias("exposure_value"),
        F.col("value").alias("sharpness"),
        C.sign_bits(F.col("embedding")).alias("fingerprint"),
        C.thermometer(F.col("value") / 6).alias("near_hash"),
        F.when(v % 17 == 0, 12000).when(v % 19 == 0, 320).otherwise(4032).cast("int").alias("pixel_width"),
        F.when(v % 17 == 0, 3000).when(v % 19 == 0, 240).otherwise(3024).cast("int").alias("pixel_height"),
        ((v % 10) / 10.0).alias("highlights"),
        ((v % 7) / 7.0).alias("shadows"),
        F.when(v % 3 != 0, 35.0 + (v % 11) * 0.001).alias("latitude"),
        F.when(v % 3 != 0, 139.0 + (v % 13) * 0.001).alias("longitude"),
        F.when(v % 4 != 0, (v % 5) * 3.0).alias("altitude"),
        F.when(v % 5 != 0, (v % 8) * 10.0).alias("accuracy"),
        F.when(v % 6 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - (v % 9) * 30).alias("fix_t"),
        F.when(v % 2 == 0, 24.0 + v % 3).alias("focal_length"),
        F.concat(F.lit("cam"), (v % 2).cast("string")).alias("camera_model"),
    )
    return capture_order(rows.withColumn("sequence_number", C.sequence_number(F.col("relative_path"))))


#: The same view in the oracle's dialect.
SQL = """photos AS (
  SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY t NULLS LAST, source_folder, sequence_number NULLS LAST, relative_path) - 1 AS BIGINT) AS idx FROM (
    SELECT m.vec_id, 'src' || label AS source_folder, 'src' || label || '/IMG_' || PRINTF('%04d', m.vec_id) || '.HEIC' AS relative_path,
      EPOCH_US(ts) / 1e6 AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) * 3.6::DOUBLE AS heading, LOG2(value + 1) AS exposure_value, value AS sharpness,
      CAST(h - CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT) AS fingerprint,
      (CAST(1 AS BIGINT) << CAST(LEAST(62, GREATEST(0, FLOOR(value / 6))) AS INTEGER)) - 1 + CASE WHEN FLOOR(value / 6) >= 63 THEN CAST(1 AS BIGINT) << 62 ELSE 0 END AS near_hash,
      CASE WHEN m.vec_id % 17 = 0 THEN 12000 WHEN m.vec_id % 19 = 0 THEN 320 ELSE 4032 END AS pixel_width,
      CASE WHEN m.vec_id % 17 = 0 THEN 3000 WHEN m.vec_id % 19 = 0 THEN 240 ELSE 3024 END AS pixel_height,
      CAST(m.vec_id % 10 AS DOUBLE) / 10.0 AS highlights, CAST(m.vec_id % 7 AS DOUBLE) / 7.0 AS shadows,
      CASE WHEN m.vec_id % 3 <> 0 THEN 35.0::DOUBLE + (m.vec_id % 11) * 0.001::DOUBLE END AS latitude,
      CASE WHEN m.vec_id % 3 <> 0 THEN 139.0::DOUBLE + (m.vec_id % 13) * 0.001::DOUBLE END AS longitude,
      CASE WHEN m.vec_id % 4 <> 0 THEN (m.vec_id % 5) * 3.0::DOUBLE END AS altitude,
      CASE WHEN m.vec_id % 5 <> 0 THEN (m.vec_id % 8) * 10.0::DOUBLE END AS accuracy,
      CASE WHEN m.vec_id % 6 <> 0 THEN EPOCH_US(ts) / 1e6 - (m.vec_id % 9) * 30 END AS fix_t,
      CASE WHEN m.vec_id % 2 = 0 THEN 24.0::DOUBLE + m.vec_id % 3 END AS focal_length, 'cam' || (m.vec_id % 2) AS camera_model,
      CAST(m.vec_id AS INTEGER) AS sequence_number
    FROM (SELECT *, LIST_SUM(LIST_TRANSFORM(RANGE(1, 65), LAMBDA i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << CAST(64 - i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS h FROM embeddings) m
    JOIN events e ON e.event_id = m.vec_id))"""
