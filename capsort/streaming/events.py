"""Event lines of runs: decoding, encoding, throttling and terminal state, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from capsort.functions import columns as C

#: Names of processing stages.
STAGES = ["preProcessing", "imageAlignment", "pointCloudGeneration", "meshGeneration", "textureMapping", "optimization"]
#: Steps in which progress is reported.
STEPS = 50


def decode(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with kind, num and text; what is not an event is dropped."""
    line = F.btrim(F.col(column), F.lit(" \t\r\n"))
    key, value = F.regexp_extract(line, "^([^=]*)=", 1), F.regexp_extract(line, "(?s)^[^=]*=(.*)$", 1)
    has = line.contains("=")
    number = value.try_cast("double")
    kind = (
        F.when(line == "ok", "finished").when(line == "cancelled", "cancelled")
        .when(has & (key == "progress") & number.isNotNull(), "progress").when(has & (key == "eta") & number.isNotNull(), "eta")
        .when(has & (key == "stage") & value.isin(*STAGES), "stage").when(has & key.isin("note", "output", "pointCloud"), key)
    )
    out = lines.withColumns({"kind": kind, "num": F.when(kind.isin("progress", "eta"), number), "text": F.when(kind.isin("stage", "note", "output", "pointCloud"), value)})
    return out.filter("kind IS NOT NULL")


def encode() -> Column:
    """The line of (kind, num, text)."""
    k = F.col("kind")
    return (
        F.when(k == "finished", "ok").when(k == "cancelled", "cancelled").when(k == "progress", F.format_string("progress=%.3f", "num"))
        .when(k == "eta", F.concat(F.lit("eta="), F.greatest(F.lit(0), F.round("num")).cast("long").cast("string"))).otherwise(F.concat(k, F.lit("="), C.single_line(F.col("text"))))
    )


def throttle(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows at which progress, in steps of 1 / STEPS, passes all earlier rows of its run."""
    step = F.floor(F.col(value) * STEPS) / STEPS
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("step", step).withColumn("before", F.max("step").over(earlier)).filter("before IS NULL OR step > before").drop("before")


def run_states(events: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """Per run: last progress, and how it ended (cancelled, ok, or crashed)."""
    last = F.max_by(F.when(F.col("kind") == "progress", F.col("num")), F.when(F.col("kind") == "progress", F.col(order)))
    cancelled, finished = F.bool_or(F.col("kind") == "cancelled"), F.bool_or(F.col("kind") == "finished")
    state = F.when(cancelled, "cancelled").when(finished, "ok").otherwise("crashed")
    return events.groupBy(run).agg(last.alias("last_progress"), state.alias("state"), F.count(F.lit(1)).alias("n"))


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded events of log files ``run=<id>/...``, as they arrive; the text source frames the lines."""
    return decode(spark.readStream.format("text").option("basePath", folder).load(f"{folder}/run=*"))


class Throttle(StatefulProcessor):
    """The throttle as a keyed stream operator: one number of state a run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "step double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        top = self.top.get()[0] if self.top.exists() else None
        out = []
        for part in rows:
            for value in part["num"]:
                step = int(value * STEPS) / STEPS
                if top is None or step > top:
                    top = step
                    out.append((key[0], step))
        if top is not None:
            self.top.update((top,))
        yield pd.DataFrame(out, columns=["run", "step"])

    def close(self) -> None:
        pass


def throttled_stream(events: DataFrame) -> DataFrame:
    rows = events.filter("kind = 'progress'").select("run", "num")
    return rows.groupBy("run").transformWithStateInPandas(Throttle(), "run string, step double", "append", "processingTime")


def windowed(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window and type; with a watermark on streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
