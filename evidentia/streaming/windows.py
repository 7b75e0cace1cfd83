"""Streaming aggregates over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.numeric import rounded
from evidentia.sources.tables import scratch


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of event-time windows; events later than `late` behind the newest are dropped by the watermark.

    In append mode a window is given once, when the watermark has passed its end, and its state is dropped.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def tumbling_append(source: DataFrame, out: str, width: str = "1 hour", late: str = "2 hours") -> None:
    """Append the windows that a stream's available rows close to `out`/rows; `out`/state keeps the open ones and the watermark for the next run."""
    query = tumbling(source, width, late).writeStream.outputMode("append").format("parquet")
    query.option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{out}/rows").withColumn("start", F.col("start").cast("timestamp_ntz"))


def tumbling_counts(spark: SparkSession, path: str) -> DataFrame:
    """All of a table's windows, by available-now runs of the stream in append mode: one over the table, and one over a
    closing event thirty days on, which moves the watermark past the windows still open.

    One file is one batch here, so no event is late. The closing event's own window stays open and is never written.
    """
    out = scratch(spark)
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.parquet(f"{out}/end")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).unionByName(spark.readStream.schema(schema).parquet(f"{out}/end"))
    tumbling_append(events, out)
    newest = spark.read.parquet(path).agg(F.max("ts").alias("ts")).where("ts is not null")
    closing = [(F.col("ts") + F.expr("interval 30 days") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    newest.select(closing).write.mode("append").parquet(f"{out}/end")
    tumbling_append(events, out)
    return read_windows(spark, out)
