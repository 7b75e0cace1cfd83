"""A Spark session with the settings that the queries' results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for timestamps, runtime re-planning for skew and small partitions, Arrow for columns that pass through Python.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str, master: str | None = None, **more: str) -> SparkSession:
    """The active session's settings win over none of these; on a cluster leave `master` to the submitter."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
