"""A session with the settings the engine wants."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("quern").config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
