"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """`partitions`: of a shuffle; where it is None Spark's own default and adaptive coalescing decide."""
    builder = SparkSession.builder.appName("quire")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for name, value in (settings | conf).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
