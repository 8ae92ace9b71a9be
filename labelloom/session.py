"""Spark session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "labelloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf: further settings, dots written as underscores doubled (a__b)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
