"""Incremental ingestion: each file once, with the best status of each key kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.manifest import best_status
from labelloom.operators.sides import small
from labelloom.sources.files import discard, write_partitions


def ingest(spark: SparkSession, source: str, ddl: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, kind: str = "json", per_batch: int = 1000, **options: str) -> None:
    """Files of a folder that no earlier call has seen, transformed and appended as Parquet; a failed call is picked up where it stopped."""
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", per_batch).options(**options).format(kind).load(source)
    query = transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_upserts(spark: SparkSession, source: str, ddl: str, target: str, checkpoint: str, key: str, group: str, order: str) -> None:
    """Status rows of new files merged into a table by group: of each key the best status stays. Only touched groups are rewritten."""

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        groups = batch.select(group).distinct()
        try:
            old = session.read.parquet(target).join(small(groups), group, "left_semi")
            rows = old.unionByName(batch, allowMissingColumns=True)
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = batch
        staged = f"{target.rstrip('/')}-staged-{uuid.uuid4().hex}"  # what is read can't be overwritten in one step
        best_status(rows, key, order=order).write.parquet(staged)
        write_partitions(session.read.parquet(staged), target, group)
        discard(session, staged)

    stream = spark.readStream.schema(ddl).json(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and kind, for streams with late rows up to `late`, and for tables."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", kind, "n", "total")
