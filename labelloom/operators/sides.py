"""Sizes of join sides, checked before one is sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.sources.files import scratch


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows (counted); otherwise as it is, for a shuffled join.

    Counting runs df's plan once more, so this is for sides that are read; see `sent` for those that are made.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def stored(df: DataFrame, name: str = "side") -> DataFrame:
    """df written as Parquet into the shared folder and read again: it is made once, and a lost executor costs no rework."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """As small, for a side that takes work to make: it is stored first, so it is made once."""
    return small(stored(df), most_rows)


def spread(df: DataFrame, rows: int, *keys: str, most_rows: int = 500_000) -> DataFrame:
    """df, of about `rows` rows, in partitions by keys of about most_rows rows, that later groups and joins by keys share.

    Adaptive execution joins partitions by their compressed bytes, which for narrow rows are millions of groups in one
    task; partitions of a stated number stay. Few rows stay as they are.
    """
    if rows <= 4 * most_rows:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // most_rows)), *keys)
