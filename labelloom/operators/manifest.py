"""Status rows of processed files: best status, upserts, resuming and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which status counts more where a file has several.
PRIORITY = {"ok": 5, "done": 5, "exported": 5, "exists": 4, "already_done": 4, "skipped": 3, "recovered": 2, "failed": 1}


def priority(status: str, table: dict[str, int] = PRIORITY) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(status)), F.lit(0))


def best_status(rows: DataFrame, key: str, status: str = "status", order: str | None = None, table: dict[str, int] = PRIORITY) -> DataFrame:
    """One row a key: the highest priority, of equals the last in order."""
    w = Window.partitionBy(key).orderBy(F.desc("_p"), *([F.desc(order)] if order else []))
    return rows.withColumn("_p", priority(status, table)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_p", "_n")


def to_do(inputs: DataFrame, done: DataFrame, key: str, status: str = "status", finished: tuple[str, ...] = ("ok", "done", "exported", "exists", "already_done")) -> DataFrame:
    """Inputs that no finished row covers."""
    return inputs.join(done.where(F.col(status).isin(*finished)).select(key).distinct(), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of the keys in new replaced by new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def appended(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the rows of new whose key, whatever its case, old lacks; of repeats in new one stays."""
    norm = lambda df: df.withColumn("_k", F.lower(F.trim(key)))
    fresh = norm(new).where("_k <> ''").join(norm(old).select("_k").distinct(), "_k", "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(key))).where("_n = 1").drop("_n", "_k")
    return old.unionByName(first, allowMissingColumns=True)


def recovered(data: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Status rows for keys that data has and the manifest lacks."""
    return data.groupBy(key).agg(F.count("*").alias("n")).join(rows.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("recovered"))


def without_orphans(data: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return data.join(rows.select(key).distinct(), key, "left_semi")


def status_counts(rows: DataFrame, *statuses: str) -> DataFrame:
    return rows.agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses))


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """df in the columns of a DDL schema: missing ones null, further ones left out."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else df.sparkSession.createDataFrame([], schema).schema
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want))
