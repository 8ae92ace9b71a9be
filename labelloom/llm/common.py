"""Helpers the training-data operators share: shared-folder tables, folds, small sides, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.sides import small
from labelloom.sources.files import discard, scratch


def written(df: DataFrame, name: str, *cols: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends there, and lost executors cost no rework.

    cols: columns by which to hash-partition before writing. The tables of an application lie below one folder (see
    `scratch`), which may go when its results have been taken.
    """
    return saved(df.repartition(*cols) if cols else df, scratch(df.sparkSession, name))


def saved(df: DataFrame, path: str) -> DataFrame:
    """df written to path as Parquet and read again, for tables that are discarded before the application ends."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame, most: int = 1_000) -> DataFrame:
    """df, whose session from now on sends Python at most `most` rows at once: rows that hold whole texts are large.

    Spark reads this setting when a plan is made, so it stays for the session; README tells users so.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= most:
        conf.set(name, str(most))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__ and so on that df has no column of, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def uniform(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the hash of cols: 53 bits of it."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), "")), F.lit(0)).cast("long")


def hash_sample(df: DataFrame, most: int, seed: int, *keys: str) -> DataFrame:
    """The `most` rows of df with the smallest hashes of keys (repeatable, whatever the partitions).

    Of a large table only about twice as many rows, those with small hashes, get into the sort.
    """
    n, h = df.count(), F.xxhash64(*keys, F.lit(seed))
    if n > 4 * most:
        df = df.where(h < F.lit(int(-(2**63) + 2 * most / n * 2**64)))
    return df.orderBy(h, *keys).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """Up to `most` labelled (doc_id, text, label) rows outside the held-out fold, chosen by hash of the id.

    One label per id (the largest) and one text per id (the smallest), so repeated rows weigh once.
    """
    wanted = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    wanted = hash_sample(wanted, most, 11, "doc_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(small(wanted, most), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of an edge list: each node that is not the smallest of its tree, with that smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = np.fromiter(up, np.int64, len(up))
    return nodes, np.fromiter((root(x) for x in up), np.int64, len(up))


def _local_forest(batches):
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long, no nulls): rows (node, root), root the smallest node reachable.

    Every batch of edges first shrinks to its own forest. Then large-star and small-star rounds, each of
    aggregations and equi-joins, run until nothing changes. A node with very many edges is only a skewed join key,
    which adaptive execution splits; no side is sent, as edges compress to far less than they take in a driver. Nodes without an edge are not returned.
    """
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        """df, written; of the tables before it only the last is needed any more."""
        paths.append(scratch(spark, "edges"))
        out = saved(df, paths[-1])
        discard(spark, *paths[:-1])
        del paths[:-1]
        return out

    e = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = kept(e.mapInArrow(_local_forest, "a long, b long").distinct())
    mark = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b))")).first()
        if tuple(now) == mark or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(now)
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        e = kept(both.join(low.hint("merge"), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        met = e.join(low.hint("merge"), F.col("a") == F.col("u"))
        e = kept(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def same_rows(df: DataFrame, keys: list[str], chunk: int = 10_000) -> DataFrame:
    """keys, and nth from 0: as many rows as df has for each value of keys, told apart by nth.

    For operators whose result depends on the keys alone: equal rows are counted before the shuffle, so a hot group is
    one row, and dealt in chunks afterwards, so that no task has to give out a hot group by itself.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    parts = n.select(*keys, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))).alias("_from"))
    return parts.repartition(*keys, "_from").select(*keys, F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + chunk) - 1)).alias("nth"))
