"""Splits of records by group without leaks, subsets of the test split, and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import col


def hash_order(key: str, seed: int) -> list[Column]:
    """A repeatable random order: md5 of seed and key, then the key."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def with_hash_rank(rows: DataFrame, key: str, seed: int, part: str | None = None) -> DataFrame:
    """rows with _k, the place (from 1) in the hash order of its part, and _n, the part's size; without part, of all rows.

    Rows are counted by part and the hash's first digits; a row's place is what comes before its digits, and its place
    among them. So windows hold a four-thousandth of a part, and a part may be as large as the table.
    """
    one = F.col(part) if part else F.lit(0)
    rows = rows.withColumn("_h", hash_order(key, seed)[0]).withColumn("_d", F.substring("_h", 1, 3)).withColumn("_part", one)
    w = Window.partitionBy("_part2")
    n = rows.groupBy(F.col("_part").alias("_part2"), F.col("_d").alias("_d2")).agg(F.count("*").alias("_c"))
    n = n.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_d2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(w))
    met = rows.join(n, F.col("_part").eqNullSafe(F.col("_part2")) & (F.col("_d") == F.col("_d2")))
    place = F.row_number().over(Window.partitionBy("_part", "_d").orderBy("_h", key))
    return met.withColumn("_k", F.col("_before") + place).drop("_h", "_d", "_part", "_part2", "_d2", "_c", "_before")


def _cuts(n: Column, val: float, test: float) -> tuple[Column, Column]:
    """Sizes of train and val among n groups: at least one test and one val from three groups on, and one train always."""
    n_test, n_val = F.greatest(F.lit(1), F.bround(n * test).cast("int")), F.greatest(F.lit(1), F.bround(n * val).cast("int"))
    short = n - n_test - n_val < 1
    n_train = F.when(n == 1, 1).when(n == 2, 1).when(short, 1).otherwise(n - n_test - n_val)
    kept_val = F.when(n <= 2, 0).when(short & (n_val > 1), n_val - 1).otherwise(n_val)
    return n_train.cast("int"), kept_val.cast("int")


def group_split(groups: DataFrame, key: str, val: float = 0.10, test: float = 0.15, seed: int = 42, strata: str | None = None) -> DataFrame:
    """groups (one row each) with split train, val or test, by hash order; with strata, inside each stratum.

    Records then join on the group.
    """
    rows = with_hash_rank(groups, key, seed, strata)
    n_train, n_val = _cuts(F.col("_n"), val, test)
    split = F.when(F.col("_k") <= n_train, "train").when(F.col("_k") <= n_train + n_val, "val").otherwise("test")
    return rows.withColumn("split", split).drop("_k", "_n")


def small_stratified_split(groups: DataFrame, key: str, strata: str, seed: int = 42) -> DataFrame:
    """For few groups: of a stratum the first goes to train, the second to test, with four or more the third to val, the rest to train."""
    rows = with_hash_rank(groups, key, seed, strata)
    split = F.when(F.col("_k") == 2, "test").when((F.col("_k") == 3) & (F.col("_n") >= 4), "val").otherwise("train")
    return rows.withColumn("split", split).drop("_k", "_n")


def routed(records: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """records with the split of their group; those of unknown groups are left out."""
    return records.join(splits.select(key, "split"), key)


def pseudo_validation(train: DataFrame, key: str, ratio: float = 0.08, least: int = 2, most: int = 30, enough: int = 20, seed: int = 42) -> DataFrame:
    """train with split train or pseudo_val: some records, by hash order, if there are more than enough of them."""
    n = train.count()
    want = min(most, max(least, round(n * ratio)))
    if n <= max(enough, want + 2):
        return train.withColumn("split", F.lit("train"))
    chosen = train.select(key).orderBy(*hash_order(key, seed)).limit(want).withColumn("_v", F.lit(True))
    return train.join(F.broadcast(chosen), key, "left").withColumn("split", F.when(F.col("_v"), "pseudo_val").otherwise("train")).drop("_v")


def overlapping_groups(records: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Groups that occur in more than one split: none, if the split is sound."""
    return records.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def manifest(records: DataFrame, key: str, split: str = "split") -> DataFrame:
    return records.groupBy(split).agg(F.count("*").alias("n_records"), F.count_distinct(key).alias("n_groups"))


def hard_subset(test: DataFrame, confidence: str | Column, n_cells: str | Column, label: str, few: int = 80) -> DataFrame:
    """Rows that aren't of high confidence, or of a small group, or whose label occurs once in test."""
    counts = test.groupBy(label).agg(F.count("*").alias("_n"))
    return test.join(counts, label).where((col(confidence) != "high") | (col(n_cells) < few) | (F.col("_n") <= 1)).drop("_n")


def rare_subset(test: DataFrame, everything: DataFrame, label: str, most: int = 3) -> DataFrame:
    """Rows of test whose label occurs at most `most` times in everything."""
    rare = everything.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select(label)
    return test.join(rare, label, "left_semi")


def unmapped_subset(test: DataFrame, known_id: str, status: str | Column, flag: str | Column) -> DataFrame:
    """Rows without an id, of status unmapped, or flagged."""
    return test.where((F.coalesce(F.col(known_id), F.lit("")) == "") | F.coalesce(col(status) == "unmapped", F.lit(False)) | F.coalesce(col(flag), F.lit(False)))


def stratified_sample(rows: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """rows with part test for a share of each class, by hash order, else train."""
    out = with_hash_rank(rows, key, seed, label)
    return out.withColumn("part", F.when(F.col("_k") <= F.ceil(F.col("_n") * share), "test").otherwise("train")).drop("_k", "_n")
