"""Coverage, label quality and error buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.scoring import ladder
from labelloom.functions.text import col, folded


def coverage(records: DataFrame, key: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """For each key the rows of each split, and whether training covers what is tested."""
    out = records.groupBy(key).agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits))
    train, rest = F.col(f"n_{splits[0]}"), sum((F.col(f"n_{s}") for s in splits[1:]), F.lit(0))
    status = F.when((train == 0) & (rest > 0), "zero_shot").when(train == 0, "absent").when(train == 1, "singleton").when(train <= 4, "rare").otherwise("covered")
    return out.withColumn("status", status).orderBy(F.desc(f"n_{splits[0]}"), key)


def seen_status(train_count: str | Column) -> Column:
    n = F.coalesce(col(train_count), F.lit(0))
    return F.when(n == 0, "zero_shot").when(n == 1, "singleton").when(n <= 4, "rare").otherwise("frequent")


def quality_bucket(score: str | Column, steps=((0.7, "high"), (0.5, "medium"), (0.3, "low"))) -> Column:
    return F.when(col(score).isNull(), "unknown").otherwise(ladder(score, steps, "very_low"))


def with_label_quality(df: DataFrame, label: str, id_: str, parent: str, labels: DataFrame, ids: DataFrame, parents: DataFrame) -> DataFrame:
    """df with label_ok, id_ok, parent_ok, issues and grade (clean, weak, noisy, invalid).

    labels (label), ids (id) and parents (label) are the valid ones: semi-joins as flags, not sets on the driver.
    """
    flag = lambda d, c, name: d.select(F.col(c).alias(f"_{name}")).distinct().withColumn(name, F.lit(True))
    rows = df.withColumn("_l", folded(label)).withColumn("_p", folded(parent)).withColumn("_i", F.coalesce(F.col(id_), F.lit("")))
    rows = rows.join(flag(labels, "label", "in_labels").withColumnRenamed("_in_labels", "_l"), "_l", "left")
    rows = rows.join(flag(ids, "id", "in_ids").withColumnRenamed("_in_ids", "_i"), "_i", "left")
    known_parents = labels.select("label").union(parents.select("label"))
    rows = rows.join(flag(known_parents, "label", "in_parents").withColumnRenamed("_in_parents", "_p"), "_p", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    form = F.col("_i").rlike(r"^CL:\d{7}$")
    label_ok, id_ok, parent_ok = (F.col("_l") != "") & yes("in_labels"), form & yes("in_ids"), (F.col("_p") != "") & yes("in_parents")
    issues = F.array_compact(F.array(
        F.when(F.col("_l") == "", "label_empty").when(~label_ok, "label_unknown"),
        F.when(F.col("_i") == "", "id_missing").when(~form, "id_malformed").when(~id_ok, "id_unknown"),
        F.when(F.col("_p") == "", "parent_missing").when(~parent_ok, "parent_unknown"),
    ))
    grade = F.when(F.col("_l") == "", "invalid").when(~label_ok & ~id_ok, "noisy").when(~id_ok | ~parent_ok, "weak").otherwise("clean")
    out = rows.withColumns({"label_ok": label_ok, "id_ok": id_ok, "parent_ok": parent_ok, "issues": issues, "grade": grade})
    return out.drop("_l", "_i", "_p", "in_labels", "in_ids", "in_parents")


def quality_summary(graded: DataFrame) -> DataFrame:
    """grade, n and share of all rows; nothing for an empty table."""
    n = graded.groupBy("grade").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("grade", "n", F.round(F.col("n") / F.col("_all"), 4).alias("rate"))


def verdict(gain: str | Column, strong: float = 0.1, weak: float = 0.02) -> Column:
    """What a difference of two rates says."""
    return F.when(col(gain) >= strong, "main_bottleneck").when(col(gain) >= weak, "minor_factor").when(col(gain) > -weak, "no_effect").otherwise("harmful")
