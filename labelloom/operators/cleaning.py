"""Cleaning of labelled rows: alias lookup, status, target labels, frequency filters, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.labels import ambiguous, label_status, leaf_or_broad
from labelloom.functions.text import canonical_label, col, first_filled, label_text
from labelloom.operators.sides import small


def alias_index(aliases: DataFrame, order: str = "ord") -> DataFrame:
    """aliases (raw_label, normalized_label, id, parent_label, notes, order) with one row a key: the last one wins."""
    filled = aliases.na.fill("").withColumn("key", label_text("raw_label")).where("key is not null")
    value = F.struct("normalized_label", "id", "parent_label", "notes")
    return filled.groupBy("key").agg(F.max_by(value, order).alias("v")).select("key", "v.*")


def mapped_labels(df: DataFrame, label: str, aliases: DataFrame) -> DataFrame:
    """df with clean label, id, ontology label, parent, status and level of its label column.

    The distinct labels are looked up, not the rows; the result is joined back.
    """
    known = alias_index(aliases)
    found = df.select(label).distinct().withColumn("_clean", label_text(label)).join(small(known), F.col("_clean") == F.col("key"), "left")
    id_, parent = F.nullif("id", F.lit("")), F.nullif("parent_label", F.lit(""))
    found = found.select(
        F.col(label).alias("_label"), F.col("_clean").alias("clean_label"), id_.alias("ontology_id"),
        F.coalesce("normalized_label", "_clean").alias("ontology_label"), parent.alias("parent_label"),
        label_status("_clean", id_, F.col("key").isNotNull(), "notes").alias("status"),
        F.when(F.col("_clean").isNotNull(), leaf_or_broad(parent)).alias("level"),
    )
    return df.join(found, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def unambiguous(df: DataFrame, label: str) -> DataFrame:
    """Rows with a label that names a class."""
    return df.where(F.col(label).isNotNull() & ~ambiguous(label))


def frequent_labels(df: DataFrame, label: str, least: int = 50) -> DataFrame:
    """Rows whose label occurs at least `least` times: partial counts, then a semi-join with the labels that stay."""
    keep = df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(label)
    return df.join(keep, label, "left_semi")


def target_label(mode: str, ontology: str | Column, parent: str | Column, clean: str | Column, to_parent: bool = True, to_clean: bool = True) -> Column:
    """The label to learn: the ontology label, then the parent and the clean source label if allowed."""
    order = [clean] if mode == "source" else [ontology, *([parent] if to_parent else []), *([clean] if to_clean else [])]
    return first_filled(*order)


def mapped_ratio_gate(df: DataFrame, group: str, known_id: str, least: float) -> DataFrame:
    """Rows of groups in which the share of known ids is at least `least`."""
    keep = df.groupBy(group).agg(F.avg(F.col(known_id).isNotNull().cast("double")).alias("r")).where(F.col("r") >= least)
    return df.join(keep.select(group), group, "left_semi")


def frequency_table(df: DataFrame, label: str, null_as: str = "nan") -> DataFrame:
    """Labels with their counts, most frequent first; nulls under null_as."""
    return df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit(null_as)).alias(label)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def dominant(df: DataFrame, group: str, value: str, default: str = "unknown") -> DataFrame:
    """The most frequent non-null value of each group; ties to the smaller value, default without any."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    rank = Window.partitionBy(group).orderBy(F.col(value).isNull(), F.desc("n"), F.col(value))
    return counts.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(group, F.coalesce(F.col(value).cast("string"), F.lit(default)).alias(value))


def profile(df: DataFrame, group: str, kind: str, tissue: str, disease: str, known_id: str | None = None, quality: str | None = None) -> DataFrame:
    """For each group: rows, distinct kinds, main tissue and disease, and share of known ids and mean quality if asked."""
    aggs = [F.count("*").alias("n_records"), F.count_distinct(kind).alias("n_types")]
    if known_id:
        aggs += [F.count(known_id).alias("n_mapped"), F.round(F.count(known_id) / F.count("*"), 4).alias("mapped_ratio")]
    if quality:
        aggs.append(F.round(F.avg(quality), 4).alias("mean_quality"))
    out = df.groupBy(group).agg(*aggs)
    for c in (tissue, disease):
        out = out.join(dominant(df, group, c).withColumnRenamed(c, f"main_{c}"), group)
    return out.orderBy(f"main_{tissue}", F.desc("n_types"), F.desc("n_records"), group)


def mapping_stats(df: DataFrame, known_id: str, label: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.count(known_id).alias("n_mapped"), F.round(F.try_divide(F.count(known_id), F.count("*")), 4).alias("mapped_ratio"),
        F.count_distinct(label).alias("n_labels"), F.count_distinct(known_id).alias("n_ids"))


def rewritten_labels(df: DataFrame, label: str, fixes: DataFrame) -> DataFrame:
    """df without the rows whose label fixes drops, and with the labels, ids and parents that it sets.

    fixes: key, action (FIX or DROP), canonical_label, id, parent_label, ord; of rows with one key the last counts.
    """
    last = fixes.groupBy(canonical_label("key").alias("_key")).agg(F.max_by(F.struct("action", "canonical_label", "id", "parent_label"), "ord").alias("fix"))
    met = df.join(small(last), canonical_label(label) == F.col("_key"), "left")
    kept = met.where(F.coalesce(F.col("fix.action"), F.lit("")) != "DROP")
    return kept.withColumn("fixed_label", F.coalesce("fix.canonical_label", label)).withColumn("fixed_id", F.col("fix.id")).withColumn("was_fixed", F.col("fix").isNotNull()).drop("fix", "_key")


def clean_status(n_before: str | Column, n_after: str | Column, n_types: str | Column) -> Column:
    """Why a dataset is skipped, or ok."""
    return F.when(col(n_before) == 0, "skipped_empty").when(col(n_after) == 0, "skipped_no_rows_left").when(col(n_types) < 2, "skipped_one_label").otherwise("ok")
