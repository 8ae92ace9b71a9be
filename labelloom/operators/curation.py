"""Selecting datasets by their metadata: statistics, guardrails, scores and balanced selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import col, folded, has_any, token_count, truth
from labelloom.operators.sides import small
from labelloom.sources.files import scratch


@dataclass(frozen=True)
class Curation:
    """Thresholds, word lists and weights of dataset selection. All defaults."""

    least_rows: int = 3_000
    most_rows: int = 350_000
    least_types: int = 6
    normal_only: bool = False
    most_tissues: int | None = 3
    most_diseases: int | None = 2
    exclude_diseases: tuple[str, ...] = ("covid", "cancer", "tumor", "tumour", "glioblastoma", "leukemia", "leukaemia", "adenoma", "carcinoma", "lymphoma", "melanoma", "sarcoma")
    exclude_titles: tuple[str, ...] = ("covid", "tumor", "cancer", "glioblastoma", "leukemia", "crispr", "perturbation")
    exclude_collections: tuple[str, ...] = ("covid", "tumor", "cancer")
    prefer: tuple[str, ...] = ("atlas", "reference", "census", "landscape", "survey", "map", "compendium")
    weights: dict[str, float] = field(default_factory=lambda: {"celltype": 1.0, "cells": 0.6, "single_tissue": 0.8, "low_disease_mix": 0.8, "reference": 0.5})
    per_tissue: int = 15
    least_selected: int = 60
    most_selected: int = 150


def primary_rows(obs: DataFrame, flag: str = "is_primary_data") -> DataFrame:
    """Rows whose flag is true, as a boolean or as text."""
    return obs.where(F.coalesce(truth(F.col(flag).cast("string")), F.lit(False)))


def partial_stats(obs: DataFrame, group: str, part: str, kind: str, tissue: str, disease: str, disease_chars: int | None = None) -> DataFrame:
    """For each group and part: rows, distinct kinds, and sorted distinct tissues and diseases as arrays.

    disease_chars: cut the joined diseases to so many characters before they are split again.
    Rows are counted by all five columns first: a hot group is spread over many keys, and sets see each value once.
    """
    distinct = lambda c: F.array_sort(F.collect_set(c))
    diseases = distinct(disease)
    if disease_chars:
        diseases = F.filter(F.split(F.substring(F.array_join(diseases, ";"), 1, disease_chars), ";"), lambda x: F.trim(x) != "")
    seen = obs.groupBy(group, part, kind, tissue, disease).agg(F.count("*").alias("_n"))
    return seen.groupBy(group, part).agg(
        F.sum("_n").alias("n_rows"), F.count_distinct(kind).alias("n_types"), distinct(tissue).alias("tissues"), diseases.alias("diseases"))


def merged_stats(parts: DataFrame, group: str, part: str | None = None) -> DataFrame:
    """For each group over its parts: rows summed, the largest number of kinds, and the union of tissues and of diseases.

    part: the column that names the parts, for a sorted array of them (parts).
    """
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    names = [F.array_sort(F.collect_set(part)).alias("parts")] if part else []
    return parts.groupBy(group).agg(
        F.sum("n_rows").alias("n_rows"), F.max("n_types").alias("n_types"), union("tissues").alias("tissues"), union("diseases").alias("diseases"), *names)


def within_thresholds(rows: str | Column, types: str | Column, cfg: Curation = Curation()) -> Column:
    return col(rows).between(cfg.least_rows, cfg.most_rows) & (col(types) >= cfg.least_types)


def guardrail(diseases: str | Column, n_tissues: str | Column, n_diseases: str | Column, title: str | Column, collection: str | Column, cfg: Curation = Curation()) -> Column:
    """Whether a dataset's metadata pass all rules; nulls pass, but not where only normal ones may."""
    ok = ~has_any(diseases, cfg.exclude_diseases) & ~has_any(title, cfg.exclude_titles) & ~has_any(collection, cfg.exclude_collections)
    if cfg.normal_only:
        ok = ok & folded(diseases).isin("normal", "healthy")
    for n, most in ((n_tissues, cfg.most_tissues), (n_diseases, cfg.most_diseases)):
        if most is not None:
            ok = ok & (F.coalesce(col(n).cast("int"), F.lit(0)) <= most)
    return ok


def reference_preference(title: str | Column, collection: str | Column, cfg: Curation = Curation()) -> Column:
    """1 if a preferred word stands in title or collection, else 0."""
    return has_any(F.concat_ws(" ", title, collection), cfg.prefer).cast("double")


def min_max(c: str | Column, over: Window | None = None) -> Column:
    """c between its least (0) and largest (1) value; 1 where all are equal, 0 where all are null."""
    w = over or Window.partitionBy(F.lit(0))
    lo, hi = F.min(col(c).cast("double")).over(w), F.max(col(c).cast("double")).over(w)
    return F.when(lo.isNull(), 0.0).when(lo == hi, 1.0).otherwise((col(c) - lo) / (hi - lo))


def with_scores(stats: DataFrame, cfg: Curation = Curation()) -> DataFrame:
    """stats (dataset rows with n_types, n_rows, n_tissues, n_diseases, title, collection) with part scores and auto_score.

    Extremes come from one aggregation joined back, so no window gathers all datasets in a task.
    """
    names = ("n_types", "n_rows", "n_tissues", "n_diseases")
    ends = stats.agg(*(f(F.col(n).cast("double")).alias(f"_{n}_{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max))))
    out = stats.crossJoin(F.broadcast(ends))  # one row
    scaled = lambda n: F.when(F.col(f"_{n}_lo").isNull(), 0.0).when(F.col(f"_{n}_lo") == F.col(f"_{n}_hi"), 1.0).otherwise((F.col(n) - F.col(f"_{n}_lo")) / (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")))
    scores = {
        "celltype": scaled("n_types"), "cells": scaled("n_rows"), "single_tissue": 1 - scaled("n_tissues"),
        "low_disease_mix": 1 - scaled("n_diseases"), "reference": reference_preference("title", "collection", cfg),
    }
    out = out.withColumns({f"score_{k}": v for k, v in scores.items()}).drop(*ends.columns)
    return out.withColumn("auto_score", sum((F.lit(cfg.weights[k]) * F.col(f"score_{k}") for k in scores), F.lit(0.0)))


def best_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def top_per_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def balanced_selection(scored: DataFrame, key: str, tissues: str, targets: list[str], cfg: Curation = Curation(), *order: Column) -> DataFrame:
    """The best of each target tissue, filled up to cfg.least_selected with the best others, cut to cfg.most_selected.

    scored: one row a dataset with an array of tissues. Adds selected_reason and matched_tissues (empty for fill-ups).
    One pass: ranks within targets, then a sort with a limit that surely holds all that can be selected; how many
    fill-ups are needed is decided on those few rows.
    """
    order = order or (F.desc("auto_score"), F.desc("n_types"), F.desc("n_rows"), F.col(key).asc())
    target = F.explode_outer(F.array_intersect(F.col(tissues), F.array(*map(F.lit, targets)))).alias("_target")
    rank = F.row_number().over(Window.partitionBy("_target").orderBy(*order))
    ranked = scored.select("*", target).withColumn("_top", F.col("_target").isNotNull() & (rank <= cfg.per_tissue))
    matched = F.array_sort(F.collect_set(F.when(F.col("_top"), F.col("_target"))))
    rows = ranked.groupBy(key).agg(F.any_value(F.struct(*scored.columns)).alias("_row"), matched.alias("matched_tissues")).select("_row.*", "matched_tissues")
    rows = rows.withColumn("_top", F.size("matched_tissues") > 0)
    few = rows.orderBy(F.desc("_top"), *order).limit(len(targets) * cfg.per_tissue + cfg.least_selected)
    place = F.row_number().over(Window.orderBy(F.desc("_top"), *order))  # of these few rows
    kept = few.withColumn("_place", place).where(F.col("_top") | (F.col("_place") <= cfg.least_selected))
    reason = F.when(F.col("_top"), "top_of_tissue").otherwise("fill_up")
    return kept.withColumn("selected_reason", reason).drop("_top", "_place").orderBy(*order).limit(cfg.most_selected)


def template_selection(scored: DataFrame, key: str, tissues: str, targets: list[str], k: int = 2, fallback: int = 5, *order: Column) -> DataFrame:
    """The k best of each target tissue; if there is none, the first `fallback` rows."""
    order = order or (F.desc("n_types"), F.desc("n_rows"), F.col(key).asc())
    met = scored.withColumn("_target", F.explode(F.array_intersect(F.col(tissues), F.array(*map(F.lit, targets)))))
    top = top_per_group(met, "_target", k, *order).select(key).distinct()
    found = scored.join(top, key, "left_semi")
    return found if not top.isEmpty() else scored.orderBy(*order).limit(fallback)


def with_token_counts(df: DataFrame, **columns: str) -> DataFrame:
    """df with a count of the ;-separated parts of each column: new name = column."""
    return df.withColumns({new: token_count(c) for new, c in columns.items()})


def placed(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with each row's place, from 1, in the given order.

    Rows are sorted in ranges and written, so each knows its part and its row in it; places follow from the parts'
    counts, one row a part, which are all that one window sees.
    """
    path = scratch(df.sparkSession, "placed")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(small(parts), "_part").withColumn("place", place).drop("_part", "_at", "_before")
