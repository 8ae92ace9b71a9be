"""One-vs-rest statistics of sparse counts: zeros aren't rows, they follow from how many cells there are.

counts: a long table (cell, label, gene, value) of stored values, one row at most for each cell and gene; cells: one row
a cell (cell, label), with those that have no stored value at all. A stored zero or null counts like one that isn't
stored. by: columns of both tables that set apart independent datasets. Cells without a label belong to no
group and are left out, as are rows without a gene or dataset.

So the long table has as many rows as values are stored, and zeros add one row for each gene and label: their number is
the label's cells less its stored ones, all of one rank, between negative and positive values. Input with all zeros
stored gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators import markers
from labelloom.operators.order import same
from labelloom.operators.sides import sent, stored


def sizes(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, label, n_label and n_cells: cells of the label, and all cells with a label."""
    n = cells.where("label is not null").groupBy(*by, "label").agg(F.count_distinct("cell").alias("n_label"))
    return n.withColumn("n_cells", F.sum("n_label").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))


def with_zeros(counts: DataFrame, cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, label, gene, value and n: how many cells have the value, zeros counted by what is missing; every gene with every label of its dataset."""
    gene = [*by, "gene"]
    stored_ = counts.where("label is not null and value is not null and value <> 0").withColumn("value", F.col("value").cast("double"))
    counted = stored_.groupBy(*gene, "label", "value").agg(F.count("*").alias("n"))
    genes = counts.where("label is not null").select(*gene).distinct()
    groups = sent(sizes(cells, by).select(*by, "label", "n_label"))
    every = genes.join(groups, list(by)) if by else genes.crossJoin(groups)  # the result has a row for each
    held = counted.groupBy(*gene, "label").agg(F.sum("n").alias("_held"))
    zeros = every.join(held, [*gene, "label"], "left").select(*gene, "label", F.lit(0.0).alias("value"), (F.col("n_label") - F.coalesce("_held", F.lit(0))).alias("n"))
    return counted.unionByName(zeros.where("n > 0"))


def statistics(counts: DataFrame, cells: DataFrame, by: tuple[str, ...] = (), tie_correction: bool = False, ranges: int = 64) -> DataFrame:
    """by, label, gene, n_in, n_out, mean_in, mean_out, pct_in, pct_out, t, df, rank_sum and z of the label's cells against the rest.

    Values are counted once; moments, detection and ranks all come from these counts.
    """
    gene = [*by, "gene"]
    counted = stored(with_zeros(counts, cells, by), "counted")
    value, n = F.col("value"), F.col("n")
    sums = counted.groupBy("label", *gene).agg(F.sum("n").alias("n"), F.sum(value * n).alias("s"), F.sum(value * value * n).alias("q"), F.sum(F.when(value > 0, n).otherwise(0)).alias("k"))
    moments = markers.with_welch(sums, gene).withColumn("_k_out", F.sum("k").over(Window.partitionBy(*gene)) - F.col("k"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 4)
    ranks = markers.ranked_counts(counted, gene, tie_correction, ranges).select("label", *gene, "rank_sum", "z")
    met = moments.join(ranks, ["label", *gene])
    return met.select(*by, "label", "gene", F.col("n").alias("n_in"), "n_out", "mean_in", "mean_out", share("k", "n").alias("pct_in"), share("_k_out", "n_out").alias("pct_out"), "t", "df", "rank_sum", "z")


def differential(counts: DataFrame, cells: DataFrame, by: tuple[str, ...] = (), method: str = "rank sums", tie_correction: bool = False, most: int = 50) -> DataFrame:
    """by, label, gene, statistic, p, p_adj, lfc, pct_in, pct_out and de_rank: the first `most` genes of each label against the rest.

    As markers.differential, with the effect (log2 of the ratio of means before ln(1 + x)) and detection shares beside
    it. A label with all cells of its dataset, or a gene without spread, has no statistic, and comes last.
    """
    if method not in ("rank sums", "t"):
        raise ValueError(f"no such method: {method}")
    stats = statistics(counts, cells, by, tie_correction)
    stats = markers.with_p(stats if method == "t" else stats.drop("t", "df")).withColumnRenamed("t" if method == "t" else "z", "statistic")
    stats = stats.withColumn("_group", F.struct(*by, "label")).withColumn("lfc", markers.log_fold("mean_in", "mean_out"))
    stats = markers.adjusted(stats, "_group")
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(F.col("statistic").desc_nulls_last(), "gene"))
    return stats.withColumn("de_rank", rank).where(F.col("de_rank") <= most).select(*by, "label", "gene", "statistic", "p", "p_adj", "lfc", "pct_in", "pct_out", "de_rank")


def depth_normalised(counts: DataFrame, by: tuple[str, ...] = (), total: float = 1e4, digits: int | None = None) -> DataFrame:
    """value over its cell's stored sum, times total, as ln(1 + x); zeros stay zeros, so nothing is added. Cells whose values sum to nothing get 0."""
    depth = counts.groupBy(*(F.col(c).alias(f"_d_{c}") for c in [*by, "cell"])).agg(F.sum("value").alias("_depth"))
    x = F.ln(1 + F.coalesce(F.try_divide(F.col("value"), F.col("_depth")), F.lit(0.0)) * total)
    met = counts.join(depth, same([*by, "cell"], "_d_"))
    return met.withColumn("value", F.round(x, digits) if digits is not None else x).select(*counts.columns)


def detected_genes(counts: DataFrame, by: tuple[str, ...] = (), least: int = 10) -> DataFrame:
    """Rows of genes that are positive in at least `least` cells of their dataset."""
    gene = [*by, "gene"]
    keep = counts.groupBy(*(F.col(c).alias(f"_k_{c}") for c in gene)).agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= least).drop("n")
    return counts.join(keep, same(gene, "_k_"), "left_semi")


def candidates(counts: DataFrame, cells: DataFrame, by: tuple[str, ...] = (), most_cells: int = 2_000, least_cells: int = 10, method: str = "rank sums", most: int = 50, seed: int = 42) -> DataFrame:
    """The whole way from raw sparse counts to candidate markers: cells with a label, at most most_cells of each, genes
    seen in at least least_cells of them, values by depth, and the first genes of each label as `differential` gives them."""
    labelled = cells.where("label is not null")
    labelled = labelled.withColumn("_group", F.struct(*by, "label"))
    kept = stored(markers.downsampled(labelled, "_group", "cell", most_cells, seed).drop("_group"), "cells")
    own = [*by, "cell"]
    rows = counts.join(kept.select(*(F.col(c).alias(f"_c_{c}") for c in own)).distinct(), same(own, "_c_"), "left_semi")
    rows = depth_normalised(detected_genes(rows, by, least_cells), by)
    return differential(rows, kept, by, method, most=most)
