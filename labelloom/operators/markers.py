"""One-vs-rest statistics of features by label: detection shares, Welch t, rank sums, adjusted p, marker lists.

Input is a long table (cell, label, gene, value). Zeros may be left out where a function says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.scoring import listed_out, marker_quality, marker_score, negative_reason, positive_effect
from labelloom.functions.tails import normal_tail, student_tail
from labelloom.functions.text import finite
from labelloom.operators.order import least_of_each, placed
from labelloom.operators.sides import stored


def detected_genes(cells: DataFrame, least: int = 10) -> DataFrame:
    """Rows of genes that are positive in at least `least` cells."""
    keep = cells.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= least).select("gene")
    return cells.join(keep, "gene", "left_semi")


def depth_normalised(cells: DataFrame, total: float = 1e4, digits: int | None = None) -> DataFrame:
    """value over its cell's sum, times total, as ln(1 + x); a cell without counts gets 0."""
    depth = cells.groupBy("cell").agg(F.sum("value").alias("_depth"))
    x = F.ln(1 + F.coalesce(F.try_divide(F.col("value"), F.col("_depth")), F.lit(0.0)) * total)
    return cells.join(depth, "cell").withColumn("value", F.round(x, digits) if digits is not None else x).drop("_depth")


def downsampled(cells: DataFrame, label: str, key: str, most: int = 2_000, seed: int = 42) -> DataFrame:
    """At most `most` rows a label (null is one), those with the smallest md5 of seed and key; ties by all columns.

    A label of any size is spread over tasks: see order.least_of_each. md5 values are uniform, and their first eight
    digits are the unit.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return least_of_each(cells, label, F.struct(digest.alias("digest"), F.col(key), F.xxhash64(*(f"`{c}`" for c in cells.columns)).alias("all")), unit, most)


def group_sizes(cells: DataFrame) -> DataFrame:
    """label, n_in and n_out (cells with another label)."""
    n = cells.select("cell", "label").distinct().groupBy("label").agg(F.count("*").alias("n_in"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n_in").alias("_all")))).select("label", "n_in", (F.col("_all") - F.col("n_in")).alias("n_out"))


def detection(cells: DataFrame) -> DataFrame:
    """label, gene, pct_in and pct_out: shares of cells with a positive value, of the label and of the rest. Zeros may be left out."""
    by = cells.groupBy("label", "gene").agg(F.count_if(F.col("value") > 0).alias("n"))
    total = F.sum("n").over(Window.partitionBy("gene"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 4)
    out = by.withColumn("all", total).join(group_sizes(cells), "label")
    return out.select("label", "gene", share(F.col("n"), F.col("n_in")).alias("pct_in"), share(F.col("all") - F.col("n"), F.col("n_out")).alias("pct_out"))


def welch(cells: DataFrame) -> DataFrame:
    """label, gene, mean_in, mean_out, t and df by Welch, of the label's cells against the rest. Zeros must be there.

    One aggregation by label and gene; the rest is the gene's total less the label's sums.
    """
    by = cells.groupBy("label", "gene").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    return with_welch(by, ["gene"]).select("label", "gene", F.col("n").alias("n_in"), "n_out", "mean_in", "mean_out", "t", "df")


def with_welch(by: DataFrame, gene: list[str]) -> DataFrame:
    """by (label, the columns in gene, n, s and q: count, sum and sum of squares) with n_out, mean_in, mean_out, t and df."""
    w = Window.partitionBy(*gene)
    by = by.withColumns({f"{k}_out": F.sum(k).over(w) - F.col(k) for k in ("n", "s", "q")})
    var = lambda n, s, q: F.greatest(F.lit(0.0), F.try_divide(q - F.try_divide(s * s, n), n - 1))
    a = var(F.col("n"), F.col("s"), F.col("q")) / F.col("n")
    b = F.try_divide(var(F.col("n_out"), F.col("s_out"), F.col("q_out")), F.col("n_out"))
    by = by.withColumns({"mean_in": F.col("s") / F.col("n"), "mean_out": F.try_divide(F.col("s_out"), F.col("n_out")), "_a": a, "_b": b})
    t = F.try_divide(F.col("mean_in") - F.col("mean_out"), F.sqrt(F.col("_a") + F.col("_b")))
    df = F.try_divide(F.pow(F.col("_a") + F.col("_b"), 2), F.try_divide(F.col("_a") * F.col("_a"), F.col("n") - 1) + F.try_divide(F.col("_b") * F.col("_b"), F.col("n_out") - 1))
    return by.withColumn("t", t).withColumn("df", df).drop("_a", "_b", "s_out", "q_out")


def rank_sums(cells: DataFrame, tie_correction: bool = False, ranges: int = 64) -> DataFrame:
    """label, gene, rank_sum and z of the label's cells against the rest (normal approximation). Zeros must be there.

    Equal values are counted before they are ranked, so a hot value (zero) is one row, and values are ranked by ranges, so a
    gene of continuous values is spread over tasks. sparse.statistics has the same for rows without zeros.
    """
    return ranked_counts(stored(cells.groupBy("gene", "value", "label").agg(F.count("*").alias("n")), "counted"), ["gene"], tie_correction, ranges).select("label", "gene", "n1", "n", "rank_sum", "z")


def ranked_counts(by: DataFrame, gene: list[str], tie_correction: bool = False, ranges: int = 64) -> DataFrame:
    """label, the columns in gene, n1, n, rank_sum and z of counted values: value, label and n, of each gene's cells."""
    values = placed(by.groupBy(*gene, "value").agg(F.sum("n").alias("same")), gene, "value", "same", ranges)
    values = values.select(*gene, "value", "same", (F.col("before") + (F.col("same") + 1) / 2.0).alias("rank"))
    sums = by.join(values, [*gene, "value"]).groupBy("label", *gene).agg(F.sum("n").alias("n1"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"))
    total = values.groupBy(*gene).agg(F.sum("same").alias("n"), F.sum(F.pow("same", F.lit(3.0)) - F.col("same")).alias("ties"))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    spread = n1 * (n - n1) / 12.0 * ((n + 1) - (F.try_divide(F.col("ties"), n * (n - 1)) if tie_correction else 0.0))
    return sums.join(total, gene).withColumn("z", F.try_divide(F.col("rank_sum") - n1 * (n + 1) / 2.0, F.sqrt(spread))).drop("ties")


def with_p(df: DataFrame) -> DataFrame:
    """df with the two-sided p of its statistic: of t with df degrees of freedom where it has both, else of z."""
    return df.withColumn("p", student_tail("t", "df") if {"t", "df"} <= set(df.columns) else normal_tail("z"))


def differential(cells: DataFrame, method: str = "rank sums", tie_correction: bool = False, most: int = 50) -> DataFrame:
    """label, gene, statistic, p, p_adj and de_rank: the first `most` genes of each label against the rest.

    method: "rank sums" (normal approximation) or "t" (Welch). p is two-sided and adjusted over all genes of a label,
    before the cut; genes are ranked by the statistic, highest first, those without one last. Zeros must be there.
    """
    if method not in ("rank sums", "t"):
        raise ValueError(f"no such method: {method}")
    stats = welch(cells) if method == "t" else rank_sums(cells, tie_correction)
    stats = adjusted(with_p(stats).withColumnRenamed("t" if method == "t" else "z", "statistic"), "label")
    return ranked(stats.select("label", "gene", "statistic", "p", "p_adj"), F.col("statistic").desc_nulls_last(), most)


def adjusted(df: DataFrame, group: str, p: str = "p", key: str = "gene") -> DataFrame:
    """df with p_adj by Benjamini and Hochberg within each group."""
    up, down = Window.partitionBy(group).orderBy(p, key), Window.partitionBy(group).orderBy(F.desc(p), F.desc(key))
    m = F.count(p).over(Window.partitionBy(group))
    out = df.withColumn("_r", F.row_number().over(up)).withColumn("_m", m)
    low = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("p_adj", F.least(F.lit(1.0), low)).drop("_r", "_m")


def log_fold(mean_in: str, mean_out: str) -> Column:
    """log2 of the ratio of means before ln(1 + x)."""
    return F.log2((F.expm1(mean_in) + 1e-9) / (F.expm1(mean_out) + 1e-9))


def ranked(stats: DataFrame, order: Column, most: int = 50) -> DataFrame:
    """The first `most` genes of each label in the given order, with de_rank."""
    w = Window.partitionBy("label").orderBy(order, "gene")
    return stats.withColumn("de_rank", F.row_number().over(w)).where(F.col("de_rank") <= most)


def positive_markers(top: DataFrame, shares: DataFrame, k: int = 10) -> DataFrame:
    """Of ranked genes (label, gene, de_rank, lfc) the first k with a positive effect that aren't listed out, with score."""
    rows = top.where(positive_effect("lfc") & ~listed_out("gene"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("de_rank"))).where(F.col("rank") <= k)
    return rows.join(shares, ["label", "gene"], "left").withColumn("score", marker_score("lfc", "pct_in", "pct_out"))


def negative_markers(stats: DataFrame, shares: DataFrame, k: int = 5) -> DataFrame:
    """The k genes of each label with the lowest effect, none above 0, with the reason."""
    rows = stats.where(~listed_out("gene") & (F.coalesce(finite("lfc"), F.lit(0.0)) <= 0))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("lfc", "gene"))).where(F.col("rank") <= k)
    return rows.join(shares, ["label", "gene"], "left").withColumn("reason", negative_reason("lfc", "pct_in", "pct_out"))


def marker_records(markers: DataFrame, sizes: DataFrame, least: int = 1) -> DataFrame:
    """One row a label: markers as an array of structs in rank order, n_markers, mean score and quality; labels with fewer than `least` are left out."""
    item = F.struct("rank", "gene", "lfc", "pct_in", "pct_out", "score")
    by = markers.groupBy("label").agg(F.array_sort(F.collect_list(item)).alias("markers"), F.count("*").alias("n_markers"), F.avg("score").alias("mean_score"))
    return by.where(F.col("n_markers") >= least).join(sizes, "label").withColumn("quality", marker_quality("n_markers", "mean_score", "n_in"))
