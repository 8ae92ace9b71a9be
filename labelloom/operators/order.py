"""Places and selections within groups that may be as large as the table: no task holds a whole group.

A group's values are cut into ranges at approximate percentiles, which are sketches that merge; counts of the ranges tell
where each begins, and only values of one range meet in a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.sides import sent, stored


def _cut(rows: DataFrame, group: list[str], value: str, ranges: int) -> DataFrame:
    """group and _cuts: about `ranges` percentiles of each group's values, each once."""
    shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    return rows.groupBy(*group).agg(F.array_distinct(F.percentile_approx(value, shares, F.lit(10 * ranges))).alias("_cuts"))


def _upto(rows: DataFrame, value: str, name: str, ranges: int) -> DataFrame:
    """rows with name: how many of _cuts are at most the value. A binary search in steps that are compiled, each a column
    of its own; a lambda over the cuts runs for each of them, and copies them for each row."""
    rows = rows.withColumn(name, F.lit(0))
    for k in reversed(range((ranges - 1).bit_length())):
        rows = rows.withColumn(name, F.when(F.get("_cuts", F.col(name) + F.lit((1 << k) - 1)) <= F.col(value), F.col(name) + F.lit(1 << k)).otherwise(F.col(name)))
    return rows


def _ranged(rows: DataFrame, group: list[str], value: str, ranges: int) -> DataFrame:
    """rows with _range, by percentiles of the group's values: twice those below the value, and one more for a percentile
    itself, so a hot value is a range of its own and each cut tells values apart. Cuts are sent if they are few."""
    cuts = _cut(rows, group, value, ranges).select(*(F.col(c).alias(f"_cut_{c}") for c in group), "_cuts")
    met = rows.join(sent(cuts), same(group, "_cut_"), "left")
    met = _upto(met, value, "_at", ranges)
    met = met.withColumn("_range", F.col("_at") * 2 - F.when(F.get("_cuts", F.col("_at") - 1) == F.col(value), 1).otherwise(0)).drop("_at")
    return met.drop("_cuts", *(f"_cut_{c}" for c in group))


def same(columns: list[str], prefix: str) -> Column:
    """Whether columns equal those named with a prefix; nulls equal nulls."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in columns))


def _before(n: str, keys: list[str], order: str) -> Column:
    """The sum of n over the rows that come before, in the window of keys."""
    return F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(values: DataFrame, group: list[str], value: str, n: str, ranges: int = 64) -> DataFrame:
    """values (distinct in each group, n times each) with before: how many rows of the group have smaller values.

    Groups with a null are left out, so that joins and windows share one partitioning. Cuts are approximate, and made again
    they may differ: they are stored, as rows and the starts of their ranges must be cut alike. So values are read twice.
    """
    rows = _upto(values.join(stored(_cut(values, group, value, ranges), "cuts"), group), value, "_range", ranges).drop("_cuts")
    starts = rows.groupBy(*group, "_range").agg(F.sum(n).alias("_all")).select(*group, "_range", _before("_all", group, "_range").alias("_start"))
    rows = rows.withColumn("_inner", _before(n, [*group, "_range"], value)).join(starts, [*group, "_range"])
    return rows.withColumn("before", F.col("_start") + F.col("_inner")).drop("_start", "_inner", "_range")


def nearest_percentiles(df: DataFrame, group: str, value: str, shares=(0.5, 0.95, 0.99), most: int = 1_000_000, ranges: int = 256) -> DataFrame:
    """For each group (null is one) n, the values at positions floor(n * share) of its sorted values, from 0, and the largest.

    Nulls count in n and come first; a position among them has the least value. Groups of up to `most` rows are counted
    by value and sorted. In larger ones positions are sought by ranges: counts tell which range holds each, the others
    are left out, and what stays is cut again until a range has at most `most` rows or one value. So each round reads
    what the last one left, and no window holds a large group.
    """
    names = [f"p{round(q * 100)}" for q in shares]
    size = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if size <= most:
        w = Window.partitionBy(group)
        by = df.groupBy(group, value).agg(F.count("*").alias("_same"))
        by = by.withColumn("_end", F.sum("_same").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_same").over(w))
        at = (F.min(F.when(F.col("_end") > F.floor(F.col("_n") * q), F.col(value))).alias(name) for q, name in zip(shares, names, strict=True))
        return by.groupBy(group).agg(F.sum("_same").alias("n"), *at, F.max(value).alias("largest"))
    totals = stored(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"), F.count(value).alias("_known"), F.max(value).alias("largest")), "totals")
    rows = df.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    at = F.array(*(F.struct(F.lit(k).alias("k"), F.greatest(F.lit(0), F.floor(F.col("n") * q) - (F.col("n") - F.col("_known"))).alias("at")) for k, q in enumerate(shares)))
    wanted = totals.where("_known > 0").select("_g", F.explode(at).alias("w")).select("_g", F.array().cast("array<int>").alias("_path"), "w.k", "w.at")
    rows = rows.withColumn("_path", F.array().cast("array<int>"))
    size = totals.agg(F.max("_known")).first()[0] or 0
    while size > most:
        ranged = _ranged(rows, ["_g", "_path"], "_v", ranges).groupBy("_g", F.col("_path").alias("_upper"), "_range")
        counts = stored(ranged.agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "ranges")
        counts = counts.withColumn("_path", F.concat("_upper", F.array("_range"))).withColumn("_start", _before("_n", ["_g", "_upper"], "_range"))
        met = counts.join(wanted.select(F.col("_g").alias("_wg"), F.col("_path").alias("_w_upper"), "k", "at"), F.col("_g").eqNullSafe(F.col("_wg")) & (F.col("_upper") == F.col("_w_upper")))
        met = stored(met.where("at >= _start and at < _start + _n").select("_g", "_upper", "_path", "k", (F.col("at") - F.col("_start")).alias("at"), "_n", "_low", "_high"), "wanted")
        wanted = met.select("_g", "_path", "k", "at")
        held = sent(met.select(F.col("_g").alias("_hg"), "_upper", F.col("_path").alias("_h_path"), "_low", "_high").distinct())
        within = F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_path") == F.col("_upper")) & F.col("_v").between(F.col("_low"), F.col("_high"))  # a value lies in one range
        rows = stored(rows.join(held, within).select("_g", F.col("_h_path").alias("_path"), "_v"), "held")
        size = met.where("_low < _high").agg(F.max("_n")).first()[0] or 0
    by = rows.groupBy("_g", "_path", "_v").agg(F.count("*").alias("_n"))
    by = by.withColumn("_end", F.sum("_n").over(Window.partitionBy("_g", "_path").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_begin", F.col("_end") - F.col("_n"))
    met = wanted.join(by.select(F.col("_g").alias("_vg"), F.col("_path").alias("_v_path"), "_v", "_begin", "_end"), F.col("_g").eqNullSafe(F.col("_vg")) & (F.col("_path") == F.col("_v_path")))
    found = met.where("at >= _begin and at < _end").groupBy(F.col("_g").alias("_of")).agg(*(F.max(F.when(F.col("k") == k, F.col("_v"))).alias(name) for k, name in enumerate(names)))
    out = totals.join(found, F.col("_g").eqNullSafe(F.col("_of")), "left")
    return out.select(F.col("_g").alias(group), "n", *names, "largest")


def value_sketches(df: DataFrame, keys: list[str], value: str, size: int = 1_000) -> DataFrame:
    """keys and a quantile sketch of each group's values (nulls left out), which can be kept and merged later."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, group: str, shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """group, n and the values near the same positions as nearest_percentiles, by merging sketches of any parts: one pass
    over the rows, places right within about one in a hundred."""
    merged = sketches.groupBy(group).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    at = {f"p{round(q * 100)}": F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_s", F.lit(q))) for q in shares}
    rows = merged.select(group, "_s", F.kll_sketch_get_n_double("_s").alias("n"))
    return rows.select(group, "n", *(c.alias(name) for name, c in at.items()))


def least_of_each(df: DataFrame, group: str, order: Column, unit: Column, most: int, salts: int = 64) -> DataFrame:
    """The `most` rows of each group that come first in `order`; unit: a number in [0, 1), uniform, that order begins with.

    Groups are counted; of a group of n rows only those with a unit below (most and a margin) / n stay, which are enough
    but for a chance of about one in 10^20. Groups that did keep too few (units that repeat) stay whole. What stays is cut
    within salted parts of its group and then in the group, so a window holds a part of a group or `most` rows a salt.
    """
    n = stored(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")), "sizes")
    upper = F.least(F.lit(1.0), (most + 10 * F.sqrt(F.lit(float(most))) + 100) / F.col("_n"))
    rows = df.withColumns({"_unit": unit, "_order": order}).join(sent(n.select("_g", "_n", upper.alias("_upper"))), F.col(group).eqNullSafe(F.col("_g")))
    kept = rows.where("_unit < _upper")
    enough = kept.groupBy("_g").agg(F.count("*").alias("_k"), F.max("_n").alias("_n"))
    few = stored(n.select(F.col("_g").alias("_f"), F.col("_n").alias("_all")).join(enough.select("_g", "_k"), F.col("_f").eqNullSafe(F.col("_g")), "left").where(F.coalesce("_k", F.lit(0)) < F.least("_all", F.lit(most))).select("_f", F.lit(True).alias("_whole")), "few")
    if not few.isEmpty():
        kept = rows.join(sent(few), F.col("_g").eqNullSafe(F.col("_f")), "left").where("_unit < _upper or _whole").drop("_f", "_whole")
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))
    kept = kept.withColumn("_salt", F.pmod(F.xxhash64(*(f"`{c}`" for c in df.columns)), F.lit(salts))).withColumn("_nth", nth("_g", "_salt")).where(F.col("_nth") <= most)
    kept = kept.withColumn("_nth", nth("_g")).where(F.col("_nth") <= most)
    return kept.select(*(f"`{c}`" for c in df.columns))
