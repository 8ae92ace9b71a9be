"""Parent edges: merging, ancestors to a given depth, compatibility of two labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import plain_label
from labelloom.operators.sides import stored


def merged_edges(*sources: DataFrame) -> DataFrame:
    """child and parent from several edge tables (child, parent, ord): of a child's edges the last of the last table counts."""
    rows = None
    for k, df in enumerate(sources):
        part = df.select(plain_label("child").alias("child"), plain_label("parent").alias("parent"), F.lit(k).alias("k"), "ord").where((F.col("child") != "") & (F.col("parent") != ""))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("child").agg(F.max_by("parent", F.struct("k", "ord")).alias("parent"))


def edges_of_map(document: DataFrame, column: str = "json") -> DataFrame:
    """child, parent and ord of a JSON object in a column; names that begin with _ are comments."""
    return document.select(F.posexplode(F.map_entries(F.from_json(column, "map<string,string>"))).alias("ord", "e")).where(~F.col("e.key").startswith("_")).select(F.col("e.key").alias("child"), F.col("e.value").alias("parent"), "ord")


def ancestors(edges: DataFrame, depth: int = 3) -> DataFrame:
    """label, ancestor and level (1 up to depth); a label that is its own ancestor ends its chain.

    Up to four levels are as many joins. Beyond, chains double: what is reached in up to m steps is joined with what lies
    m steps up, so 2 m steps are reached, and a depth of d takes about log d joins. It ends early when no chain goes on.
    """
    step = edges.where("child <> parent")
    reached = step.select(F.col("child").alias("label"), F.col("parent").alias("ancestor"), F.lit(1).alias("level"))
    if depth <= 4:
        last = reached
        for level in range(2, depth + 1):
            last = last.join(step, F.col("ancestor") == F.col("child")).select("label", F.col("parent").alias("ancestor"), F.lit(level).alias("level")).where("label <> ancestor")
            reached = reached.union(last)
        return reached.groupBy("label", "ancestor").agg(F.min("level").alias("level"))
    steps = 1
    while steps < depth:
        reached = stored(reached, "reached") if steps > 2 else reached
        last = reached.where(F.col("level") == steps).select(F.col("label").alias("_label"), F.col("ancestor").alias("_by"))
        if steps > 2 and last.isEmpty():
            break
        further = last.join(reached, F.col("_by") == F.col("label")).select(F.col("_label").alias("label"), "ancestor", (F.col("level") + steps).alias("level"))
        # a chain that came back to its label ends there, whatever lies behind
        ends = further.where("label = ancestor").groupBy(F.col("label").alias("_own")).agg(F.min("level").alias("_end"))
        further = further.join(ends, F.col("label") == F.col("_own"), "left").where(F.col("_end").isNull() | (F.col("level") < F.col("_end"))).drop("_own", "_end")
        reached = reached.unionByName(further.where(F.col("level") <= depth))
        steps *= 2
    return reached.groupBy("label", "ancestor").agg(F.min("level").alias("level"))


def intervals(edges: DataFrame, most_depth: int = 64) -> DataFrame:
    """label, first, last and level of each label of the trees that edges make: a label's descendants are those whose
    first lies in [first, last], at deeper levels. Labels on a cycle, below one, or deeper than most_depth are left out.

    Numbers are places in an order where each label stands before what is below it: sizes are counts of descendants, and a
    label's place is the sum, along its ancestors, of what stands before each among its siblings.
    """
    step = edges.where("child <> parent").select("child", "parent")
    up = stored(ancestors(step, most_depth + 1), "closure")
    nodes = step.select(F.col("child").alias("label")).union(step.select("parent")).distinct()
    tops = step.join(step.select(F.col("child").alias("_known")), F.col("parent") == F.col("_known"), "left_anti").select(F.col("parent").alias("label")).distinct()
    rooted = up.join(tops.select(F.col("label").alias("_top")), F.col("ancestor") == F.col("_top"), "left_semi").where(F.col("level") <= most_depth)
    depth = tops.select("label", F.lit(0).alias("level"), F.col("label").alias("top")).unionByName(rooted.select("label", "level", F.col("ancestor").alias("top")))
    sizes = up.join(depth.select(F.col("label").alias("_in")), F.col("label") == F.col("_in"), "left_semi").groupBy(F.col("ancestor").alias("_of")).agg(F.count("*").alias("_below"))
    size = stored(nodes.join(depth, "label").join(sizes, F.col("label") == F.col("_of"), "left").join(step, F.col("label") == F.col("child"), "left").select("label", "level", "top", "parent", (F.coalesce("_below", F.lit(0)) + 1).alias("size")), "sizes")
    siblings = Window.partitionBy("parent").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    before = size.where("parent is not null").withColumn("_before", 1 + F.coalesce(F.sum("size").over(siblings), F.lit(0))).select(F.col("label").alias("_at"), "_before")
    roots = size.where("parent is null").withColumn("_before", F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a tree
    before = stored(before.unionByName(roots.select(F.col("label").alias("_at"), "_before")), "before")
    path = up.select("label", "ancestor").unionByName(nodes.select("label", F.col("label").alias("ancestor")))
    first = path.join(before, F.col("ancestor") == F.col("_at")).groupBy("label").agg(F.sum("_before").alias("first"))
    return size.join(first, "label").select("label", "first", (F.col("first") + F.col("size") - 1).alias("last"), "level")


def with_compatibility_by_range(pairs: DataFrame, ranges: DataFrame, pred: str = "pred", gold: str = "gold", depth: int = 3) -> DataFrame:
    """As with_compatibility, for labels of trees: one range test on intervals(edges) instead of a table of all ancestors.

    depth: how many levels apart an ancestor may be. Labels without an interval are compatible only with themselves.
    """
    rows = pairs.withColumn("_p", plain_label(pred)).withColumn("_g", plain_label(gold))
    of = lambda x: ranges.select(F.col("label").alias(f"_{x}"), *(F.col(c).alias(f"_{x}_{c}") for c in ("first", "last", "level")))
    met = rows.join(of("p"), "_p", "left").join(of("g"), "_g", "left")
    above = lambda a, b: F.col(f"_{b}_first").between(F.col(f"_{a}_first"), F.col(f"_{a}_last")) & (F.col(f"_{b}_level") - F.col(f"_{a}_level")).between(1, depth)
    kind = F.when(F.col("_p") == F.col("_g"), "exact").when(above("p", "g"), "pred_is_parent").when(above("g", "p"), "pred_is_child").otherwise("incompatible")
    met = met.withColumn("compat_type", kind).withColumn("compatible", F.col("compat_type") != "incompatible")
    return met.select(*pairs.columns, "compat_type", "compatible")


def with_compatibility(pairs: DataFrame, closure: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """pairs with compat_type (exact, pred_is_parent, pred_is_child, incompatible) and compatible. Two empty labels are exact."""
    rows = pairs.withColumn("_p", plain_label(pred)).withColumn("_g", plain_label(gold))
    up = closure.select(F.col("label").alias("_g"), F.col("ancestor").alias("_p"), F.lit(True).alias("_parent"))
    down = closure.select(F.col("label").alias("_p"), F.col("ancestor").alias("_g"), F.lit(True).alias("_child"))
    met = rows.join(up, ["_p", "_g"], "left").join(down, ["_p", "_g"], "left")
    kind = F.when(F.col("_p") == F.col("_g"), "exact").when(F.col("_parent"), "pred_is_parent").when(F.col("_child"), "pred_is_child").otherwise("incompatible")
    return met.withColumn("compat_type", kind).withColumn("compatible", F.col("compat_type") != "incompatible").drop("_p", "_g", "_parent", "_child")
