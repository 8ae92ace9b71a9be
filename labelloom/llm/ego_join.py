"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within eps = sqrt(2 - 2 c) of each other. They are turned to principal
directions and given a grid cell of side eps on the leading ones. In the order of (label, cells) they are cut into
intervals of at most BLOCK vectors. Two intervals need comparing only if they share or neighbour a cell of the first
direction, which an equi-join finds, and if their bounding boxes come within eps. Inside a pair the intervals are
halved recursively, and blocks that are provably too far apart are skipped; what is left is compared in double
precision. Each pair of intervals gives back link counts and a forest, so the result of a dense group is as large as
the group, not as its pairs. A vector is copied once for each interval that its own meets, so intervals are as large
as a task holds well (FLOATS numbers), and the halving inside does the fine work.

Equal vectors are one class before any of this: a class of copies is one row with a multiplicity.

Nulls: vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing
and are components of their own. A row without a vec_id links as any other does; it is never a component_id unless its
component has none (then that is null, and all its rows are kept). Vectors of different lengths don't link. Repeated
vec_ids link as vectors of their own. Of vectors whose cosine ties with the bound all link. An empty table gives an
empty result. Further columns stay out of the result, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import components, written

COSINE, FLOATS, LEAF, LEADING = 0.93, 1 << 20, 128, 6


def usable(v: str | Column) -> Column:
    """Whether the array takes part: not null, not zero, and of finite numbers."""
    v = F.col(v) if isinstance(v, str) else v
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def numbers(df: DataFrame, name: str) -> Column:
    """An array column as floats, if its components are no wider, else as doubles."""
    kind = df.schema[name].dataType.elementType.typeName()
    return F.col(name).cast("array<float>" if kind in ("float", "byte", "short") else "array<double>")


def vectors(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles; all lists as long as the first."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(classes: DataFrame, width: int) -> np.ndarray:
    """The leading principal directions of the unit vectors: sums of products from each task, one small matrix here."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = unit(vectors(batch.column(0)))
            if len(x):
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[*s, *p.ravel()]], pa.list_(pa.float64()))], ["n", "s"])

    parts = classes.select("v").mapInArrow(sums, "n long, s array<double>")
    whole = parts.select("n", F.posexplode("s")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("x")).orderBy("pos").toPandas()  # width * (width + 1) rows
    n, x = max(1, int(whole["n"].iloc[0])), whole["x"].to_numpy()
    mean = x[:width] / n
    return np.linalg.eigh(x[width:].reshape(width, width) / n - np.outer(mean, mean))[1][:, ::-1][:, : min(LEADING, width)]


def _placed(turn: np.ndarray, side: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors(batch.column("v"))
            x = unit(v) @ turn if len(v) else np.zeros((0, turn.shape[1]))
            at = pa.array(x.tolist(), pa.list_(pa.float64()))
            cells = pa.array(np.floor(x / side).astype(np.int32).tolist(), pa.list_(pa.int32()))
            own = [batch.column(c) for c in ("class", "label", "v", "n")]
            yield pa.RecordBatch.from_arrays([*own, at, cells], ["class", "label", "v", "n", "at", "cells"])

    return place


def _compare(x: np.ndarray, at: np.ndarray, rows: range, cols: range, reach: float, least: float, links: list) -> None:
    """Links between two intervals of rows, halved until blocks are small or provably too far apart."""
    a, b = at[rows.start : rows.stop], at[cols.start : cols.stop]
    gap = np.maximum(0, np.maximum(b.min(0) - a.max(0), a.min(0) - b.max(0)))
    if (gap * gap).sum() > reach * reach:
        return
    if max(len(rows), len(cols)) > LEAF:
        halves = lambda r: (r[: len(r) // 2], r[len(r) // 2 :]) if len(r) > LEAF else (r,)
        for r in halves(rows):
            for c in halves(cols):
                if r.start <= c.start:
                    _compare(x, at, r, c, reach, least, links)
                elif rows != cols:
                    _compare(x, at, r, c, reach, least, links)
        return
    near = x[rows.start : rows.stop] @ x[cols.start : cols.stop].T >= least
    i, j = np.nonzero(near)
    i, j = i + rows.start, j + cols.start
    keep = i < j if rows == cols else i != j
    links.append((i[keep], j[keep]))


def _joined(reach: float, least: float):
    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["interval", "nth"]).drop_duplicates(["class"])
        x, at = unit(np.stack(pdf["v"].to_numpy()).astype(np.float64)), np.stack(pdf["at"].to_numpy())
        cut = int((pdf["interval"] == first).sum()) if first != second else len(pdf)
        links: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        _compare(x, at, range(cut), range(cut, len(pdf)) if first != second else range(cut), reach, least, links)
        i, j = (np.concatenate(p) for p in zip(*links, strict=True))
        ids, n = pdf["class"].to_numpy(), pdf["n"].to_numpy()
        counts = np.bincount(i, n[j], len(pdf)) + np.bincount(j, n[i], len(pdf))
        at_least = np.arange(len(pdf))
        while len(i):  # smallest class reachable inside this pair of intervals
            low = at_least.copy()
            np.minimum.at(low, i, at_least[j])
            np.minimum.at(low, j, at_least[i])
            low = low[low]
            if (low == at_least).all():
                break
            at_least = low
        got = np.flatnonzero(counts)
        return pd.DataFrame({"class": ids[got], "links": counts[got].astype(np.int64), "to": ids[at_least[got]]})

    return join


def linked_classes(classes: DataFrame, cosine: float, width: int) -> DataFrame:
    """class, links (vectors of other classes linked directly) and to (a class it is connected with), in parts."""
    reach, block = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6, max(16, FLOATS // width)
    turn = directions(classes, width)
    placed = written(classes.mapInArrow(_placed(turn, reach), f"class long, label string, v {dict(classes.dtypes)['v']}, n long, at array<double>, cells array<int>"), "placed")

    # The order of (label, cells), cut into intervals: strips of (label, first cell) are ranked piece by piece.
    strip = placed.withColumn("first", F.col("cells")[0]).withColumn("rest", F.slice("cells", 2, LEADING))
    sizes = strip.groupBy("label", "first").agg(F.count("*").alias("strip_n"))
    strip = strip.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, ["label", "first"])
    # A strip with many vectors is cut again by the second cell, and a piece of one cell by hash: bounded windows.
    piece = F.when(F.col("strip_n") > 16 * block, F.col("cells")[1]).otherwise(0) if LEADING > 1 else F.lit(0)
    deal = F.when(F.col("strip_n") > 256 * block, F.pmod(F.xxhash64("class"), F.ceil(F.col("strip_n") / (256 * block)))).otherwise(0)
    nth = F.row_number().over(Window.partitionBy("label", "first", "piece", "deal").orderBy("rest", "class")) - 1
    ordered = strip.withColumn("piece", piece).withColumn("deal", deal).withColumn("nth", nth)
    ordered = ordered.withColumn("interval", F.xxhash64("label", "first", "piece", "deal", F.floor(F.col("nth") / block)))
    ordered = written(ordered.select("interval", "nth", "label", "first", "class", "v", "n", "at"), "ordered")

    dims = range(min(LEADING, width))
    boxes = ordered.groupBy("interval", "label", "first").agg(F.array(*(F.min(F.col("at")[d]) for d in dims)).alias("lo"), F.array(*(F.max(F.col("at")[d]) for d in dims)).alias("hi"))
    boxes = written(boxes, "boxes")
    near = boxes.select("label", F.explode(F.array(F.col("first") - 1, F.col("first"), F.col("first") + 1)).alias("first"), F.col("interval").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gaps = F.zip_with(F.zip_with("lo2", "hi", lambda a, b: a - b), F.zip_with("lo", "hi2", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    met = written(boxes.join(near, ["label", "first"]).where((F.col("interval") <= F.col("other")) & (apart <= reach * reach)).select("interval", "other"), "met")
    sides = met.select(F.col("interval").alias("i"), F.col("other").alias("j"), F.explode(F.array_distinct(F.array("interval", "other"))).alias("interval"))
    rows = ordered.select("interval", "nth", "class", "v", "n", "at").join(sides, "interval")
    return rows.groupBy("i", "j").applyInPandas(_joined(reach, cosine), "class long, links long, to long")


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of table (vec_id, embedding, label)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), numbers(table, "embedding").alias("v"))
    good = usable("v") & F.col("label").isNotNull()
    classes = rows.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("class"), F.count("*").alias("n"))
    classes = written(classes.withColumn("width", F.size("v")), "classes")
    widths = sorted(r[0] for r in classes.select("width").distinct().collect())
    # A repeated vec_id may stand for different vectors, a missing one for any: classes then need names of their own.
    twice = not classes.groupBy("class").count().where("count > 1 or class is null").isEmpty()
    if twice:
        classes = written(classes.withColumn("id", F.col("class")).withColumn("class", F.monotonically_increasing_id()), "classes")
    else:
        classes = classes.withColumn("id", F.col("class"))
    parts = None
    for width in widths:
        own = linked_classes(classes.where(F.col("width") == width).select("class", "label", "v", "n"), cosine, width)
        parts = own if parts is None else parts.union(own)
    if parts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = written(parts, "links")
    links = parts.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(parts.select(F.col("class").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "class")
    known = classes.select("class", "id", "label", "v", "n").join(links, "class", "left").join(roots, "class", "left")
    if twice:
        low = known.groupBy(F.coalesce("root", "class").alias("top")).agg(F.min("id").alias("component_id"))
        known = known.withColumn("top", F.coalesce("root", "class")).join(low, "top")
    else:
        known = known.withColumn("component_id", F.coalesce("root", "class"))
    known = known.select(F.col("label").alias("label2"), F.col("v").alias("v2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    found = rows.where(good).join(known, (F.col("label") == F.col("label2")) & (F.col("v") == F.col("v2"))).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
