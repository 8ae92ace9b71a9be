"""Sparse statistics against filled tables and scipy-free plain formulas; selections in large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import markers, order, sparse


@pytest.fixture(scope="module")
def table():
    """cells, their labels and values, some negative; one label has one cell, one gene one value."""
    rng = random.Random(4)
    cells = [(ds, k, "only" if k == 0 else rng.choice("abc")) for ds in ("x", "y") for k in range(60 if ds == "x" else 25)] + [("x", 900, None)]
    value = lambda g: 0.0 if g == "g9" or rng.random() < 0.6 else rng.choice([-1.5, 0.25, 1.0, 1.0, 2.0, rng.random()])
    dense = [(ds, k, label, f"g{g}", value(f"g{g}")) for ds, k, label in cells for g in range(10)]
    return cells, dense


def frames(spark, table):
    cells, dense = table
    ddl = "ds string, cell long, label string, gene string, value double"
    return spark.createDataFrame(cells, "ds string, cell long, label string"), spark.createDataFrame(dense, ddl)


def plain(cells, dense):
    """(ds, label, gene): n_in, n_out, mean_in, mean_out, t, rank_sum, z."""
    out = {}
    by = {}
    for ds, _, label, gene, v in dense:
        if label is not None:
            by.setdefault((ds, gene), []).append((label, v))
    for (ds, gene), rows in by.items():
        v = np.array([x for _, x in rows])
        less = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        ties = sum(n**3 - n for n in np.unique(v, return_counts=True)[1])
        for label in {x for x, _ in rows}:
            own = np.array([x == label for x, _ in rows])
            a, b, n, n1 = v[own], v[~own], len(v), int(own.sum())
            spread = n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))
            z = (less[own].sum() - n1 * (n + 1) / 2) / spread**0.5 if spread > 0 else None
            s = (a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)) if len(a) > 1 else None
            t = (a.mean() - b.mean()) / s**0.5 if s else None
            out[ds, label, gene] = (len(a), len(b), a.mean(), b.mean(), t, less[own].sum(), z, (a > 0).mean(), (b > 0).mean())
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-9


@pytest.mark.parametrize("kind", ["sparse", "dense", "some zeros and nulls"])
def test_zeros_follow_from_the_number_of_cells(spark, table, kind):
    cells, dense = frames(spark, table)
    rows = dense if kind == "dense" else dense.where("value <> 0") if kind == "sparse" else dense.where("value <> 0 or cell % 3 = 0").withColumn("value", F.when(F.expr("value <> 0 or cell % 2 = 0"), F.col("value")))
    if kind == "sparse":
        rows = rows.unionByName(spark.createDataFrame([("x", 1, "a", "g9", 0.0), ("y", 1, "a", "g9", 0.0)], rows.schema))  # else nothing tells of this gene
    got = {(r["ds"], r["label"], r["gene"]): r for r in sparse.statistics(rows, cells, ("ds",), tie_correction=True, ranges=4).collect()}
    want = plain(*table)
    assert got.keys() == want.keys()
    for key, (n_in, n_out, mean_in, mean_out, t, rank_sum, z, pct_in, pct_out) in want.items():
        r = got[key]
        assert (r["n_in"], r["n_out"], r["rank_sum"]) == (n_in, n_out, rank_sum) and close(r["mean_in"], mean_in) and close(r["mean_out"], mean_out)
        assert close(r["z"], z) and (r["pct_in"], r["pct_out"]) == (round(pct_in, 4), round(pct_out, 4))
        if t is not None:
            assert close(r["t"], t)


def test_one_dataset_equals_the_dense_operators(spark, table):
    cells, dense = frames(spark, table)
    cells, dense = cells.where("ds = 'x' and label is not null"), dense.where("ds = 'x' and label is not null")
    got = {(r["label"], r["gene"]): r for r in sparse.statistics(dense.where("value <> 0"), cells).collect()}
    for r in markers.rank_sums(dense).collect():
        if r["gene"] != "g9":
            assert got[r["label"], r["gene"]]["rank_sum"] == r["rank_sum"] and close(got[r["label"], r["gene"]]["z"], r["z"])
    for r in markers.welch(dense).collect():
        if r["gene"] != "g9":
            assert close(got[r["label"], r["gene"]]["t"], r["t"]) and close(got[r["label"], r["gene"]]["df"], r["df"])


def test_from_counts_to_candidates(spark, table):
    cells, dense = frames(spark, table)
    counts = dense.where("value > 0")
    got = sparse.candidates(counts, cells, ("ds",), most_cells=15, least_cells=3, most=4).collect()
    assert {r["ds"] for r in got} == {"x", "y"} and all(r["de_rank"] <= 4 for r in got) and not {r["gene"] for r in got} & {"g9"}
    with pytest.raises(ValueError):
        sparse.differential(counts, cells, ("ds",), method="u")


def test_no_rows(spark, table):
    cells, dense = frames(spark, table)
    assert sparse.statistics(dense.where("false"), cells, ("ds",)).count() == 0
    assert sparse.differential(dense.where("false"), cells.where("false"), ("ds",)).count() == 0


@pytest.mark.parametrize("most", [10, 100, 10**6])
def test_positions_in_groups_of_any_size(spark, most):
    rng = random.Random(most)
    rows = [(g, None if rng.random() < share else rng.choice([0.0, 7.5, rng.gauss(0, 1)])) for g, n, share in (("big", 4000, 0.01), ("nulls", 300, 0.7), ("none", 5, 1.1), ("one", 1, 0), (None, 700, 0.1)) for _ in range(n)] + [("same", 3.0)] * 900
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["p99"], r["largest"]) for r in order.nearest_percentiles(df, "g", "v", most=most, ranges=8).collect()}
    for g in {g for g, _ in rows}:
        own = [v for h, v in rows if h == g]
        known = sorted(v for v in own if v is not None)
        at = lambda q: known[max(0, int(len(own) * q) - (len(own) - len(known)))] if known else None
        assert got[g] == (len(own), at(0.5), at(0.95), at(0.99), max(known, default=None))


def test_sketches_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 10).alias("part"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("v"))
    sketches = order.value_sketches(df, ["g", "part"], "v")
    assert sketches.count() == 10
    for r in order.sketched_percentiles(sketches, "g").collect():
        assert 21_400 < r["n"] < 21_450
        for q in (0.5, 0.95, 0.99):
            assert abs(r[f"p{round(q * 100)}"] - 50_000 * q) < 600


@pytest.mark.parametrize("most", [1, 7, 50, 10_000])
def test_downsampling_spreads_a_hot_label(spark, most):
    """Of a label with nearly all rows only a margin is ranked, and the result is that of one sort."""
    rows = [(k, "hot" if k % 20 else [None, "rare"][k % 40 == 0], k % 5) for k in range(6000)]
    df = spark.createDataFrame(rows, "id long, label string, x int").repartition(5)
    got = {}
    for r in markers.downsampled(df, "label", "id", most).collect():
        got.setdefault(r["label"], set()).add(r["id"])
    from hashlib import md5

    for label in ("hot", "rare", None):
        own = sorted((md5(f"42|{k}".encode()).hexdigest(), k) for k, la, _ in rows if la == label)
        assert got[label] == {k for _, k in own[:most]}


def test_downsampling_of_repeated_keys(spark):
    """Keys that repeat have one hash, so the margin may hold none of them; then all of the label is ranked."""
    df = spark.createDataFrame([("l", k % 3, k) for k in range(2000)], "label string, id long, x long")
    got = markers.downsampled(df, "label", "id", 100).collect()
    assert len(got) == 100 and len({r["id"] for r in got}) == 1 and len({r["x"] for r in got}) == 100
