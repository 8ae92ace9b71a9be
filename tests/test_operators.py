"""Operators on small hand-made tables: edges that the generated tables lack."""

import datetime
import json
import math
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from labelloom.functions import labels as lb
from labelloom.functions import scoring as sc
from labelloom.functions import tails
from labelloom.functions import text as tx
from labelloom.operators import cleaning, curation, diagnosis, evaluation, hierarchy, knowledge, manifest, markers, order, records, splits
from labelloom.sources import config, files
from labelloom.streaming import incremental


def one(df, expr):
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [(None, None), ("", None), (" \t\n", None), ("  T   Cells ", "t cells"), ("A b", "a b")])
def test_label_text(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "s string"), tx.label_text("s")) == want


@pytest.mark.parametrize("raw,want", [("CD4+_T-cell, human", "cd4+ t cell"), (None, ""), ("humanoid", "humanoid")])
def test_plain_label(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "s string"), tx.plain_label("s")) == want


def test_finite_drops_infinities_and_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(tx.finite("x")).collect()] == [None, None, None, 1.5, None]


def test_status_ladder(spark):
    rows = [("", None, False, None), ("other cell", "CL:1", True, ""), ("x", "CL:1", True, "an alias"), ("x", "CL:1", True, ""), ("x", None, True, ""), ("x", "CL:1", False, None)]
    df = spark.createDataFrame(rows, "l string, i string, f boolean, n string")
    got = [r[0] for r in df.select(lb.label_status("l", "i", F.col("f"), "n")).collect()]
    assert got == ["empty", "ambiguous", "alias", "canonical", "unmapped", "canonical"]


def test_guardrail(spark):
    rows = [("normal", 1, 1, "Lung atlas", "x"), ("Breast Cancer", 1, 1, "t", "x"), ("normal", 4, 1, "t", "x"), (None, None, None, None, None), ("normal", 1, 3, "t", "x"), ("normal", 1, 1, "CRISPR screen", "x")]
    df = spark.createDataFrame(rows, "d string, t int, n int, title string, c string")
    assert [r[0] for r in df.select(curation.guardrail("d", "t", "n", "title", "c")).collect()] == [True, False, False, True, False, False]
    strict = curation.Curation(normal_only=True)
    assert [r[0] for r in df.select(curation.guardrail("d", "t", "n", "title", "c", strict)).collect()] == [True, False, False, False, False, False]


def test_min_max_of_constant_and_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 4.0, None)], "a double, b double, c double")
    assert [tuple(r) for r in df.select(*(curation.min_max(c) for c in "abc")).collect()] == [(1.0, 0.0, 0.0), (1.0, 1.0, 0.0)]


def test_selection_fills_up_and_cuts(spark):
    rows = [(f"d{k}", ["blood"] if k < 4 else ["skin"], float(k), k, k) for k in range(10)]
    df = spark.createDataFrame(rows, "id string, tissues array<string>, auto_score double, n_types int, n_rows int")
    cfg = curation.Curation(per_tissue=2, least_selected=5, most_selected=4)
    got = {r["id"]: r["selected_reason"] for r in curation.balanced_selection(df, "id", "tissues", ["blood", "lung"], cfg).collect()}
    assert got == {"d9": "fill_up", "d8": "fill_up", "d7": "fill_up", "d3": "top_of_tissue"}


def test_template_falls_back(spark):
    df = spark.createDataFrame([("a", ["x"], 1, 1), ("b", ["x"], 2, 1)], "id string, tissues array<string>, n_types int, n_rows int")
    assert [r["id"] for r in curation.template_selection(df, "id", "tissues", ["blood"], 1, 1).select("id").collect()] == ["b"]


def test_frequency_filter_at_the_threshold(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 49 + [(None,)] * 60, "l string")
    assert {r[0] for r in cleaning.frequent_labels(df, "l", 50).distinct().collect()} == {"a"}


def test_alias_index_last_row_wins(spark):
    df = spark.createDataFrame([("CD4+ T cell", "one", "1", "", "", 1), (" cd4+  t cell", "two", "2", "", "", 2)], "raw_label string, normalized_label string, id string, parent_label string, notes string, ord int")
    assert [(r["key"], r["normalized_label"]) for r in cleaning.alias_index(df).collect()] == [("cd4+ t cell", "two")]


def test_welch_and_ranks_against_plain_python(spark):
    import random

    rng = random.Random(5)
    data = [(c, c % 3, g, float(rng.choice([0, 0, 1, 2, 5]))) for c in range(40) for g in range(4)]
    df = spark.createDataFrame(data, "cell int, label int, gene int, value double")
    got = {(r["label"], r["gene"]): r for r in markers.welch(df).collect()}
    ranks = {(r["label"], r["gene"]): r for r in markers.rank_sums(df, tie_correction=True).collect()}
    for label in range(3):
        for gene in range(4):
            a = [v for _, lab, g, v in data if g == gene and lab == label]
            b = [v for _, lab, g, v in data if g == gene and lab != label]
            mean = lambda x: sum(x) / len(x)
            var = lambda x: sum((y - mean(x)) ** 2 for y in x) / (len(x) - 1)
            t = (mean(a) - mean(b)) / math.sqrt(var(a) / len(a) + var(b) / len(b))
            assert got[label, gene]["t"] == pytest.approx(t, abs=1e-9)
            every = sorted(a + b)
            rank = {v: (every.index(v) + 1 + len(every) - every[::-1].index(v)) / 2 for v in every}
            r = sum(rank[v] for v in a)
            n, n1 = len(every), len(a)
            ties = sum(c**3 - c for c in (every.count(v) for v in set(every)))
            z = (r - n1 * (n + 1) / 2) / math.sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1))))
            assert ranks[label, gene]["rank_sum"] == pytest.approx(r)
            assert ranks[label, gene]["z"] == pytest.approx(z)


def test_adjusted_p(spark):
    df = markers.with_p(spark.createDataFrame([("a", k, z) for k, z in enumerate([3.0, 2.0, 1.0, 0.0])], "label string, gene int, z double"))
    rows = sorted(markers.adjusted(df, "label").collect(), key=lambda r: r["gene"])
    p = [math.erfc(z / math.sqrt(2)) for z in (3, 2, 1, 0)]
    want = [min(min(p[j] * 4 / (j + 1) for j in range(k, 4)), 1) for k in range(4)]
    assert [r["p_adj"] for r in rows] == pytest.approx(want, rel=1e-5)


def test_tails(spark):
    ts = [0.02, 0.5, 1.0, 2.5, 6.0, 12.0, 30.0]
    rows = spark.createDataFrame([(t, t) for t in ts] + [(-2.5, 2.5), (0.0, 0.0)], "t double, u double").select(
        "t", "u", tails.normal_tail("t").alias("z"), *(tails.student_tail("t", F.lit(float(d))).alias(f"d{d}") for d in (1, 2, 4, 1000)))
    for r in rows.collect():
        u = r["u"]
        rel = 1e-7 if u else 1e-4
        assert r["z"] == pytest.approx(math.erfc(u / math.sqrt(2)), rel=rel)
        assert r["d1"] == pytest.approx(2 / math.pi * math.atan2(1, u), rel=rel)
        assert r["d2"] == pytest.approx(2 / (2 + u * u) / (1 + u / math.sqrt(2 + u * u)), rel=rel)
        x = u / math.sqrt(4 + u * u)
        assert r["d4"] == pytest.approx(1 - 1.5 * x * (1 - x * x / 3), rel=rel, abs=1e-9)
        assert r["z"] <= r["d1000"] <= r["d4"] * 1.0001
    odd = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0), (float("nan"), 2.0)], "t double, d double")
    got = [r[0] for r in odd.select(tails.student_tail("t", "d")).collect()]
    assert got[:3] == [None, None, None] and got[3] != got[3]


@pytest.mark.parametrize("method", ["rank sums", "t"])
def test_differential(spark, method):
    import random

    rng = random.Random(8)
    data = [(c, f"l{c % 3}", f"g{g:02}", rng.gauss(0, 1) + (2.0 if g % 3 == c % 3 and g < 12 else 0.0)) for c in range(60) for g in range(20)]
    df = spark.createDataFrame(data, "cell int, label string, gene string, value double")
    rows = markers.differential(df, method, most=7).collect()
    whole = markers.differential(df, method, most=99).collect()
    assert len(rows) == 21 and len(whole) == 60 and {tuple(r) for r in rows} == {tuple(r) for r in whole if r["de_rank"] <= 7}
    for label in ("l0", "l1", "l2"):
        own = sorted((r for r in whole if r["label"] == label), key=lambda r: r["de_rank"])
        assert [r["statistic"] for r in own] == sorted((r["statistic"] for r in own), reverse=True)
        assert {r["gene"] for r in own[:4]} == {f"g{g:02}" for g in range(12) if g % 3 == int(label[1])}
        by_p = sorted(own, key=lambda r: r["p"])
        want = [min(min(by_p[j]["p"] * 20 / (j + 1) for j in range(k, 20)), 1) for k in range(20)]
        assert [r["p_adj"] for r in by_p] == pytest.approx(want)
    with pytest.raises(ValueError):
        markers.differential(df, "other")


def test_rank_sums_of_continuous_values(spark):
    rows = spark.range(4000).select(F.col("id").alias("cell"), (F.col("id") % 2).alias("label"), F.lit("g").alias("gene"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7.0 - 30 * (F.col("id") % 5 == 0).cast("int")).alias("value"))
    data = sorted((r["value"], r["label"]) for r in rows.collect())
    place = {}
    for k, (v, _) in enumerate(data, 1):
        place.setdefault(v, []).append(k)
    want = sum(sum(place[v]) / len(place[v]) for v, label in data if label == 1)
    for ranges in (1, 3, 64):
        got = {r["label"]: r["rank_sum"] for r in markers.rank_sums(rows, ranges=ranges).collect()}
        assert got[1] == pytest.approx(want) and got[0] + got[1] == pytest.approx(4000 * 4001 / 2)


def test_depth_normalisation_of_an_empty_cell(spark):
    df = spark.createDataFrame([(1, "g", 0.0), (2, "g", 3.0), (2, "h", 1.0)], "cell int, gene string, value double")
    got = {(r["cell"], r["gene"]): r["value"] for r in markers.depth_normalised(df).collect()}
    assert got[1, "g"] == 0 and got[2, "g"] == pytest.approx(math.log(1 + 7500))


def test_listed_out(spark):
    df = spark.createDataFrame([("mt-co1",), ("RPL3",), ("malat1",), ("HBEGF",), ("CD3D",)], "g string")
    assert [r[0] for r in df.select(sc.listed_out("g")).collect()] == [True, True, True, True, False]


def test_mean_of_first_ignores_what_is_not_finite(spark):
    df = spark.createDataFrame([([1.0, float("inf"), 3.0, None, float("nan"), 100.0],), ([],), ([float("nan")],)], "v array<double>")
    assert [r[0] for r in df.select(sc.mean_of_first("v", 5)).collect()] == [2.0, None, None]


def test_merged_entries(spark):
    rows = [("Human", "Blood", "T cell", "1", None, None, ["CD3", "cd3", "CD4"], 0.2, "external"), ("human", "blood ", "t cell", "2", None, None, ["CD8", "CD4"] + [f"g{k}" for k in range(30)], 0.9, "derived")]
    df = spark.createDataFrame(rows, "species string, tissue string, label string, entry_id string, id string, parent_label string, genes array<string>, weight double, entry_type string")
    (r,) = knowledge.merged_entries(df).collect()
    assert r["entry_id"] == "1" and r["genes"][:3] == ["CD3", "CD4", "CD8"] and len(r["genes"]) == 20 and r["n_sources"] == 2


def test_retrieval_gives_blank_tissues_the_bonus(spark):
    q = spark.createDataFrame([(1, ["a", "b"], "blood")], "query_id int, genes array<string>, tissue string")
    e = spark.createDataFrame([(1, "x", ["A"], ""), (2, "y", ["b"], "lung"), (3, "z", ["q"], "blood")], "entry_id int, label string, genes array<string>, tissue string")
    got = [(r["entry_id"], r["score"]) for r in knowledge.retrieved(q, e, 5).orderBy("rank").collect()]
    assert got == [(1, 0.7), (2, 0.5)]
    assert knowledge.retrieved(q, e.where("false"), 5).count() == 0


@pytest.mark.parametrize(("k", "sent"), [(1, 10**6), (5, 10**6), (1, 0), (5, 0)])
def test_retrieval_scores_few_pairs_and_loses_none(spark, monkeypatch, k, sent):
    monkeypatch.setattr(knowledge, "SENT", sent)
    rng = random.Random(k)
    words = [f"w{j}" for j in range(600)]
    pick = lambda n: [w if rng.random() < 0.8 else w.upper() for w in {words[min(599, int(rng.paretovariate(0.35)) - 1)] for _ in range(n)} | set(rng.sample(words, n // 4))]
    tissues = ["", "blood", "lung", "whole blood", None]
    es = [(j, f"l{j % 9}", pick(rng.randint(1, 40)), rng.choice(tissues)) for j in range(250)]
    qs = [(j, pick(rng.choice([2, 20, 60])), rng.choice(tissues)) for j in range(60)] + [(90, [], "blood"), (91, None, "lung"), (92, ["nowhere"], ""), (93, es[4][2], "lung")]
    q = spark.createDataFrame(qs, "query_id int, genes array<string>, tissue string")
    e = spark.createDataFrame(es, "entry_id int, label string, genes array<string>, tissue string")
    want, every = {}, 0
    for key, genes, tissue in qs:
        a, rows = {g.lower() for g in genes or []}, []
        for id_, _, other, there in es:
            b = {g.lower() for g in other}
            if n := len(a & b):
                extra = 0.2 if tissue and (tissue in (there or "") or (there or "") in tissue) else 0.0
                rows.append((-float(Decimal(repr(n / len(a | b) + extra)).quantize(Decimal("0.0001"), ROUND_HALF_UP)), id_, n))
        every += len(rows)
        want |= {(key, r + 1): (id_, n, -score) for r, (score, id_, n) in enumerate(sorted(rows)[:k])}
    got = {(r["query_id"], r["rank"]): (r["entry_id"], r["shared"], r["score"]) for r in knowledge.retrieved(q, e, k).collect()}
    assert got.keys() == want.keys() and all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-9 for g, w in zip((got[x] for x in want), want.values(), strict=True))
    if not sent:
        assert knowledge.scored_pairs(q, e, k).count() < every * 0.85


def test_ancestors_stop_at_cycles_and_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("s", "s"), ("1", "2"), ("2", "3"), ("3", "4"), ("4", "5")], "child string, parent string")
    got = {(r["label"], r["ancestor"]) for r in hierarchy.ancestors(e, 3).collect()}
    assert ("1", "4") in got and ("1", "5") not in got and ("s", "s") not in got and ("a", "b") in got and ("a", "a") not in got


def plain_ancestors(up, depth):
    out = {}
    for label in up:
        now, level = label, 0
        while level < depth and (nxt := up.get(now)) is not None and nxt != now and nxt != label:
            now, level = nxt, level + 1
            out.setdefault((label, now), level)
    return out


@pytest.mark.parametrize("depth", [1, 3, 5, 50])
def test_ancestors_of_any_depth(spark, depth):
    rng = random.Random(depth)
    up = {f"c{k}": f"c{k + 1}" for k in range(60)} | {f"t{k}": f"t{rng.randrange(k)}" for k in range(1, 40)}
    up |= {"x": "y", "y": "z", "z": "x", "in": "x", "in2": "in", "self": "self", "two": "owt", "owt": "two", "side": "two"}
    got = {(r["label"], r["ancestor"]): r["level"] for r in hierarchy.ancestors(spark.createDataFrame(list(up.items()), "child string, parent string"), depth).collect()}
    assert got == plain_ancestors(up, depth)


def test_intervals_are_the_same_as_the_table_of_ancestors(spark):
    rng = random.Random(8)
    up = {f"a{k}": f"a{k + 1}" for k in range(50)} | {f"t{k}": f"t{rng.randrange(max(0, k - 6), k)}" for k in range(1, 60)} | {f"u{k}": "u0" for k in range(1, 9)}
    edges = spark.createDataFrame(list(up.items()) + [("x", "y"), ("y", "x"), ("in", "x")], "child string, parent string")
    ranges = hierarchy.intervals(edges)
    rows = {r["label"]: r for r in ranges.collect()}
    assert set(rows) == set(up) | set(up.values())
    every = plain_ancestors(up, 100)
    assert all((rows[b]["first"] <= rows[a]["first"] <= rows[b]["last"] and a != b) == ((a, b) in every) for a in rows for b in rows)
    assert sorted(r["first"] for r in rows.values()) == list(range(len(rows)))
    names = [*rows, "nowhere", ""]
    pairs = spark.createDataFrame([(rng.choice(names), rng.choice(names)) for _ in range(1500)] + [("", ""), ("t0", "T0")], "pred string, gold string")
    closure = hierarchy.ancestors(edges, 3)
    want = sorted(map(tuple, hierarchy.with_compatibility(pairs, closure).collect()))
    assert sorted(map(tuple, hierarchy.with_compatibility_by_range(pairs, ranges).collect())) == want
    assert len({r[2] for r in want}) == 4


def test_calibration_counts_but_does_not_bin_one(spark):
    df = spark.createDataFrame([(1.0, True), (0.3, False), (0.25, True), (None, True)], "p double, y boolean")
    r = evaluation.calibration(df, "p", "y").first()
    assert r["n"] == 3 and r["ece"] == pytest.approx(2 * abs(0.275 - 0.5) / 3, abs=1e-4)  # 0.3 is below the edge that a sum of tenths gives


def test_percentile_positions(spark):
    df = spark.createDataFrame([("g", k) for k in range(100)], "g string, v int")
    r = order.nearest_percentiles(df, "g", "v").first()
    assert (r["p50"], r["p95"], r["p99"], r["largest"]) == (50, 95, 99, 99)


def plain_object(text):
    k = text.find("{")
    if k < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for at in range(k, len(text)):
        c = text[at]
        was = quoted
        if c == '"' and not escaped:
            quoted = not quoted
        escaped = was and c == "\\" and not escaped
        if not was and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0 and c == "}":
                return text[k : at + 1]
    return None


def test_first_object_of_random_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice('{}"\\a\n ') for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ['{"a": "' + "\\n" * 20_000 + '"} }', "{" * 5_000, '{"x": "' + "y" * 200_000 + '"}', '\U0001f600 {"é": "}"} {']
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    for r in df.select("s", records.first_object("s").alias("o")).collect():
        assert r["o"] == plain_object(r["s"]), r["s"]


def test_isotonic_plan_equals_pooling(spark):
    from labelloom.operators import calibration

    rng = random.Random(2)
    rows = [(rng.choice([round(rng.random(), 2), 0.5, None]), rng.choice([True, False, None]) if rng.random() < 0.3 else rng.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "f_score double, y boolean")
    blocks = []  # pool adjacent violators
    for x in sorted({x for x, y in rows if x is not None and y is not None}):
        own = [y for z, y in rows if z == x and y is not None]
        blocks.append([sum(own), len(own), [x]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    want = {x: s / n for s, n, xs in blocks for x in xs}
    fit = calibration.isotonic_fit(df, "f_score", "y")
    assert {r["score"]: r["p"] for r in fit.collect()} == pytest.approx(want)
    few = calibration.isotonic_fit(df, "f_score", "y", most=10).orderBy("score").collect()
    assert len(few) <= 11 and [r["p"] for r in few] == sorted(r["p"] for r in few)
    asked = spark.createDataFrame([(x,) for x in (-1.0, 0.123456, 0.5, 2.0, None)], "f_score double")
    xs = sorted(want)
    got = [r["calibrated"] for r in calibration.interpolated(asked, fit, "f_score").collect()]
    assert got == [round(float(np.interp(x, xs, [want[k] for k in xs])), 4) for x in (-1.0, 0.123456, 0.5, 2.0, 0.0)]
    none = calibration.isotonic_fit(df.where("false"), "f_score", "y")
    assert [r["calibrated"] for r in calibration.interpolated(asked, none, "f_score").collect()] == [None] * 5


def test_logistic_calibrator_has_converged(spark):
    from labelloom.operators import calibration

    rng = np.random.default_rng(3)
    x = rng.random((600, 2))
    y = rng.random(600) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1])))
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for (a, b), c in zip(x, y, strict=True)], "f_score double, f_size double, y boolean")
    model = calibration.Calibrator(columns=("f_score", "f_size")).fit(df, "y").model.stages[-1]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.where(y, 600 / (2 * y.sum()), 600 / (2 * (~y).sum()))

    def loss(c, b):
        m = z @ c + b
        return (w * (np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0) - y * m)).sum() / w.sum() + 0.5 / 600 * (c * c).sum()

    c, b = np.array(model.coefficients), model.intercept
    for step in (np.array([1.0, 0]), np.array([0, 1.0])):
        slope = (loss(c + 1e-5 * step, b) - loss(c - 1e-5 * step, b)) / 2e-5
        assert abs(slope) < 1e-3
    assert abs(loss(c, b + 1e-5) - loss(c, b - 1e-5)) / 2e-5 < 1e-3


@pytest.mark.parametrize("n,want", [(1, {"train": 1}), (2, {"train": 1, "test": 1}), (3, {"train": 1, "val": 1, "test": 1}), (20, {"train": 15, "val": 2, "test": 3})])
def test_group_split_sizes(spark, n, want):
    got = splits.group_split(spark.range(n), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == want


def test_small_training_sets_have_no_pseudo_validation(spark):
    assert {r["split"] for r in splits.pseudo_validation(spark.range(15), "id").collect()} == {"train"}


def test_best_status_takes_the_last_of_equals(spark):
    df = spark.createDataFrame([("a", "failed", 3), ("a", "ok", 1), ("a", "done", 2), ("b", "odd", 1)], "k string, status string, o int")
    assert {(r["k"], r["status"]) for r in manifest.best_status(df, "k", order="o").collect()} == {("a", "done"), ("b", "odd")}


@pytest.mark.parametrize("text,ok,label", [
    ("", False, ""), (None, False, ""), ("[]", False, ""), ('{"cell_type": "a"}', True, "a"), ('x {"cell_type": "{b"} y', True, "{b"), ("{bad} {\"cell_type\": \"c\"}", False, ""),
    ('<think>{"cell_type":"no"}</think>{"cell_type":"yes"}', True, "yes"), ('thought </think>{"cell_type":"z"}', True, "z"), ('{"cell_type": null}', True, ""),
])
def test_parsed_answers(spark, text, ok, label):
    r = spark.createDataFrame([(text,)], "s string").select(records.parsed_answer("s").alias("a")).first()["a"]
    assert (r["parse_ok"] or False, r["cell_type"]) == (ok, label)


def test_label_quality_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "grade string")
    assert diagnosis.quality_summary(empty).count() == 0


def test_json_lines_tolerant_and_strict(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json_lines(spark, str(tmp_path), "a int").collect()) == [1, 2]
    assert [r["value"] for r in files.malformed_lines(spark, str(tmp_path), "a int").collect()] == ["{bad"]
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        files.read_json_lines(spark, str(tmp_path), "a int", strict=True).collect()


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], ("x", 2.0))], "k int, l array<string>, s struct<p:string,q:double>")
    files.write_csv(df, str(tmp_path / "csv"), one_file=True)
    (r,) = files.read_csv(spark, str(tmp_path / "csv"), "k int, l string, s_p string, s_q double", key="k").collect()
    assert tuple(r) == (1, "a|b", "x", 2.0)
    files.write_json_lines(df, str(tmp_path / "json"))
    files.write_json_lines(df, str(tmp_path / "json"), append=True)
    assert files.read_json_lines(spark, str(tmp_path / "json"), "k int, l array<string>").count() == 2
    (tmp_path / "t.tsv").write_text('raw\tid\nT cells\t\n"x\tCL:1\n')
    assert [(r["raw"], r["id"]) for r in files.read_tsv_text(spark, str(tmp_path / "t.tsv"), ["raw", "id"]).orderBy("ord").collect()] == [("T cells", ""), ('"x', "CL:1")]
    (tmp_path / "m.json").write_text(json.dumps({"_note": "no", "b cell": "lymphocyte"}))
    assert [(r["key"], r["value"]) for r in files.read_map_document(spark, str(tmp_path / "m.json")).collect()] == [("b cell", "lymphocyte")]
    assert [r["name"] for r in files.files(spark, str(tmp_path), "*.json", 10_000).collect()] == ["m.json"]


def test_a_large_table_is_no_json_object(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    with pytest.raises(ValueError):
        files.write_map_document(rows, str(tmp_path / "m"), most=4)
    files.write_map_document(rows, str(tmp_path / "m"), most=5)
    assert files.read_map_document(spark, str(tmp_path / "m")).count() == 5


def test_partition_overwrite_keeps_the_others(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    files.write_partitions(rows(("a", 1), ("b", 1)), str(tmp_path / "t"), "k")
    files.write_partitions(rows(("b", 2)), str(tmp_path / "t"), "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 2)}


def test_report(spark):
    many = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") > 5, "x").alias("b")).orderBy("a")
    lines = [r["value"] for r in files.report_lines("R", part_one=many, none=many.where("false")).orderBy("ord").collect()]
    assert lines[:6] == ["# R", "", "## part one", "", "| a | b |", "| --- | --- |"]
    assert lines[6:306] == [f"| {k} | {'x' if k > 5 else ''} |" for k in range(300)]
    assert lines[306:] == ["", "## none", "", "| a | b |", "| --- | --- |"]


def test_text_tables_keep_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\traw\n" + "".join(f"{k}\tx{k % 3}\n" for k in range(500)))
    (tmp_path / "b.tsv").write_text("raw\tid\nx0\tlast\n\n")
    rows = files.read_tsv_text(spark, str(tmp_path), ["raw", "id", "more"]).orderBy("ord").collect()
    assert [(r["raw"], r["id"], r["more"]) for r in rows] == [(f"x{k % 3}", str(k), "") for k in range(500)] + [("x0", "last", "")]


def test_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app-1"
        getConf = staticmethod(lambda: {})

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError, match="checkpoint"):
        files.shared_dir(Session)
    Context.master = "local[4]"
    assert files.shared_dir(Session) == files.shared_dir(Session)
    path = files.scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    files.discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_ingestion_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: incremental.ingest(spark, str(tmp_path / "in"), "k int", str(tmp_path / "out"), str(tmp_path / "cp"))
    (tmp_path / "in/1.json").write_text('{"k": 1}\n')
    run()
    run()
    (tmp_path / "in/2.json").write_text('{"k": 2}\n')
    run()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_ingested_status_rows_keep_the_best(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: incremental.ingest_upserts(spark, str(tmp_path / "in"), "f string, g string, status string, o int", str(tmp_path / "out"), str(tmp_path / "cp"), "f", "g", "o")
    (tmp_path / "in/1.json").write_text('{"f":"a","g":"x","status":"failed","o":1}\n{"f":"b","g":"y","status":"ok","o":1}\n')
    run()
    (tmp_path / "in/2.json").write_text('{"f":"a","g":"x","status":"ok","o":2}\n')
    run()
    assert {(r["f"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "ok"), ("b", "ok")}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 2, 59)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = incremental.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["total"]) for r in spark.table("w").collect()] == [(3, 3.0)]


def test_selection_is_pushed_to_the_scan(spark):
    from labelloom.plans import catalog

    plan = catalog.QUERIES["A1_pushed_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_returnflag" in plan and "l_extendedprice" not in plan


@pytest.mark.parametrize("method", ["logistic", "isotonic"])
def test_calibrator_learns_saves_and_loads(spark, tmp_path, method):
    from labelloom.operators.calibration import FEATURES, Calibrator

    rows = [(k, k % 100 / 100, (k * 37 % 100) < k % 100) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, s double, y boolean").select("k", "y", *(F.col("s").alias(c) if c == "f_score" else F.lit(0.5).alias(c) for c in FEATURES))
    assert Calibrator(method).calibrated(df).where("calibrated <> f_score").count() == 0
    model = Calibrator(method).fit(df, "y")
    got = {r["f_score"]: r["calibrated"] for r in model.calibrated(df).select("f_score", "calibrated").distinct().collect()}
    assert got[0.9] > 0.7 > 0.3 > got[0.1]
    model.save(str(tmp_path / "m"))
    again = Calibrator(method).load(str(tmp_path / "m")).calibrated(df)
    assert {r["f_score"]: r["calibrated"] for r in again.select("f_score", "calibrated").distinct().collect()} == got
    with pytest.raises(ValueError):
        Calibrator("other")


def test_sidecars(spark, tmp_path):
    rows = [("d1", "T Cells", "t cell", "blood", "normal"), ("d1", "t cell", "t cell", "blood", "normal"), ("d2", "B", "b", "lung", None)]
    df = spark.createDataFrame(rows, "dataset_id string, raw string, clean string, tissue string, disease string")
    files.write_sidecars(df, str(tmp_path), "dataset_id", "raw", "clean")
    read = lambda name: {tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()}
    assert read("clean_counts") == {("t cell", 2, "d1"), ("b", 1, "d2")}
    assert read("mapping") == {("T Cells", "t cell", 1, "d1"), ("t cell", "t cell", 1, "d1"), ("B", "b", 1, "d2")}
    (one_, two) = sorted(spark.read.parquet(str(tmp_path / "profile")).collect(), key=lambda r: r["dataset_id"])
    assert (one_["n_records"], one_["main_tissue"], two["main_disease"]) == (2, "blood", "unknown")


def test_tsv_appends_only_unseen_keys(spark):
    old = spark.createDataFrame([("T cell", "x")], "raw string, id string")
    new = spark.createDataFrame([(" t CELL ", "y"), ("nk", "z"), ("NK", "w"), ("", "v")], "raw string, id string")
    got = sorted((r["raw"].lower(), r["id"]) for r in manifest.appended(old, new, "raw").collect())
    assert [k for k, _ in got] == ["nk", "t cell"]


def test_hash_rank_with_null_parts(spark):
    rows = [(k, None if k % 3 == 0 else f"p{k % 3}") for k in range(500)]
    df = spark.createDataFrame(rows, "id int, p string")
    got = {}
    for r in splits.with_hash_rank(df, "id", 7, "p").collect():
        got.setdefault(r["p"], []).append((r["_k"], r["id"], r["_n"]))
    import hashlib

    for p, found in got.items():
        ids = sorted((k for k, q in rows if q == p), key=lambda k: hashlib.md5(f"7|{k}".encode()).hexdigest())
        assert sorted(found) == [(k + 1, i, len(ids)) for k, i in enumerate(ids)]


def test_whole_tables_reach_the_join_and_the_normalisation(spark):
    from labelloom.plans import catalog

    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    assert sorted(catalog.QUERIES["C11_composite_key_join"](spark, folder).select("o_orderkey").collect()) == sorted(orders.collect())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r["s"] for r in catalog.QUERIES["H1_text_or_null"](spark, folder).collect()}
    assert got == {k: " ".join(re.split(r"[ \t-\r]+", v.strip(" \t\n\v\f\r"))) or None for k, v in texts.items()}
    n = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    assert catalog.QUERIES["H18_overlap_score"](spark, folder).count() == sum(bool(v.strip(" \t\n\v\f\r")) for v in texts.values()) and n > 0


@pytest.mark.parametrize("most", [200_000, 20, -1])
def test_first_containments_of_any_set(spark, monkeypatch, most):
    """By automaton, by grams, or one direction each: the same as trying all pairs, short and blank texts included."""
    monkeypatch.setattr(knowledge, "NAMES", most)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(rng.randint(0, n)))
    names = {word(5): k for k in range(60, 0, -1)}
    texts = sorted({word(9) for _ in range(120)} | {"", "a", "\U0001f600", "é a"})
    n, t = spark.createDataFrame(list(names.items()), "name string, ord long").repartition(3), spark.createDataFrame([(x,) for x in texts], "text string").repartition(4)
    inside = {x: min(k for w, k in names.items() if w in x) for x in texts if any(w in x for w in names)}
    around = {x: min(k for w, k in names.items() if x in w) for x in texts if any(x in w for w in names)}
    assert {r["text"]: r["ord"] for r in knowledge.first_inside(t, n).collect()} == inside
    assert {r["text"]: r["ord"] for r in knowledge.first_around(t, n).collect()} == around
    assert knowledge.first_inside(t.where("false"), n).count() == 0 and knowledge.first_around(t, n.where("false")).count() == 0


def test_rule_mapper_finds_every_containment(spark):
    from labelloom.operators import knowledge as kn

    index = [("CL:1", "T-cell", ["cd3"], 1), ("CL:2", "lymphocyte", [], 2), ("CL:3", "megakaryocyte", [], 3), ("", "neuron", [], 4), ("CL:5", "NK", [], 5), ("CL:6", "t cell", [], 6)]
    labels = ["lymphocytes", "karyocyte", "t cell", "CD3", "Human T_cell", "cyte", "n", "xnkx", "neuron", "zz", None, "zz", "T cells, lymphocytes"]
    got = kn.rule_mapped(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame(index, "id string, label string, synonyms array<string>, ord int")).collect()
    want = [("lymphocytes", "CL:2", "part"), ("karyocyte", "CL:3", "part"), ("t cell", "CL:6", "exact"), ("CD3", "CL:1", "synonym"), ("Human T_cell", "CL:6", "exact"), ("cyte", "CL:2", "part"), ("n", "CL:5", "part"),
            ("xnkx", "CL:5", "part"), ("neuron", None, "none"), ("zz", None, "none"), ("zz", None, "none"), (None, "CL:6", "part"), ("T cells, lymphocytes", "CL:6", "part")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_feature_vector_has_all_features(spark):
    ddl = "pos array<struct<gene:string,lfc:double,pct_in:double,pct_out:double,score:double>>, neg array<string>, n int, q double, f struct<low_cells:boolean,low_marker_quality:boolean,ontology_unmapped:boolean,rare_label_in_dataset:boolean>"
    pos = [(f"g{k}", float(k), 0.9 if k != 2 else None, 0.1 * k, None) for k in range(1, 8)]
    rows = spark.createDataFrame([(pos, ["x", "y"], 99, 0.5, (True, False, None, True)), ([], None, 0, None, None)], ddl)
    got = rows.select(*sc.feature_vector("pos", "neg", "n", "q", "f")).collect()
    assert tuple(got[0]) == (7, 2, 99, 4.6052, 3.0, 0.9, 0.3, None, 0.575, 0.5, 1, 0, 0, 1)
    assert tuple(got[1]) == (0, 0, 0, 0.0, None, None, None, None, None, None, 0, 0, 0, 0)


def test_settings(spark, tmp_path):
    (tmp_path / "run.yaml").write_text("model_size: 4B\ntrain: data/train.parquet\nval: s3a://b/val\noutput: ''\nleast_rows: 5\nprefer: [atlas, map]\nweights: {cells: 0.9}\n")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "list.yaml").write_text("- 1\n")
    read = config.read_config(spark, str(tmp_path / "run.yaml"))
    got = config.with_paths(read, "/base/", "train", "val", "absent", output="output", made_of="out/{model_size}_{now:%Y}", now=datetime.datetime(2024, 5, 1))
    assert (got["train"], got["val"], got["output"]) == ("/base/data/train.parquet", "s3a://b/val", "/base/out/4B_2024") and "absent" not in got
    assert read["output"] == "" and config.resolved("/a/b", "/base") == "/a/b"
    made = config.made_from(curation.Curation, read, strict=False)
    assert made.least_rows == 5 and made.prefer == ("atlas", "map") and made.weights["cells"] == 0.9 and made.weights["celltype"] == 1.0
    with pytest.raises(ValueError, match="model_size"):
        config.made_from(curation.Curation, read)
    assert config.read_config(spark, str(tmp_path / "empty.yaml")) == {}
    with pytest.raises(ValueError, match="mapping"):
        config.read_config(spark, str(tmp_path / "list.yaml"))


def test_places(spark):
    rows = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(700))).alias("a"), "id").repartition(7)
    got = {r["id"]: r["place"] for r in curation.placed(rows, F.desc("a"), "id").collect()}
    want = sorted(((-r["a"], r["id"]) for r in rows.collect()))
    assert got == {i: k for k, (_, i) in enumerate(want, 1)}
    assert curation.placed(rows.where("false"), "id").count() == 0


def test_labels_in_scope(spark):
    q = [(1, "Human", "Blood", ["A", "b"]), (2, "human", None, ["a", "c"]), (3, "mouse", "blood", ["a"]), (4, "human", "skin", ["x"]), (5, "human", "lung", [])]
    e = [(1, "human", "blood", "t", ["a"], 0.5), (2, "human", "lung", "t", ["c"], 0.9), (3, " HUMAN ", "all", "b", ["B", "b", "z"], 0.1), (4, "mouse", "", "m", ["a"], 0.1), (5, "human", "unknown", "t", ["q"], 0.7)]
    got = knowledge.retrieved_labels(spark.createDataFrame(q, "query_id int, species string, tissue string, genes array<string>"), spark.createDataFrame(e, "entry_id int, species string, tissue string, label string, genes array<string>, weight double"), 3, scoped=True).collect()
    want = [(1, "b", 1, 0.3333, 3, 2), (1, "t", 1, 0.3333, 5, 3), (2, "t", 2, 0.6667, 2, 1), (3, "m", 1, 1.0, 4, 1)]
    want[0:2] = [(1, "b", 1, 0.3333, 3, 1), (1, "t", 1, 0.3333, 5, 2)]
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_retrieval_does_not_depend_on_what_is_sent(spark, sent, monkeypatch):
    monkeypatch.setattr(knowledge, "SENT", sent)
    q = spark.createDataFrame([(1, "blood", ["a", "B", "b"]), (2, None, ["c"]), (3, "x", [])], "query_id int, tissue string, genes array<string>")
    e = spark.createDataFrame([(1, "t", "blood", ["A", "c"]), (2, "b", "", ["b"]), (3, "n", "lung", ["q"])], "entry_id int, label string, tissue string, genes array<string>")
    got = sorted((r["query_id"], r["entry_id"], r["shared"], r["score"], r["rank"]) for r in knowledge.retrieved(q, e, 2).collect())
    assert got == [(1, 1, 1, 0.5333, 2), (1, 2, 1, 0.7, 1), (2, 1, 1, 0.5, 1)]  # no bonus without a tissue of the query


def test_model_outputs(spark):
    from labelloom.operators.inference import with_outputs

    def load():
        return lambda texts, numbers: {"s": np.array([t.upper() for t in texts], dtype=object), "n": numbers * 2}

    rows = spark.createDataFrame([(k, f"t{k}", float(k)) for k in range(25)], "k int, t string, x double")
    got = with_outputs(rows, load, ["t", F.col("x") + 1], "m", StructType([StructField("s", StringType()), StructField("n", DoubleType())]), batch=4).collect()
    assert [(r["m"]["s"], r["m"]["n"]) for r in sorted(got)] == [(f"T{k}", 2.0 * k + 2) for k in range(25)]
    means = with_outputs(rows.withColumn("v", F.array("x", "x", F.lit(1.0))), lambda: lambda v: v.mean(axis=1), ["v"], "m", DoubleType(), shapes=[[3]]).collect()
    assert [r["m"] for r in sorted(means)] == pytest.approx([(2 * k + 1) / 3 for k in range(25)])


def test_small_sides_only_are_sent(spark):
    from labelloom.operators.sides import small

    plan = lambda n: spark.range(1000).join(small(spark.range(50), n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(50) and "broadcast" not in plan(49)


def test_compared_answers_that_are_missing(spark):
    kind = "struct<cell_type:string,confidence_label:string,decision:string,evidence_support_level:string,need_manual_review:string,novelty_flag:boolean,supporting_markers:array<string>>"
    full = ("T cell", "High", None, "weak", " yes", None, ["CD3-E", "cd4"])
    rows = spark.createDataFrame([(1, full, ("t-cell", "high ", None, None, "true", True, ["cd3 e"])), (2, None, full), (3, ("", "", "", "", "", False, []), ("", None, "", "", None, False, None))], f"k int, p {kind}, g {kind}")
    got = {r["k"]: r for r in rows.select("k", *(c.alias(n) for n, c in evaluation.compared_answers("p", "g").items())).collect()}
    one = got[1]
    assert (one["cell_type_match_level"], one["cell_type_exact_match"], one["confidence_label_match"], one["decision_match"], one["evidence_support_level_match"]) == ("exact", True, True, None, False)
    assert (one["need_manual_review_match"], one["novelty_flag_match"], one["supporting_markers_jaccard"], one["supporting_markers_shared"]) == (True, None, 0.5, 1)
    assert got[2]["cell_type_match_level"] == "unavailable" and all(v is None for n, v in got[2].asDict().items() if n not in ("k", "cell_type_match_level"))
    three = got[3].asDict()
    assert three["cell_type_match_level"] == "unavailable" and three["cell_type_exact_match"] is None and three["novelty_flag_match"] is True and three["supporting_markers_jaccard"] is None and three["supporting_markers_shared"] == 0


def test_comparison_binds_each_step(spark):
    """A label's rules are named a few times in the plan, not once for each use of what they give."""
    from labelloom.functions import labels as lb

    rows = spark.createDataFrame([("Treg", "T cell")], "p string, g string")
    plan = rows.select(lb.comparison("p", "g").alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("natural killer") < 40
    old = lb.compared_long("p", "g")
    assert rows.select(*(old[n].alias(n) for n in lb.PARTS)).first() == rows.select(lb.comparison("p", "g").alias("c")).select("c.*").first()


def test_scores_on_a_half_round_as_in_sql(spark):
    from labelloom.operators.knowledge import retrieved_labels

    genes = [f"g{k}" for k in range(800)]
    asked = spark.createDataFrame([(1, genes[:69]), (2, genes[:57])], "query_id long, genes array<string>")
    entry = spark.createDataFrame([(7, "L", genes, 1.0)], "entry_id long, label string, genes array<string>, weight double")
    assert {r["query_id"]: r["score"] for r in retrieved_labels(asked, entry).collect()} == {1: 0.0862, 2: 0.0712}


def test_ranks_are_cut_once(spark):
    """Approximate cuts made twice may differ: the plan of ranks reads them."""
    from labelloom.operators.order import placed

    rows = spark.createDataFrame([("g", float(k), 1) for k in range(50)], "gene string, value double, n long")
    plan = placed(rows, ["gene"], "value", "n", ranges=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan and "cuts" in plan


def test_cuts_are_searched_by_halves(spark):
    """Compiled steps, not a lambda run for each cut; as many cuts at most a value as bisection finds."""
    from bisect import bisect_right

    from labelloom.operators.order import _ranged, _upto, placed

    rows = spark.createDataFrame([("g", float(k), 1) for k in range(50)], "gene string, value double, n long")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (placed(rows, ["gene"], "value", "n", ranges=4), _ranged(rows, ["gene"], "value", 4))]
    assert all("lambda" not in plan for plan in plans)
    nan, inf = float("nan"), float("inf")
    values = [-inf, -1.0, -0.0, 0.0, 0.5, 1.0, 2.0, 6.0, 7.0, 99.0, inf, nan]
    tables = [[float(k) for k in range(n)] for n in range(8)] + [[-inf, 0.0, inf, nan], [0.0, 1.0, nan]]
    df = spark.createDataFrame([(k, cuts, v) for k, cuts in enumerate(tables) for v in [*values, None]], "k int, _cuts array<double>, v double")
    of = lambda v: (v != v, 0.0 if v != v else v)
    for r in _upto(df, "v", "at", 8).collect():
        assert r["at"] == (0 if r["v"] is None else bisect_right([of(c) for c in tables[r["k"]]], of(r["v"]))), r


def test_many_rows_are_spread_by_key(spark):
    """A stated number of partitions, one shuffle for a group within the key; few rows take none."""
    from labelloom.operators.sides import spread

    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    many = spread(df, 1000, "k", most_rows=100)
    assert many.rdd.getNumPartitions() == 10 and spread(df, 1000, "k", most_rows=250).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    assert many.groupBy("k", "id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
