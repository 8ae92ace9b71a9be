"""Vector operators against brute force."""

import random

import numpy as np
import pytest

from labelloom.llm import ego_join, mih
from tests.llm import edges

DDL = "vec_id long, embedding array<float>, label int, class long, n int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, "x") for i, v, lab in rows], DDL)


def odd_rows():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 8))
    rows = [(k, (base[k % 6] + rng.normal(0, 0.15 * (k % 3), 8)).astype(np.float32).tolist(), [0, 1, None][k % 3 if k % 7 else 2]) for k in range(90)]
    rows += [(100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] + [1.0] * 7, 0), (103, [None] + [1.0] * 7, 0), (104, [float("inf")] * 8, 1), (105, [1.0, 2.0], 0), (106, [2.0, 4.0], 0), (107, [], 0)]
    rows += [(110 + k, rows[3][1], 0) for k in range(30)] + [(None, rows[3][1], 0), rows[4], rows[4], (200, [2 * x for x in rows[3][1]], 0)]
    return rows


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute_links(rows, least):
    """Links between positions."""
    out = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            (i, v, x), (j, w, y) = rows[a], rows[b]
            if x is None or x != y or not good(v) or not good(w) or len(v) != len(w):
                continue
            v, w = (x / np.abs(x).max() for x in (np.array(v, float), np.array(w, float)))
            if v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= least:
                out[a].add(b)
                out[b].add(a)
    return out


def brute_roots(rows, links):
    """For each position the smallest id reachable; null if there is none."""
    root = {}
    for start in range(len(rows)):
        if start not in root:
            front, all_ = [start], {start}
            while front:
                for y in links[front.pop()] - all_:
                    all_.add(y)
                    front.append(y)
            low = min((rows[k][0] for k in all_ if rows[k][0] is not None), default=None)
            root.update(dict.fromkeys(all_, low))
    return root


def check_links(rows, got, least=0.93):
    links = brute_links(rows, least)
    root = brute_roots(rows, links)
    want = sorted(edges.key((rows[k][0], len(links[k]), root[k], rows[k][0] == root[k])) for k in range(len(rows)))
    assert want == sorted(edges.key((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in got)


def test_odd_vectors(spark):
    rows = [r for r in odd_rows() if r[0] not in (4,)]
    check_links(rows, ego_join.near_vectors(table(spark, rows)).collect())


def test_vectors_without_an_id_link(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    for rows in ([(1, v, 0), (None, v, 0)], [(1, v, 0), (None, w, 0), (None, w, 0)], [(None, v, 0), (None, w, 0), (2, [-1.0, 0.0, 0.0], 0)]):
        check_links(rows, ego_join.near_vectors(table(spark, rows)).collect())


def test_doubles_stay_doubles(spark):
    rows = [(k, [1.0, x, 0.0], 0) for k, x in enumerate([0.0, 0.395, 0.3952273992, 0.3952273993, 0.39522740, 1e-9])] + [(20, [3e200, 1e200, 2e199], 0), (40, [3.1e200, 1e200, 1e199], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    check_links(rows, ego_join.near_vectors(df).collect())
    third = [(k, [1 / 3 + k / 7, k / 3, -1 / 3], 0) for k in range(25)]
    got = mih.nearest(spark.createDataFrame(third, "vec_id long, embedding array<double>, label int")).collect()
    want = brute_nearest(third)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == {(q, k): j for q, found in want.items() for k, (j, _) in enumerate(found, 1)}
    assert all(r["score"] == pytest.approx(dict(want[r["query_id"]])[r["vec_id"]], rel=1e-13, abs=1e-13) for r in got)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e-300, 2e-300]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in sorted(mih.nearest(huge).collect())] == [(2, 3e300 + 4), (1, 1.0)]


def test_repeated_ids(spark):
    rows = odd_rows() + [(5, [9.0] + [0.0] * 7, 0)]
    got = ego_join.near_vectors(table(spark, rows)).collect()
    links = brute_links(rows, 0.93)
    assert sorted(edges.key((rows[k][0], len(links[k]))) for k in range(len(rows))) == sorted(edges.key((r["vec_id"], r["n_links"])) for r in got)


def test_many_intervals_and_halves(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    rows = [(k, (centres[k % 5] + rng.normal(0, 0.25, 6)).astype(np.float32).tolist(), k % 2) for k in range(500)]
    old = ego_join.FLOATS, ego_join.LEAF
    ego_join.FLOATS, ego_join.LEAF = 16 * 6, 4
    try:
        check_links(rows, ego_join.near_vectors(table(spark, rows)).collect())
    finally:
        ego_join.FLOATS, ego_join.LEAF = old


def test_no_vectors(spark):
    assert ego_join.near_vectors(table(spark, [])).count() == 0
    assert [tuple(r) for r in ego_join.near_vectors(table(spark, [(1, None, 0)])).collect()] == [(1, 0, 1, True)]


def brute_nearest(rows, every=20, most=20):
    """Each query id's nearest (id, score) among all rows of its vectors' lengths; ids missing come last, once a vector."""
    use = sorted({(i is None, i or 0, tuple(v)) for i, v, _ in rows if good(v)})
    use = [(None if none else i, np.array(v, float)) for none, i, v in use]
    out = {}
    for i, v in use:
        if i is not None and i % every == 0:
            scored = [(-float(v @ w), j is None, j or 0) for j, w in use if j != i and len(w) == len(v)]
            out[i] = out.get(i, []) + scored
    return {i: [(None if none else j, -s) for s, none, j in sorted(scored)[:most]] for i, scored in out.items() if scored}


@pytest.mark.parametrize("radius", ["measured", "all"])
def test_nearest_of_odd_vectors(spark, radius, monkeypatch):
    rows = odd_rows()
    if radius == "all":
        monkeypatch.setattr(mih, "COVER", 1.0)
    got = {}
    for r in mih.nearest(table(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append(r)
    want = brute_nearest(rows)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        pairs = [(-r["score"], r["vec_id"] is None, r["vec_id"] or 0) for r in found]
        assert pairs == sorted(pairs) and q not in {r["vec_id"] for r in found}
        hits += len({r["vec_id"] for r in found} & {j for j, _ in want[q]})
        total += len(want[q])
    assert hits >= 0.9 * total


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], 0) for r in df.collect()]
    want = brute_nearest(rows)
    by = {i: np.array(v, float) for i, v, _ in rows}
    got = mih.nearest(df).collect()
    assert all(r["score"] == pytest.approx(float(by[r["query_id"]] @ by[r["vec_id"]]), abs=1e-14) for r in got)
    hits = sum(r["vec_id"] in {j for j, _ in want[r["query_id"]]} for r in got)
    assert len(got) == sum(map(len, want.values())) and hits >= 0.9 * len(got)


def test_isolated_queries_get_all_their_rows(spark, monkeypatch):
    monkeypatch.setattr(mih, "FLOATS", 500 * 64)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 64))
    centres /= np.sqrt((centres * centres).sum(1, keepdims=True))
    rows = [(k, (centres[k // 60] + rng.normal(0, 0.01, 64)).astype(np.float32).tolist(), 0) for k in range(2400)]
    rows += [(2400, (-centres.mean(0) / np.sqrt((centres.mean(0) ** 2).sum())).astype(np.float32).tolist(), 0)]
    got = {}
    for r in mih.nearest(table(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = brute_nearest(rows)
    assert {q: [k for k, _ in sorted(found)] for q, found in got.items()} == {q: list(range(1, len(w) + 1)) for q, w in want.items()}
    assert sum(len({j for _, j in got[q]} & {j for j, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("bits", [1, 8, 21, 64, 128, 130, 256])
def test_probing_finds_all_within_the_radius(bits):
    rng = np.random.default_rng(5)
    signs = rng.random((2000, bits)) < 0.5
    signs[1000:] = signs[:1000] ^ (rng.random((1000, bits)) < 0.05)
    code = mih.packed(signs)
    for radius in (0, 1, 3, 7, 8, 15, 20, 33, 47, 64, 110, 256):
        index = mih.Index(code, bits, radius)
        assert index.listed == (radius // len(index.short) <= mih.LISTED)
        for q in (0, 1500):
            want = np.flatnonzero((signs ^ signs[q]).sum(1) <= radius).tolist()
            assert index.within(code[q]).tolist() == want
        if index.listed and bits == 256:
            assert index.probed < 400


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8 if k < 200 else 4).astype(np.float32).tolist(), 0) for k in range(300)] + [(None, [1.0, 2.0, 3.0, 4.0], 0), (None, [1.0, 2.0, 3.0, 4.0], 0)]
    got = {}
    for r in mih.nearest(table(spark, rows)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = brute_nearest(rows)
    assert {q: len(w) for q, w in want.items()} == {q: len(g) for q, g in got.items()} and len(want) == 15
    assert sum(len({j for j, _ in w} & set(got[q].values())) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_nothing_to_search(spark):
    assert mih.nearest(table(spark, [])).count() == 0
    assert mih.nearest(table(spark, [(1, [1.0], 0), (2, [2.0], 0)])).count() == 0
    assert mih.nearest(table(spark, [(20, [1.0], 0)])).count() == 0
    assert [tuple(r) for r in mih.nearest(table(spark, [(20, [1.0], 0), (1, [3.0], 0), (2, [3.0], 0)])).collect()] == [(20, 1, 1, 3.0), (20, 2, 2, 3.0)]
