"""Mixing and sharding: exact properties, and the plain-Python water level."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import common, mixing, sharding
from tests.llm import edges


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, full, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        for s in rest:
            out[s] = left * w[s] / total
        over = [s for s in rest if out[s] > most * sizes[s] + 1e-9]
        if not over:
            return out
        for s in over:
            out[s] = most * sizes[s]
            full.add(s)
        left = share * sum(sizes.values()) - sum(out[s] for s in full)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 50, None: 7}, {"a": 0, "b": 5}, {"z": 1}, {"é": 10, "z": 10, "Z": 10, "\U0001f600": 10, "￿": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_targets_of_very_many_sources(spark):
    df = spark.range(100_000).select(F.format_string("s%06d", "id").alias("source"), (F.col("id") % 50 * 7 + F.when(F.col("id") % 9 == 0, 40_000).otherwise(0)).alias("size"))
    want = plain_targets({r["source"]: r["size"] for r in df.collect()})
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_equal_rows_are_dealt_and_taken(spark):
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("copies"))
    rows = mixing.mixed(docs).groupBy("source_name").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 3 for r in rows) and sum(r["n"] for r in rows) == 30_000
    out = mixing.mixed_documents(docs, chunk=1000).groupBy("source").count().collect()
    assert {r["source"]: 3 * r["count"] for r in out} == {r["source_name"]: r["taken"] for r in rows}


def test_word_count(spark):
    rows = [(None, 0), ("", 0), (" \t\n\x0b\x0c\r", 0), ("a", 1), (" a  b\x0bc ", 3), ("a b\x1cc", 2)]
    df = spark.createDataFrame(rows, "text string, n int")
    assert df.where(common.word_count(F.col("text")) != F.col("n")).count() == 0


def check_mix(docs, rows, near):
    words = lambda t: len([w for w in (t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w])
    want = Counter(edges.key((r["doc_id"], words(r["text"]))) for r in docs.collect())
    assert want == Counter(edges.key((r["doc_id"], r["size"])) for r in rows)
    taken = defaultdict(int)
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source_name"]] += r["taken"]
    for r in rows:
        assert abs(taken[r["source_name"]] - r["target"]) <= max(near, 0.0)


def test_odd_documents(spark):
    docs = edges.documents(spark)
    rows = mixing.mixed(docs).collect()
    check_mix(docs, rows, max(r["size"] for r in rows))
    assert sorted(map(edges.key, rows)) == sorted(map(edges.key, mixing.mixed(docs).collect()))
    assert mixing.mixed(edges.empty(spark)).count() == 0


def test_hot_source_meets_its_target(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 37 AS int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    rows = mixing.mixed(docs).collect()
    check_mix(docs, rows, 37)


def test_expectation_of_copies(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(5 + id % 3 AS int))").alias("text"), F.lit("s").alias("source"))
    n, turns = Counter(), 14
    for seed in range(turns):
        for r in mixing.mixed(docs, share=0.4, seed=1000 * seed).collect():
            n[r["doc_id"]] += r["copies"]
    assert sum(n.values()) / turns / 40 == pytest.approx(0.4, abs=0.015)
    assert max(n.values()) < 14


@pytest.mark.parametrize("sent", [0, 500_000])
def test_mixed_documents(spark, sent, monkeypatch):
    monkeypatch.setattr(mixing, "SENT", sent)
    docs = edges.documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mixed(docs).collect():
        want[edges.key((r["doc_id"], r["source_name"]))] += r["copies"]
    assert +want == Counter(edges.key((r["doc_id"], r["source"])) for r in out.collect())
    assert mixing.mixed_documents(edges.empty(spark)).count() == 0


def check_shards(docs, rows, shards=8):
    want = Counter(edges.key((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))) for r in docs.collect())
    assert want == Counter(edges.key((r["doc_id"], r["size"], r["text_crc32"])) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))


def test_sharding(spark):
    for docs in (edges.documents(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = sharding.sharded(docs).collect()
        check_shards(docs, rows)
        assert sorted(map(edges.key, rows)) == sorted(map(edges.key, sharding.sharded(docs).collect()))
    assert sharding.sharded(edges.empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r["shard"], r["slot"]) for r in sharding.sharded(one).collect()] == [(0, 0)]


def test_equal_rows_lie_in_all_blocks(spark, monkeypatch):
    docs = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    hot = common.same_rows(docs.where("doc_id is null").select("doc_id"), ["doc_id"]).groupBy(F.pmod(F.xxhash64("doc_id", "nth"), F.lit(16))).count().collect()
    assert len(hot) == 16 and max(r["count"] for r in hot) < 2200
    for sent in (1 << 17, 0):
        monkeypatch.setattr(sharding, "SENT", sent)
        rows = sharding.sharded(docs).collect()
        check_shards(docs, rows)


def test_the_permutation_is_uniform(spark):
    """Neighbours part, places don't follow ids, and each eighth of the ids is spread evenly: bounds of five deviations."""
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for seed in (5, 77):
        at = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.sharded(docs, seed=seed).collect()}
        together = sum(at[d][0] == at[d + 1][0] for d in range(n - 1)) / (n - 1)
        assert abs(together - (n / 8 - 1) / (n - 1)) < 5 * (0.125 * 0.875 / n) ** 0.5
        ids, slots = list(range(n)), [at[d][1] for d in range(n)]
        assert abs(np.corrcoef(ids, slots)[0, 1]) < 5 / n**0.5
        cells = Counter((d // (n // 8), at[d][0]) for d in ids)
        assert all(abs(cells[a, b] - n / 64) < 5 * (n / 64) ** 0.5 for a in range(8) for b in range(8))


def test_matrix_margins(spark):
    sizes = {0: 100, 1: 0, 3: 57, 6: 1000, 7: 3}
    df = spark.createDataFrame(list(sizes.items()), "block long, n long")
    rows = {r["block"]: r["counts"] for r in sharding.communication_matrix(df, 3, 8).collect()}
    assert {b: sum(c) for b, c in rows.items()} == {b: sizes.get(b, 0) for b in range(8)}
    columns = [sum(c[j] for c in rows.values()) for j in range(8)]
    assert columns == [1160 // 8] * 8 and min(min(c) for c in rows.values()) >= 0


@pytest.mark.parametrize("good,total,draws", [(5, 12, 4), (3, 3, 2), (0, 5, 3), (40, 100, 30), (7, 9, 9)])
def test_hypergeometric_distribution(spark, good, total, draws):
    from math import comb

    n = 4000
    u = (F.col("id") + 0.5) / n
    got = Counter(r["x"] for r in spark.range(n).select(sharding.hypergeometric(F.lit(good), F.lit(total), F.lit(draws), u).alias("x")).collect())
    for k in range(draws + 1):
        chance = comb(good, k) * comb(total - good, draws - k) / comb(total, draws) if k <= good and draws - k <= total - good else 0
        assert abs(got[k] / n - chance) <= 2 / n
