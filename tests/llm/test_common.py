"""Shared helpers: components of odd graphs, folds, the shared folder."""

import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from labelloom.llm import common
from labelloom.sources.files import shared_dir


def roots(edges):
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for e in edges for x in e}


RNG = random.Random(9)
GRAPHS = {
    "chain": [(k, k + 1) for k in range(300)],
    "backward chain": [(1000 - k, 999 - k) for k in range(300)],
    "star": [(5, k) for k in range(10, 2000)],
    "two cliques": [(a, b) for a in range(20) for b in range(a)] + [(a, b) for a in range(50, 70) for b in range(50, a)],
    "random": [(RNG.randrange(-500, 500), RNG.randrange(-500, 500)) for _ in range(400)],
    "numbers of all sizes": [(k, k // 2) for k in range(-(2**63), 2**63 - 1, 2**54 + 1)] + [(2**63 - 1, 2**63 - 2), (2**63 - 2, 2**63 - 3)],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3), (4, 4)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name, monkeypatch):
    edges = GRAPHS[name]
    want = {n: r for n, r in roots([e for e in edges if e[0] != e[1]]).items()}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for forest in (common._local_forest, lambda batches: batches):  # with and without the shrinking beforehand
        monkeypatch.setattr(common, "_local_forest", forest)
        got = {r["node"]: r["root"] for r in common.components(df).collect()}
        assert all(want[n] == r for n, r in got.items())
        assert set(want) - set(got) <= set(want.values())


def test_fold(spark):
    got = {r["id"]: r["f"] for r in spark.range(200).select("id", common.fold("id", 5).alias("f")).collect()}
    assert all(f == crc32(str(i).encode()) % 5 for i, f in got.items())


def test_written_tables_lie_in_the_shared_folder(spark):
    df = common.written(spark.range(3), "x")
    assert all(f.startswith(shared_dir(spark)) for f in df.inputFiles())
    assert df.count() == 3


def test_small_sides_only_are_broadcast(spark):
    plan = lambda n: spark.range(1000).join(common.small(spark.range(50), n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(50) and "broadcast" not in plan(49)


def test_uniform_numbers(spark):
    r = spark.range(10_000).select(common.uniform(F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= r[0] < 0.01 and 0.99 < r[1] < 1 and abs(r[2] - 0.5) < 0.02


def test_hash_sample_takes_the_smallest_hashes(spark):
    df = spark.range(5000)
    h = F.xxhash64("id", F.lit(3))
    want = [r["id"] for r in df.orderBy(h).limit(50).collect()]
    assert [r["id"] for r in common.hash_sample(df, 50, 3, "id").collect()] == want
    assert [r["id"] for r in common.hash_sample(df.repartition(7), 50, 3, "id").collect()] == want
    assert common.hash_sample(df, 9000, 3, "id").count() == 5000 and common.hash_sample(df.where("false"), 5, 3, "id").count() == 0


def test_small_batches(spark):
    common.in_small_batches(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_same_rows(spark):
    rows = [(1, "a")] * 25 + [(2, None), (None, "a"), (None, "a")]
    got = common.same_rows(spark.createDataFrame(rows, "i long, s string"), ["i", "s"], chunk=10).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, [*(type(got[0])(i=1, s="a", nth=k) for k in range(25)), *(type(got[0])(i=i, s=s, nth=k) for i, s, k in ((2, None, 0), (None, "a", 0), (None, "a", 1)))]))
    hot = common.same_rows(spark.range(200_000).select(F.lit(7).alias("i")), ["i"], chunk=1000)
    assert hot.select("nth").distinct().count() == 200_000
