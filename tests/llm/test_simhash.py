"""SimHash operator against plain Python."""

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import simhash
from tests.llm import edges


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="abAÉ \t\n\x0b\x1c  ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_is_that_of_spark(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert simhash.fingerprint("a B c") == got % 2**64


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_chain_keys_find_every_pair(distance):
    rng, keys = random.Random(distance), simhash.chain_keys(distance)
    assert sum(simhash.segments(distance)) == 2**64 - 1
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance)))
        assert any(x & mask == 0 and all((x & m).bit_count() <= most for m, most in chains) for mask, chains in keys)


def check(rows):
    """Components of rows (positions) by brute force over the fingerprints, whatever their ids."""
    fps = sorted({int(r["fingerprint"], 16) for r in rows})
    top = edges.plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for r in rows:
        low.setdefault(top[int(r["fingerprint"], 16)], []).append(r["doc_id"])
    for r in rows:
        assert r["component_id"] == min((i for i in low[top[int(r["fingerprint"], 16)]] if i is not None), default=None)


def a_pair(word):
    """A text, and the same with one word changed, whose fingerprints differ in 1 to 3 bits."""
    words = [f"{word}{k * k % 997}" for k in range(300)]
    for k in range(300):
        other = " ".join([*words[:k], "other", *words[k + 1 :]])
        if 0 < (plain_fingerprint(" ".join(words)) ^ plain_fingerprint(other)).bit_count() <= 3:
            return " ".join(words), other


(TEXT, NEAR), (FAR, FAR_NEAR) = a_pair("w"), a_pair("x")


def two_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, _of string, _key int, `a.b` int")


def test_rows_without_an_id_link(spark):
    docs = two_rows(spark, [(1, TEXT, "x", 1, 1), (None, NEAR, "x", 1, 1)])
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1}
    assert [r["doc_id"] for r in simhash.deduplicated(docs).collect()] == [1]
    alone = two_rows(spark, [(None, TEXT, "x", 1, 1), (None, NEAR, "x", 1, 1), (None, FAR, "x", 1, 1), (None, FAR, "x", 1, 2)])
    assert {r["component_id"] for r in simhash.near_duplicates(alone).collect()} == {None}
    got = [(r["text"], r["a.b"]) for r in simhash.deduplicated(alone).collect()]
    assert len(got) == 2 and (FAR, 1) in got


def test_unrelated_texts_under_one_id_stay_apart(spark):
    docs = two_rows(spark, [(5, TEXT, "x", 1, 1), (5, FAR, "x", 1, 1), (7, FAR_NEAR, "x", 1, 1), (3, TEXT, "x", 1, 1)])
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(3, 3), (5, 3), (5, 5), (7, 5)]
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, TEXT), (5, FAR)]


def test_odd_documents(spark):
    docs = edges.documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((edges.key((r["doc_id"], f"{plain_fingerprint(r['text']):016x}")) for r in docs.collect())) == sorted(edges.key((r["doc_id"], r["fingerprint"])) for r in rows)
    check(rows)


def test_generated_documents(spark):
    check(simhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())


def test_dense_groups_take_the_block_path(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 2))) for b in base for _ in range(400)}
    rows = [(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(sorted(fps))]
    old, simhash.BLOCK = simhash.BLOCK, 32
    try:
        links = [(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame(rows, "fp long, node long")).collect()]
    finally:
        simhash.BLOCK = old
    by = {k: f for f, k in rows}
    near = lambda a, b: ((by[a] ^ by[b]) % 2**64).bit_count() <= 3
    joined = {frozenset(x) for x in links}
    assert edges.plain_components(list(by), near) == edges.plain_components(list(by), lambda a, b: frozenset((a, b)) in joined)


def test_empty(spark):
    assert simhash.near_duplicates(edges.empty(spark)).count() == 0
    assert simhash.deduplicated(edges.empty(spark)).count() == 0


@pytest.mark.parametrize("sent", [0, 500_000])
def test_one_of_each_group_stays(spark, sent, monkeypatch):
    monkeypatch.setattr(simhash, "SENT", sent)
    docs = edges.documents(spark)
    fps = {plain_fingerprint(r["text"]) for r in docs.collect()}
    top = edges.plain_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for r in docs.collect():
        mine = top[plain_fingerprint(r["text"])]
        first[mine] = min(first.get(mine, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(first.values())


def test_exploded_keys_are_never_sent(spark, monkeypatch):
    """Keys are 30 times the fingerprints, which Spark's estimate doesn't see: no join of theirs may go through the driver."""
    plans, plain = [], simhash.written

    def seen(df, name, *cols):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, *cols)

    monkeypatch.setattr(simhash, "written", seen)
    docs = spark.createDataFrame([(k, f"one two three four w{k // 2}") for k in range(40)], "doc_id long, text string")
    for out in (simhash.near_duplicates(docs), simhash.deduplicated(docs)):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [p for p in plans if "Join" in p]
    assert joins and not any("BroadcastHashJoin" in p and "_of" not in p for p in joins)  # _of: the kept ids, counted before
