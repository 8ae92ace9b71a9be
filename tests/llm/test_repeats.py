"""Periodic runs against plain Python."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.llm import queries, repeats
from tests.llm import edges


def plain_runs(w, least=6, times=4):
    """All runs by trying each period at each place."""
    found = {}
    for q in range(1, len(w) // times + 1):
        k = 0
        while k + q < len(w):
            end = k
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end + q - k >= max(least, times * q):
                found.setdefault((k, end + q), q)
            k = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def ours(w, least=6, times=4):
    rows, kept = repeats._searched([[str(x).encode() for x in w]], least, times)
    return [(r["start"], r["length"], r["period"]) for r in rows[0]], kept[0]


def plain_kept(w, found):
    drop = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(str(x) for k, x in enumerate(w) if k not in drop)


@given(st.lists(st.integers(0, 2), max_size=90))
@settings(max_examples=300, deadline=None)
def test_few_words(w):
    got, kept = ours(w)
    assert sorted(got) == plain_runs(w) and kept == plain_kept(w, plain_runs(w))


def odd_words(seed):
    """Words with runs in runs: powers of random words, cut and joined."""
    rng = random.Random(seed)
    w = []
    while len(w) < 1500:
        base = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 30, 33, 64, 90, 130]))]
        if rng.random() < 0.4:
            base = base[: rng.randint(1, 3)] * rng.randint(2, 40) + base
        part = (base * rng.randint(1, 9))[rng.randrange(len(base)) :]
        w += part[: max(1, len(part) - rng.randrange(len(base)))]
    return w


@pytest.mark.parametrize("seed", range(30))
def test_runs_in_runs(seed):
    w = odd_words(seed)
    got, kept = ours(w)
    assert got == sorted(got, key=lambda r: (r[0], r[2])) and sorted(got) == plain_runs(w)
    assert kept == plain_kept(w, got)


@pytest.mark.parametrize("q", [1, 2, 5, 7, 8, 9, 12, 15, 16, 17, 24, 31, 32, 33, 47, 48, 63, 64, 65, 100])
def test_every_period_at_its_least_length(q):
    rng = random.Random(q)
    base = [rng.randrange(10_000) for _ in range(q)]
    for n in (4 * q - 1, 4 * q, 4 * q + 1, 5 * q):
        w = ["x", *(base * 6)[:n], "y", "z"]
        assert ours(w)[0] == plain_runs(w)


def test_fibonacci_and_texts_side_by_side():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert sorted(ours(b)[0]) == plain_runs(b)
    texts = [[str(x).encode() for x in w] for w in (b[:700], [1, 1], [1, 1, 1, 1, 1], [], odd_words(4)[:400], [1] * 6, [0, 1] * 9, [0, 1] * 9)]
    rows, kept = repeats._searched(texts, 6, 4)
    for w, r, k in zip(texts, rows, kept, strict=True):
        plain = [x.decode() for x in w]
        got = [(x["start"], x["length"], x["period"]) for x in r]
        assert sorted(got) == plain_runs(plain) and k == plain_kept(plain, got)


def test_hashes_only_propose(monkeypatch):
    """With hashes that hardly tell anything apart nothing false is found."""
    w = odd_words(1)[:600]
    monkeypatch.setattr(repeats, "_mixed", lambda a, b: (a * np.uint64(3) + b) % np.uint64(5))
    assert set(ours(w)[0]) <= set(plain_runs(w))


def test_long_text_takes_little_time():
    rng = random.Random(0)
    w = [rng.randrange(3) for _ in range(50_000)] * 5 + [7] * 200_000 + [1, 2, 3] * 50_000
    got = ours(w)[0]
    assert {(0, 250_000, 50_000), (250_000, 200_000, 1)} <= {(s, min(n, 250_000), q) for s, n, q in got if n > 100_000}


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(plain_kept(w, found)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op11_periodic_runs(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    docs = [r for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r["text"] or "") < 20_000]
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    for d in docs:
        assert rows[d["doc_id"]] == plain_row(d["doc_id"], d["text"])
    assert sum(r[1] > 0 for r in rows.values()) > 5


def test_odd_documents(spark):
    docs = edges.documents(spark)
    found = repeats.repetitions(docs.withColumn("text", repeats.planted("text", "doc_id")), carry=("doc_id", "label"))
    assert found.columns == ["doc_id", "label", "n_words", "runs", "collapsed"]
    rows = sorted((tuple(r) for r in repeats.with_digests(found).collect()), key=edges.key)
    long = lambda d: len((d["text"] or "").split()) > 5_000
    plain = [plain_row(d["doc_id"], d["text"]) for d in docs.collect() if not long(d)]
    assert set(plain) <= set(rows) and len(rows) == docs.count()
    assert any(r[1] == 1 and r[4] == 1 for r in rows)  # a text of one word over and over


def test_names_that_clash_and_no_rows(spark):
    docs = spark.createDataFrame([("a a a a a a", 1, "r")], "text string, n_words int, runs string")
    row = repeats.repetitions(docs, carry=("text", "n_words", "runs")).first()
    assert row.asDict() == {"text": "a a a a a a", "n_words": 1, "runs": "r", "n_words_": 6, "runs_": [(0, 6, 1)], "collapsed": "a"}
    assert repeats.with_digests(repeats.repetitions(edges.empty(spark))).count() == 0
    with pytest.raises(ValueError):
        repeats.repetitions(docs, times=3)


def test_planted_words(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 50))) for k in range(400)], "doc_id long, text string")
    for r in docs.select("doc_id", "text", repeats.planted("text", "doc_id").alias("now")).collect():
        h, w = crc32(str(r["doc_id"]).encode()), r["text"].split()
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert r["now"] == " ".join(w)
    assert docs.select(F.count_if(repeats.planted("text", "doc_id") != F.col("text"))).first()[0] > 20
