"""Packing: tokens against the tokenizer file, cuts, sequences, local search."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labelloom.llm import packing
from tests.llm import edges


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_tokens(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@given(st.one_of(st.text(max_size=60), st.text("aB1 \n\t'.sé ßÿ ’", max_size=60)))
@settings(max_examples=400, deadline=None)
def test_tokens(text):
    text = text.encode("utf-8", "ignore").decode()
    assert packing.tokens(text).tolist() == plain_tokens(text).tolist()


@pytest.mark.parametrize("text", [None, "", "x" * 5000, " " * 5000, "\n" * 3000 + "a", "a " * 3000, "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endoftext |>", "漢字かな 한국어 😀", "é", "don't DON'T"])
def test_known_tokens(text):
    assert packing.tokens(text).tolist() == plain_tokens(text).tolist()


def check(docs, rows, length=1024):
    got = defaultdict(list)
    for r in rows:
        got[r["sequence_id"]].append(r)
    for pieces in got.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) <= length
    want = Counter()
    for d in docs.collect():
        ids = plain_tokens(d["text"])
        first = len(ids) % length or length
        cuts = [0, *range(first, len(ids) + 1, length)]
        want.update(edges.key((d["doc_id"], k, a, b - a, crc32(ids[a:b].tobytes()))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert want == Counter(edges.key(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))) for r in rows)
    return len(got), -(-sum(r["length"] for r in rows) // length)


def test_added_tokens_have_their_ids():
    assert packing.tokens("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 2]


def test_odd_documents(spark):
    docs = edges.documents(spark)
    check(docs, packing.packed(docs).collect())
    assert packing.packed(edges.empty(spark)).count() == 0


def test_generated_documents_in_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used, least = check(docs, packing.packed(docs).collect())
    assert used <= least + 3


def test_many_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used, least = check(docs, packing.packed(docs, group=30).collect())
    assert used <= 1.1 * least


@given(st.lists(st.integers(1, 99), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_local_search_never_needs_more(sizes):
    sizes = np.array(sizes)
    first = packing.best_fit(sizes, 100)
    bins = packing.local_search(sizes, first, 100)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= len(first)


def test_local_search_empties_a_bin():
    sizes = np.array([60, 40, 50, 30, 20, 45, 55])
    worse = [[0], [1], [2, 3], [4], [5], [6]]
    assert len(packing.local_search(sizes, worse, 100)) < len(worse)
    rng = random.Random(4)
    sizes = np.array([rng.randint(5, 60) for _ in range(300)])
    spread = [[k] for k in range(300)]
    assert len(packing.local_search(sizes, spread, 100)) < 300


def test_very_many_short_documents():
    import time

    sizes = np.array([1] * 4000 + [2] * 1500 + [700] * 40)
    began = time.time()
    bins = packing.local_search(sizes, packing.best_fit(sizes, 1024), 1024)
    assert len(bins) == 40 and time.time() - began < 30  # no two of the long ones fit together
