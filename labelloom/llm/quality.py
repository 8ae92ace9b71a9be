"""Quality: gated-attention multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE words. Each passage is described by shares of character classes, word
lengths, repetition and a small hashed bag of words, and encoded by a tanh layer. Attention weights come from a gated
layer (tanh times sigmoid) and a softmax over the document; the weighted mean of the encodings gives the score. All
parameters are learnt from document labels alone, from at most `most` labelled documents (a documented bound), in
rounds: groups of documents, dealt by hash, each run Adam from the shared parameters, which are then averaged.

Nulls and blanks: a null or blank text is one passage of zeros and gets a score too. Without labels of both kinds
every score is the share of label 1 (0.5 without any label). Repeated rows each come back; label rows that repeat
count once. Very long texts are scored whole, in linear time. Labels that tie for one id are the larger one, texts
that tie for one the smaller. An empty table gives an empty result. Further columns stay out of the result, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import fold, in_small_batches, labelled_sample, written

PASSAGE, HASHED, HIDDEN, GATE, SHARDS = 48, 16, 16, 8, 4
WIDTH = 15 + HASHED
#: Class of each byte: 0 space, 1 A-Z, 2 a-z, 3 digit, 4 sentence mark, 5 other ASCII, 6 beyond ASCII.
CLASS = np.array([0 if c == 32 else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 4 if chr(c) in ".,;:?'\"-()" else 5 if c < 128 else 6 for c in range(256)], np.uint8)


def passages(text: str | None) -> np.ndarray:
    """Features of each passage of text: rows of WIDTH numbers."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    n, line = len(words), b" ".join(words)
    firsts = np.arange(0, n, PASSAGE)
    size = np.diff(np.append(firsts, n)).astype(np.float64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    kinds = CLASS[np.frombuffer(line, np.uint8)]
    at = np.append(0, ends[:-1] + 1)
    chars = np.add.reduceat(lengths, firsts).astype(np.float64)
    of = lambda x: np.add.reduceat(x.astype(np.int32), firsts)
    shares = [np.add.reduceat((kinds == k).astype(np.int32), at[firsts]) / chars for k in range(1, 7)]
    h = np.fromiter(map(crc32, words), np.uint32, n).astype(np.uint64)
    bag = np.arange(n) // PASSAGE
    same = np.append(False, h[1:] == h[:-1])
    order = np.sort(bag.astype(np.uint64) << np.uint64(32) | h)
    new = np.append(True, order[1:] != order[:-1])
    last, first = kinds[ends - 1], kinds[at]
    hashed = np.bincount(bag * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=len(firsts) * HASHED).reshape(-1, HASHED) / size[:, None]
    rest = [chars / size / 10, of(lengths == 1) / size, of(lengths > 12) / size, of(same) / size, of(new) / size, of(last == 5) / size, of(last == 4) / size, of(first == 1) / size, size / PASSAGE]
    return np.column_stack([*shares, *rest, hashed]).astype(np.float32)


SHAPES = ((WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,))


def start() -> list[np.ndarray]:
    rng = np.random.default_rng(17)
    return [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or s[0] > 1 and k in (4, 5) else np.zeros(s) for k, s in enumerate(SHAPES)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(p: list[np.ndarray], x: np.ndarray, firsts: np.ndarray) -> tuple:
    """Scores of bags that begin at rows firsts of x, and what the gradient needs."""
    sizes = np.diff(np.append(firsts, len(x)))
    h = np.tanh(x @ p[0] + p[1])
    t, s = np.tanh(h @ p[2]), _sigmoid(h @ p[3])
    e = (t * s) @ p[4]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, firsts), sizes))
    a = e / np.repeat(np.add.reduceat(e, firsts), sizes)
    z = np.add.reduceat(a[:, None] * h, firsts)
    return _sigmoid(z @ p[5] + p[6][0]), (sizes, h, t, s, a, z)


def gradient(p: list[np.ndarray], x: np.ndarray, firsts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss."""
    got, (sizes, h, t, s, a, z) = forward(p, x, firsts)
    d = (got - y) / len(y)
    dz = np.repeat(d[:, None] * p[5], sizes, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, firsts), sizes))
    dgate = de[:, None] * p[4]
    dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ p[2].T + ds @ p[3].T) * (1 - h * h)
    return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, np.array([d.sum()])]


def _bags(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows).astype(np.float64), np.cumsum([0, *map(len, rows[:-1])])


def _improve(p: list[np.ndarray], passes: int, seed: int):
    def improve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in pdf["bag"]]
        y, rng, step = pdf["label"].to_numpy(float), np.random.default_rng(seed), 0
        q, m, v = [w.copy() for w in p], [np.zeros(s) for s in SHAPES], [np.zeros(s) for s in SHAPES]
        for _ in range(passes):
            for ks in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 32)):
                step += 1
                for k, g in enumerate(gradient(q, *_bags([bags[i] for i in ks]), y[ks])):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    q[k] -= 0.01 * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return pd.DataFrame({"p": [np.concatenate([w.ravel() for w in q])], "n": [len(bags)]})

    return improve


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [passages(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 6_000, rounds: int = 4, passes: int = 5, folds: int = 5, held: int = 0) -> list[np.ndarray]:
    """Parameters learnt from at most `most` labelled texts outside the held-out fold."""
    rows = in_small_batches(labelled_sample(docs, labels, label, folds, held, most).select("doc_id", "label", "text")).mapInArrow(_bag_rows, "doc_id long, label int, bag binary")
    rows = written(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))), "bags")
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    p = start()
    if not n or ones in (0, n):
        share = ones / n if n else 0.5
        p[5][:], p[6][:] = 0, np.log((share + 1e-4) / (1 - share + 1e-4))
        return p
    for k in range(rounds):
        got = rows.groupBy("shard").applyInPandas(_improve(p, passes, k), "p array<double>, n long").collect()  # SHARDS rows
        mean, at = sum(np.array(r["p"]) * r["n"] for r in got) / sum(r["n"] for r in got), 0
        for i, s in enumerate(SHAPES):
            p[i], at = mean[at : at + int(np.prod(s))].reshape(s), at + int(np.prod(s))
    return p


def scored(docs: DataFrame, p: list[np.ndarray]) -> DataFrame:
    """doc_id and score of every row of docs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for at in range(0, batch.num_rows, 512):
                out.append(forward(p, *_bags([passages(t.as_py()) for t in batch.column(1)[at : at + 512]]))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(score, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0, most: int = 6_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    rows = scored(docs, train(docs, labels, most=most, folds=folds, held=held))
    return rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 6_000) -> DataFrame:
    """The rows of docs whose score reaches threshold, in their own columns."""
    p = train(docs, labels, most=most)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column("text"), [np.zeros(0)]
            for at in range(0, batch.num_rows, 512):
                out.append(forward(p, *_bags([passages(t.as_py()) for t in texts[at : at + 512]]))[0])
            yield batch.filter(pa.array(np.concatenate(out) >= threshold))

    return in_small_batches(docs).mapInArrow(keep, docs.schema)
