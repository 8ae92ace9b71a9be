"""Toxicity and quality: plain code beside features, updates and scores; held-out accuracy, gradients, odd inputs."""

import math
import re
from zlib import crc32

import numpy as np
import pytest

from labelloom.llm import quality, toxicity
from tests.llm import edges

FOLDER = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1.0
    y = np.asarray(y)
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("f,name,least,remainder", [(toxicity.toxicity, "toxic", 0.85, (3, 1)), (quality.quality, "quality", 0.9, (5, 0))])
def test_held_out_accuracy(spark, f, name, least, remainder):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = f(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % remainder[0] == remainder[1]) for r in rows)
    truth = {r["doc_id"]: r[name] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc(*zip(*held, strict=True)) >= least


@pytest.mark.parametrize("f,threshold", [(toxicity.toxicity, 0.7), (quality.quality, 0.3)])
def test_odd_documents(spark, f, threshold):
    docs = edges.documents(spark)
    for labels in (edges.labels(spark), edges.no_labels(spark)):
        rows = f(docs, labels).collect()
        assert sorted(edges.key((r["doc_id"],)) for r in rows) == sorted(edges.key((r["doc_id"],)) for r in docs.collect())
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) and r["held_out"] is not None for r in rows)
    assert f(edges.empty(spark), edges.no_labels(spark)).count() == 0


def test_held_out_labels_do_not_matter(spark):
    docs, labels = edges.documents(spark), edges.labels(spark)
    from labelloom.llm.common import fold

    flipped = labels.selectExpr("doc_id", "quality", f"CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert fold("doc_id", 3) is not None
    got = [sorted(edges.key(r) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, flipped)]
    assert got[0] == got[1]


def test_gradient_of_attention():
    rng = np.random.default_rng(0)
    p, x, firsts, y = quality.start(), rng.normal(size=(9, quality.WIDTH)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])
    p = [w + rng.normal(0, 0.1, w.shape) for w in p]
    loss = lambda: -np.mean(y * np.log(s := quality.forward(p, x, firsts)[0]) + (1 - y) * np.log(1 - s))
    for k, g in enumerate(quality.gradient(p, x, firsts, y)):
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        p[k][at] += 1e-6
        up = loss()
        p[k][at] -= 2e-6
        down = loss()
        p[k][at] += 1e-6
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_attention_sums_to_one():
    x, firsts = np.random.default_rng(1).normal(size=(7, quality.WIDTH)), np.array([0, 3])
    a = quality.forward(quality.start(), x, firsts)[1][4]
    assert np.add.reduceat(a, firsts) == pytest.approx([1, 1])


def test_l1_keeps_few_weights():
    rng, model = np.random.default_rng(2), toxicity.Ftrl()
    for k in range(300):
        noise = rng.integers(0, 1 << toxicity.BITS, 50)
        model.learn(np.unique(np.append(noise, [7] * (k % 2) + [1 << toxicity.BITS])), k % 2)
    w = model.weights(np.arange(1 << toxicity.BITS))
    assert w[7] > 1 and (w != 0).sum() < 20


def test_rejected_documents_go(spark):
    docs, labels = edges.documents(spark), edges.labels(spark)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    scores = {edges.key((r["doc_id"],)): r["score"] for r in quality.quality(docs, labels).collect()}
    ids = {edges.key((r["doc_id"],)) for r in kept.collect()}
    assert all((scores[k] >= 0.3) == (k in ids) for k in scores if not k[0][0])
    assert quality.accepted(edges.empty(spark), edges.no_labels(spark)).count() == 0


ODD_TEXTS = [None, "", " \t\n", "word", "Two WORDS!", "it's a b-c d_e  longest-words 12345678 é ÜBER ñandúes", "same same same " * 40, "\x00\x1c \x7f", "漢字かな 😀 " * 3, "a" * 500 + " " + "b" * 6]


def plain_features(text):
    """Hashed words, stems and pairs, one by one, with Python's unbounded numbers."""
    low = "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) if c > 127 or chr(c).isalnum() else " " for c in (text or "").encode())
    words = [w.encode("latin-1") for w in low.split(" ") if w]
    top = lambda x: (x % 2**32) >> 12
    h = [crc32(w) for w in words]
    out = [top(x * 2654435761) for x in h]
    out += [top((crc32(w[:5]) * 2654435761 % 2**32) ^ 1540483477) for w in words if len(w) > 5]
    for gap in (1, 2, 3):
        for x, y in zip(h, h[gap:], strict=False):
            out.append(top((x * 2654435761 % 2**32 ^ (y * 2246822519 + 977 * gap) % 2**32) * 3266489917))
    return out


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_features_against_plain_code(text):
    assert sorted(toxicity.features(text).tolist()) == sorted(plain_features(text))


def test_ftrl_against_plain_code():
    """The update and the weights as published, coordinate by coordinate."""
    alpha, beta, l1, l2, bias = 2.0, 1.0, 6.0, 1.0, 1 << toxicity.BITS
    rng, model, z, n = np.random.default_rng(4), toxicity.Ftrl(alpha, beta, l1, l2), {}, {}

    def weight(i):
        lam = 0.0 if i == bias else l1
        if abs(z.get(i, 0.0)) <= lam:
            return 0.0
        return (math.copysign(lam, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(400):
        at, y = sorted({*rng.integers(0, 12, 4).tolist(), bias}), int(rng.integers(0, 2))
        model.learn(np.array(at), y)
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    some = [*range(12), bias]
    assert model.weights(np.array(some)).tolist() == pytest.approx([weight(i) for i in some])
    assert any(weight(i) for i in range(12)) and not all(weight(i) for i in range(12))


def test_toxicity_scores_against_plain_code(spark):
    rng = np.random.default_rng(5)
    at = np.unique(np.concatenate([toxicity.features(t) for t in ODD_TEXTS]).astype(np.int64))[::2]
    weights = dict(zip([*at.tolist(), 1 << toxicity.BITS], [*rng.normal(size=len(at)).tolist(), -0.5], strict=True))
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, (np.array(list(weights)), np.array(list(weights.values())))).collect()}
    for k, text in enumerate(ODD_TEXTS):
        odds = sum(weights.get(i, 0.0) for i in set(plain_features(text))) - 0.5
        assert got[k] == pytest.approx(1 / (1 + math.exp(-odds)))


def plain_passages(text):
    """The features of each passage of 48 words, one by one."""
    words = [w for w in re.split(rb"[ \t-\r]+", (text or "").encode()) if w]
    rows = []
    for at in range(0, len(words), 48):
        own = words[at : at + 48]
        n, chars = len(own), sum(map(len, own))
        kind = lambda c: 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 4 if chr(c) in ".,;:?'\"-()" else 5 if c < 128 else 6
        kinds = [kind(c) for w in own for c in w]
        # A word counts as repeated also if it repeats the last of the passage before.
        again = sum(w == (words[at + k - 1] if at + k else None) for k, w in enumerate(own))
        row = [kinds.count(k) / chars for k in range(1, 7)]
        row += [chars / n / 10, sum(len(w) == 1 for w in own) / n, sum(len(w) > 12 for w in own) / n, again / n, len(set(own)) / n]
        row += [sum(kind(w[-1]) == 5 for w in own) / n, sum(kind(w[-1]) == 4 for w in own) / n, sum(kind(w[0]) == 1 for w in own) / n, n / 48]
        rows.append(row + [sum(crc32(w) % 16 == k for w in own) / n for k in range(16)])
    return rows or [[0.0] * 31]


@pytest.mark.parametrize("text", [t for t in ODD_TEXTS if not t or "\x00" not in t])
def test_passages_against_plain_code(text):
    got = quality.passages(text)
    assert got.shape == np.shape(plain_passages(text)) and got == pytest.approx(np.array(plain_passages(text)), abs=1e-6)


def test_quality_scores_against_plain_code(spark):
    rng = np.random.default_rng(6)
    p = [w + rng.normal(0, 0.3, w.shape) for w in quality.start()]
    texts = [t for t in ODD_TEXTS if not t or "\x00" not in t] + [" ".join(rng.choice(["aa", "B.", "c7", "é"], 500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, p).collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for k, text in enumerate(texts):
        bag = [np.float32(x).astype(float) for x in plain_passages(text)]
        coded = [[math.tanh(sum(x * w for x, w in zip(row, p[0][:, j], strict=True)) + p[1][j]) for j in range(16)] for row in bag]
        raw = [sum(p[4][g] * math.tanh(sum(h[j] * p[2][j][g] for j in range(16))) * sigmoid(sum(h[j] * p[3][j][g] for j in range(16))) for g in range(8)) for h in coded]
        share = [math.exp(a) for a in raw]
        whole = [sum(a * h[j] for a, h in zip(share, coded, strict=True)) / sum(share) for j in range(16)]
        assert got[k] == pytest.approx(sigmoid(sum(z * w for z, w in zip(whole, p[5], strict=True)) + p[6][0]), abs=1e-5)
