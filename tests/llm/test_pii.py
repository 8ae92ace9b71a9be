"""Personal data: spans against the plain patterns, telling terms, sanitised texts."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import pii
from tests.llm import edges


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@given(st.one_of(st.text("ab@.-_%+1 é", max_size=40), st.text("0123456789.", max_size=40), st.text("0123456789 -+().", max_size=60), st.text("04 -", min_size=15, max_size=40)))
@settings(max_examples=1500, deadline=None)
def test_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "4111-1111-1111-1111 and 4111111111111112", "x 4242424242424242x", "a@b.c@d.e", "a@@b.co", "@a.b", "1.2.3.4.5.6.7.8", "999.1.1.1 01.002.3.4", "+1 (555) 123-4567", "+49+49 30 1234567", "é@a.de", "0" * 19])
def test_known_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 1_000_000 + " x@y.zz", "1" * 1_000_000, "1." * 300_000, "+1" + " " * 500_000, "a@" * 300_000, "1 " * 300_000):
        pii.base_spans(text)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=8), st.integers(0, 35), st.integers(1, 5))
@settings(max_examples=500, deadline=None)
def test_covered(found, a, n):
    spans = [("x", start, start + length) for start, length in found]
    assert pii.Covered(spans).meets(a, a + n) == any(x < a + n and a < y for _, x, y in spans)


def test_very_many_values_in_one_text():
    text = " ".join(f"write to user{k}@mail.example or call" for k in range(20_000))
    spans = pii.base_spans(text)
    assert len(spans) == 20_000
    assert len(list(pii._beside(text, spans))) == 60_000
    assert len(pii._term_spans(text, {pii._hash("write")}, spans)) == 20_000


def test_odd_documents(spark):
    docs = edges.documents(spark)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    rows = pii.personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        line = ",".join(s for s in r["spans"].split(",") if s and not s.startswith("term:"))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert line in {",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t)) for t in texts[r["doc_id"]]}
    assert pii.personal_data(edges.empty(spark)).count() == 0
    assert pii.sanitised(edges.empty(spark)).count() == 0


def corpus(spark):
    """zorblax stands only beside one address, in four different texts; the other words stand everywhere."""
    rows = [(k, f"n{k} call zorblax at joe@corp.example today please") for k in range(4)]
    rows += [(10 + k, f"we call you today n{k} please at noon") for k in range(40)]
    rows += [(60, "zorblax was here"), (61, "copied lurgle sam@one.example"), (62, "copied lurgle sam@one.example"), (63, "copied lurgle sam@one.example"), (64, "mail joe@corp.example please")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain_terms(texts, threshold, support):
    """Disclosing terms by the definitions, over sets of positions."""
    with_term, with_entity, pairs = {}, {}, {}
    for k, text in enumerate(texts):
        spans = plain_spans(text)
        inside = {at for _, a, b in spans for at in range(a, b)}
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
        for _, _, w in words:
            with_term.setdefault(w, set()).add(k)
        for kind, a, b in spans:
            near = [x for x in words if x[1] <= a][-6:] + [x for x in words if x[0] >= b][:6]
            terms = {w for x, y, w in near if not inside & set(range(x, y))}
            if kind == "email":
                terms |= {w for w in re.findall(r"[^\W_]+", text[a:b].lower().rsplit("@", 1)[0]) if not w.isdigit()}
            for e in pii.entities(kind, text[a:b]):
                with_entity.setdefault(e, set()).add(k)
                for w in terms:
                    pairs.setdefault((w, e), set()).add(k)
    out, n = set(), len(texts)
    for (w, e), both in pairs.items():
        n_e = len(with_entity[e])
        if n_e < n and len({texts[k] for k in both}) >= support:
            pmi = math.log(n * len(both) / (len(with_term[w]) * n_e))
            if pmi / math.log(n / n_e) >= threshold - 1e-12:
                out.add(w)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_terms_of_random_corpora(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["rare", "Éclair", "x_y", "9"]
    values = ["joe.rare@corp.example", "ann@corp.example", "10.1.2.3", "10.1.2.77", "4111 1111 1111 1111", "+1 (017) 555-7713", "a" * 300]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.93 else rng.choice(values) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += [f"w{k} zork joe.rare@corp.example" for k in range(5)] + ["secret of 10.1.2.3"] * 4 + ["", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = 0
    for threshold, support in ((0.9, 2), (0.6, 2), (0.5, 3)):
        want = plain_terms(texts, threshold, support)
        some += len(want)
        assert {r["term"] for r in pii.disclosing(docs, threshold, support).collect()} == {pii._hash(w) for w in want}
        for r in pii.personal_data(docs, threshold, support).collect():
            text = texts[r["doc_id"]]
            inside = {at for _, a, b in plain_spans(text) for at in range(a, b)}
            terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in want and not inside & set(range(*m.span()))]
            assert [x for x in r["spans"].split(",") if x.startswith("term:")] == terms and r["n_term"] == len(terms)
    assert some > 3


def test_words_whose_lower_case_is_odd(spark):
    """A term is the same whether it stands beside a value, is counted, or is found."""
    words = ["İstanbul", "ΟΔΟΣ", "ǅungla", "Straße", "ﬁn", "ÀB"]
    texts = [f"note {k} {word} mail x@y{n}.org" for n, word in enumerate(words) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts + [f"other text {k} of words" for k in range(200)])), "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    for k, text in enumerate(texts):
        word = words[k // 3]
        at = text.index(word)
        assert f"term:{at}:{at + len(word)}" in rows[k].split(",")
    assert not any("term" in rows[k] for k in range(len(texts), len(texts) + 200))


def test_planted_telling_words(spark):
    """Names that stand beside one entity only, in different texts, are found, and hardly anything else is."""
    rng = random.Random(12)
    common = [f"word{k}" for k in range(300)]
    names = [f"Zorgan{k}" for k in range(60)]
    line = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [f"{line(12)} {name} {rng.choice(['writes to', 'of', 'at'])} box{k}@host{k}.example {line(12)}" for k, name in enumerate(names) for _ in range(3)]
    texts += [f"{line(10)} {name} {line(10)}" for name in names[:20]]  # also without the value: told apart by how much a name discloses
    texts += [line(30) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold, least in ((0.95, 40), (0.85, 60)):
        found = {texts[r["doc_id"]][int(a) : int(b)].lower() for r in pii.personal_data(docs, threshold).collect() for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x) if kind == "term"}
        right = found & {n.lower() for n in names}
        assert len(right) >= least and len(right) >= 0.97 * len(found)


def test_words_are_counted_not_characters():
    text = "one " + "b" * 300 + " joe@corp.example " + "c" * 500 + " seven"
    near = dict(pii._beside(text, pii.base_spans(text)))["email:joe@corp.example"]
    assert near == {"one", "b" * 300, "c" * 500, "seven", "joe"}


def test_telling_terms(spark):
    docs = corpus(spark)
    rows = {r["doc_id"]: r for r in pii.personal_data(docs, threshold=0.85).collect()}
    n, n_value, n_term, both = docs.count(), 5, 5, 4
    assert math.log(n * both / (n_term * n_value)) / math.log(n / n_value) >= 0.85
    assert rows[60]["spans"] == "term:0:7" and rows[0]["n_term"] == 1
    assert rows[61]["n_term"] == 0 and rows[10]["spans"] == ""  # copies are one text; common words tell nothing
    assert rows[64]["spans"] == "email:5:21"


def test_joined_terms_give_the_same(spark):
    docs = corpus(spark)
    want = sorted(map(tuple, pii.personal_data(docs, threshold=0.85).collect()))
    clean = sorted(map(tuple, pii.sanitised(docs, threshold=0.85).collect()))
    old, pii.SENT = pii.SENT, 0
    try:
        assert sorted(map(tuple, pii.personal_data(docs, threshold=0.85).collect())) == want
        assert sorted(map(tuple, pii.sanitised(docs, threshold=0.85).collect())) == clean
    finally:
        pii.SENT = old


def test_sanitised(spark):
    docs = corpus(spark)
    got = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, threshold=0.85).collect()}
    assert got[0] == "n0 call [TERM] at [EMAIL] today please" and got[60] == "[TERM] was here"
    odd = edges.documents(spark)
    out = pii.sanitised(odd)
    assert out.schema == odd.schema and out.count() == odd.count()


def test_overlapping_spans_are_one():
    text = "x +1 4111 1111 1111 1111 y"
    spans = [("card", 3, 24), ("phone", 2, 24)]
    assert pii.generalised(text, spans) == "x [PHONE] y"
