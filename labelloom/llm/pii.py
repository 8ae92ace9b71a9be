"""Personal data by patterns, and information-theoretic sanitisation of the terms that reveal it.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers. The corpus then tells which terms reveal a
protected entity. Entities are the values themselves and what they share with others (`entities`): an address's
mailbox name and its domain, an IP network, a card's issuer, a phone's prefix. A term t standing within WINDOW words of
entity e, or being a word of a mailbox's name, discloses the share PMI(t; e) / IC(e) of e's information, with
PMI(t; e) = log(N n(t, e) / (n(t) n(e))) and IC(e) = log(N / n(e)), all n counts of documents. A share of 1 means that
e stands in every document with t. Terms whose share reaches THRESHOLD, and that stand beside e in at least SUPPORT
different texts, are spans too (kind `term`) wherever they occur: generalised by `sanitised`, as the base spans are.
Copies of one text give no support of their own, so a repeated page doesn't make its words telling.

Only documents with protected values give pairs. Pairs and counts are aggregated before they are shuffled. A term that
stands beside many other entities can't disclose nearly all of one, whatever its count: the documents in which it stands
beside any entity are a lower bound of n(t). Terms that could still pass are counted over all documents.

Nulls and blanks: a null text is an empty one and has no span; a null doc_id stays null. Repeated rows each come back.
Shares that tie with THRESHOLD pass. An empty table gives an empty result. `personal_data` leaves further columns out,
and `sanitised` passes them on, so clashing names can't matter. Very long texts are read whole, and long runs of
letters, digits or blanks take linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import fresh, in_small_batches, written

WINDOW, SUPPORT, THRESHOLD = 6, 2, 0.95
#: Most hashed terms that are sent to every executor (8 bytes each); beyond that terms and documents are joined.
SENT = 1 << 20
#: The hash that stands for an entity of any kind.
ANY = 0
# The patterns, without what backtracking could retry in vain.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
TERM = re.compile(r"[^\W_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


class Covered:
    """The stretches of a text that spans cover, merged, so that a look-up takes logarithmic time."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        """Whether a stretch shares a character with [a, b)."""
        k = bisect_right(self.ends, a)
        return k < len(self.ends) and self.starts[k] < b


def entities(kind: str, value: str) -> list[str]:
    """What a value stands for, the narrowest first: itself, then what it shares with other values."""
    if kind == "email":
        name, domain = value.lower().rsplit("@", 1)
        return [f"email:{name}@{domain}", f"mailbox:{name}", f"domain:{domain}"]
    if kind == "ip":
        return [f"ip:{value}", "network:" + value.rsplit(".", 1)[0]]
    digits = re.sub(r"\D", "", value)
    return [f"{kind}:{digits}", f"{kind} prefix:{digits[:6]}"]


def terms_in(text: str) -> set[str]:
    """The terms of a text. A match is put in lower case by itself: that of a whole text can cut words elsewhere."""
    return {t.lower() for t in set(TERM.findall(text))}


def _beside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, set[str]]]:
    """Each entity of each span with the terms that stand within WINDOW words of it or in its mailbox's name."""
    covered, words = Covered(spans), list(TERM.finditer(text))
    starts, ends = [m.start() for m in words], [m.end() for m in words]
    for kind, a, b in spans:
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        near = words[max(0, before - WINDOW) : before] + words[after : after + WINDOW]
        terms = {m[0].lower() for m in near if not covered.meets(m.start(), m.end())}
        if kind == "email":
            terms |= {t for t in terms_in(text[a:b].rsplit("@", 1)[0]) if not t.isdigit()}
        for entity in entities(kind, text[a:b]):
            yield entity, terms


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document and entity (term null), and for each document, entity and term; ANY is every entity."""
    for batch in batches:
        rows = []
        for text in batch.column(0):
            text = text.as_py() or ""
            spans = base_spans(text)
            if spans:
                found: dict[str, set[str]] = {}
                for entity, terms in _beside(text, spans):
                    found.setdefault(entity, set()).update(terms)
                own = _hash(text)
                found = {_hash(entity): set(map(_hash, terms)) for entity, terms in found.items()}
                found[ANY] = set().union(*found.values())
                for e, terms in found.items():
                    rows += [(e, None, own), *((e, t, own) for t in terms)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["value", "term", "own"])


def _counted(wanted: Broadcast | None):
    """Number of documents with each term, of those in wanted (None: all)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = None if wanted is None else frozenset(wanted.value.tolist())
        for batch in batches:
            n: Counter[int] = Counter()
            for text in batch.column(0):
                terms = set(map(_hash, terms_in(text.as_py() or "")))
                n.update(terms if sought is None else terms & sought)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    return count


def _sent(terms: DataFrame) -> Broadcast:
    """Hashed terms, SENT at most, as an array on every executor."""
    return terms.sparkSession.sparkContext.broadcast(terms.toPandas()["term"].to_numpy(np.int64))


def disclosing(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """Hashed terms that reveal a protected entity: one column, term."""
    texts = in_small_batches(docs.select("text"))
    by_text = texts.mapInArrow(_pairs, "value long, term long, own long").groupBy("value", "term", "own").agg(F.count("*").alias("n"))
    pairs = written(by_text.groupBy("value", "term").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where(F.col("texts") >= support), "pairs")
    values = pairs.where((F.col("value") != ANY) & F.col("term").isNull()).select("value", F.col("n").alias("n_value"))
    least = pairs.where((F.col("value") == ANY) & F.col("term").isNotNull()).select("term", F.col("n").alias("least"))
    log_n = float(np.log(max(2, docs.count())))
    most = F.log("n") + (1 - threshold) * (log_n - F.log("n_value"))  # of the logarithm of n(t), for a share of threshold
    pairs = pairs.where((F.col("value") != ANY) & F.col("term").isNotNull()).join(values, "value").join(least, "term").where(F.log("least") <= most + 1e-9)
    pairs = written(pairs.select("value", "term", "n", "n_value"), "candidates")
    sought = written(pairs.select("term").distinct(), "sought")
    few = sought.limit(SENT + 1).count()
    if not few:
        return sought
    wanted = _sent(sought) if few <= SENT else None
    counts = texts.mapInArrow(_counted(wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    share = (log_n + F.log("n") - F.log("n_term") - F.log("n_value")) / (log_n - F.log("n_value"))
    told = pairs.join(counts, "term").where((F.col("n_value") < np.exp(log_n)) & (share >= threshold - 1e-12))
    return written(told.select("term").distinct(), "disclosing")


def _with_terms(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """docs with a last column of the telling terms in each text, if they are too many to send; else the terms."""
    told, own = fresh(docs, "told"), fresh(docs, "own")
    if terms.limit(SENT + 1).count() <= SENT:
        return docs.withColumn(told, F.lit(None).cast("array<bigint>")), _sent(terms)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t) for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t in set(map(_hash, terms_in(text.as_py() or "")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["own", "term"])

    keyed = docs.withColumn(own, F.xxhash64("text"))
    found = keyed.select(own, "text").mapInArrow(words, "own long, term long").distinct().join(terms, "term").groupBy(F.col("own").alias(own)).agg(F.collect_set("term").alias(told))
    return keyed.join(found, own, "left").drop(own), None


def _term_spans(text: str, told, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not told:
        return []
    covered = Covered(spans)
    return [("term", m.start(), m.end()) for m in TERM.finditer(text) if _hash(m[0].lower()) in told and not covered.meets(m.start(), m.end())]


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, sent = _with_terms(rows, disclosing(rows, threshold, support))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if sent is None else frozenset(sent.value.tolist())
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                more = _term_spans(text, own.as_py() if known is None else known, base)
                n = Counter(k for k, _, _ in base)
                out.append((*(n[k] for k in KINDS), sha256(_join(base).encode()).hexdigest(), _join(base + more), len(more)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term"])

    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def generalised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind; of spans that overlap one stands for all."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def sanitised(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """docs with the personal data in text generalised; n_chars, where there is one, counted again. Null texts stay null."""
    rows, sent = _with_terms(docs, disclosing(docs, threshold, support))
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if sent is None else frozenset(sent.value.tolist())
        for batch in batches:
            out = []
            for text, own in zip(batch.column(names.index("text")), batch.column(len(names)), strict=True):
                text = text.as_py()
                if text:
                    base = base_spans(text)
                    text = generalised(text, base + _term_spans(text, own.as_py() if known is None else known, base))
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(k) for k, c in enumerate(names)], names)

    done = rows.select(*(f"`{c}`" for c in [*names, next(c for c in rows.columns if c not in names)])).mapInArrow(clean, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done
