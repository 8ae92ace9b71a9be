"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of consecutive words with smallest period q that is at least 4 * q words long and that no
neighbouring word extends. Runs of small periods are the highly periodic regions: each period below FIRST is compared
directly, word by word. All others are found at the scale t, a power of two, with t <= q < 2 * t:

* A position is selected if the smallest hash of the t-word stretches beginning in the next t + 1 positions is at
  either end of them. Stretches with a period of t / 4 at most take no part; they lie in runs of smaller periods, which
  are known by then. So it depends on 2 * t words alone whether a position is selected, and any 3 * t - 1 words without
  so small a period hold a selected position among their first t.
* The first 3 * t - 1 words of a run are such words, as t <= q. Their selected position is selected again q words on,
  as the same 2 * t words follow there, and both contexts end within 4 * q words. So each run has two selected positions
  with the same context at distance q. Equal contexts are met by sorting; closer than t / 4 there are none, so each
  position proposes at most seven periods.
* A proposed period is compared word by word, in both directions, until it fails. Hashes only propose, so the result
  doesn't depend on them.

Texts of one Arrow batch lie behind each other in one array, longest first, with a separator of its own behind each, so
a scale costs some array passes over the texts that are long enough for it. Work is about n log n for n words.

Nulls and blanks: a null, empty or blank text has no words, no runs and an empty collapsed text. Repeated rows are
treated alike. Very long texts are searched whole, each in the memory of its own words. Ties don't arise: a stretch
that several periods describe is a run of the smallest. An empty table gives an empty result. Columns carried along
keep their names; result columns whose names are taken get underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from labelloom.llm.common import fresh, in_small_batches, word_count

#: Periods below it are compared directly; a power of two. Words of a batch that are searched in one array.
FIRST, AT_ONCE = 8, 1 << 19
TOP = np.uint64(2**64 - 1)
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches of True."""
    at = np.flatnonzero(true)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1


def _agreement(w: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The maximal stretch around at of positions x with w[x] == w[x + q]; empty if at is none."""
    low = high = at
    step = 64
    while high + q < len(w):
        same = w[high : high + step][: len(w) - q - high] == w[high + q : high + q + step]
        if not same.all():
            high += int(same.argmin())
            break
        high, step = high + len(same), step * 2
    step = 64
    while low > 0 and high > at:
        first = max(0, low - step)
        same = (w[first:low] == w[first + q : low + q])[::-1]
        if not same.all():
            low -= int(same.argmin())
            break
        low, step = first, step * 2
    return low, high


def selected(h: np.ndarray, t: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Positions of the synchronising set of scale t, by h, the hash of the t words from each position on; found: runs."""
    h = h.copy()
    for start, end, q in found:
        if 4 * q <= t <= end - start:
            h[start : end - t + 1] = TOP
    low, width = h, 1
    while width < t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:-1], low[1:])
    return np.flatnonzero(((low == h[: len(low)]) | (low == h[t : t + len(low)])) & (low != TOP))


def proposed(h: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods from t to 2 * t - 1 at which two selected positions have the same 2 * t words ahead."""
    at = at[at + t < len(h)]
    context = _mixed(h[at], h[at + t])
    order = np.argsort(context, kind="stable")
    context, at = context[order], at[order]
    begins, periods = [at[:0]], [at[:0]]
    for nth in range(1, len(at)):
        apart = at[nth:] - at[:-nth]
        near = (context[nth:] == context[:-nth]) & (apart < 2 * t)
        if not near.any():
            break
        near &= apart >= t
        begins.append(at[:-nth][near])
        periods.append(apart[near])
    return np.concatenate(begins), np.concatenate(periods)


def runs(w: np.ndarray, lengths: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in w, in which texts of `lengths` words lie, longest first, each with a number of its own behind it."""
    found: list[tuple[int, int, int]] = []
    for q in range(1, FIRST):
        begin, end = _stretches(w[:-q] == w[q:])
        long = end - begin >= 3 * q
        found += zip(begin[long].tolist(), (end[long] + q).tolist(), [q] * int(long.sum()), strict=True)
    ends = np.cumsum(np.asarray(lengths) + 1)
    h, t = _mixed(w.astype(np.uint64), np.zeros(1, np.uint64)), 1
    while n := int(np.searchsorted(-np.asarray(lengths), -4 * t, "right")):
        h = h[: int(ends[n - 1])]
        if t >= FIRST:
            at, q = proposed(h, selected(h, t, found), t)
            order = np.lexsort((at, q))
            before, known = 0, -1
            for k, period in zip(at[order].tolist(), q[order].tolist(), strict=True):
                if period == before and k < known:
                    continue
                low, known = _agreement(w, k, period)
                before = period
                if known - low >= 3 * period:
                    found.append((low, known + period, period))
        h = _mixed(h[:-t], h[t:])
        t *= 2
    smallest: dict[tuple[int, int], int] = {}
    for start, end, q in found:
        smallest[start, end] = min(q, smallest.get((start, end), q))
    return [(start, end, q) for (start, end), q in smallest.items()]


def _searched(texts: list[list[bytes]], least: int, times: int) -> tuple[list[list[dict]], list[str]]:
    """Of word lists: runs, and the words that stay, joined."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    number: dict[bytes, int] = {}
    w = np.empty(sum(map(len, texts)) + len(texts), np.int64)
    begins, at = np.empty(len(texts), np.int64), 0
    for nth, k in enumerate(order):
        begins[nth], end = at, at + len(texts[k])
        w[at:end] = [number.setdefault(x, len(number)) for x in texts[k]]
        w[end] = -1 - nth
        at = end + 1
    rows: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, q in runs(w, [len(texts[k]) for k in order]):
        if end - start >= max(least, times * q):
            nth = int(np.searchsorted(begins, start, "right")) - 1
            rows[order[nth]].append((start - int(begins[nth]), end - start, q))
    kept = []
    for words, own in zip(texts, rows, strict=True):
        if own:
            own.sort(key=lambda r: (r[0], r[2]))
            steps = np.zeros(len(words) + 1, np.int64)
            for start, length, q in own:
                steps[start + q] += 1
                steps[start + length] -= 1
            words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
        kept.append(b" ".join(words).decode())
    return [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in rows], kept


def _repetitions(schema: StructType, least: int, times: int):
    out = to_arrow_schema(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, words, n = 0, [], 0
            for k in range(batch.num_rows):
                # bytes.split cuts at exactly space and the five controls from tab on
                words.append((batch.column(batch.num_columns - 1)[k].as_py() or "").encode().split())
                n += len(words[-1]) + 1
                if n >= AT_ONCE or k == batch.num_rows - 1:
                    rows, kept = _searched(words, least, times)
                    sizes = pa.array([len(x) for x in words], pa.int64())
                    part = batch.slice(first, k + 1 - first)
                    own = [sizes, pa.array(rows, out.field(out.names[-2]).type), pa.array(kept, out.field(out.names[-1]).type)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*part.columns[:-1], *own], out, strict=True)], schema=out)
                    first, words, n = k + 1, [], 0

    return found


def repetitions(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), least: int = 6, times: int = 4) -> DataFrame:
    """The columns named in carry, and n_words, runs (start, length and period in words, by start, then period) and
    collapsed: the words outside of what repeats, that is without those behind a run's first period.

    A run has at least `least` words and `times` periods (4 or more, on which the method rests).
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods aren't searched")
    rows = docs.select(*(F.col(f"`{c}`") for c in carry))
    names = [fresh(rows, c) for c in ("n_words", "runs", "collapsed")]
    schema = rows.schema
    for name, kind in zip(names, (LongType(), RUNS, StringType()), strict=True):
        schema = schema.add(name, kind)
    return in_small_batches(docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text}`").cast("string").alias(fresh(rows, "text")))).mapInArrow(_repetitions(schema, least, times), schema)


def planted(text: str | Column, doc_id: str | Column) -> Column:
    """text, in one of ten documents with words that repeat: by the crc32 of the id, from a word on the next p words again and again.

    Documents without an id have no crc32, and so keep their text, as do those without words.
    """
    text, doc_id = (F.col(c) if isinstance(c, str) else c for c in (text, doc_id))
    h, n = F.crc32(doc_id.cast("string")), word_count(text)
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    repeated = lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(s["words"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))), " ")
    one = F.array(F.struct(words.alias("words"), n.alias("n"), a.alias("a"), p.alias("p")))
    return F.when((h % 10 == 0) & (n > 0), F.element_at(F.transform(one, repeated), 1)).otherwise(text)


def with_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), its exponent in thousandths, and sha256 of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
