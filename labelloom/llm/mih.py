"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

ROTATIONS rotations are learnt on at most `sample` vectors (a documented bound): principal directions, then alternating
signs and orthogonal fits (iterative quantisation) from different beginnings. A vector's code is the signs of its
rotated coordinates, up to 64 a rotation: with one rotation, neighbours and others overlap too much where vectors
spread in all directions. Codes are cut into m substrings, each with a table. To find all codes within Hamming radius R
of a query it is enough, by the pigeonhole principle, to probe table k within R // m or one less; what that retrieves is
checked against R and ranked by the inner product of the original vectors, in double precision. Where R is small,
substrings have 16 bits, and the values within reach are listed and looked up. Where R is large that would list most of
the table, so there are two long substrings, whose values in the part are compared.

R is measured, not set: some queries are compared with all rows, and R covers COVER of their true neighbours'
distances. Queries that get fewer rows than they should (isolated ones, where most lie in tight clusters) are searched
again with R doubled, up to all bits.

Inner products grow with length, so codes are those of vectors completed to equal length by one more coordinate, and
of queries completed by 0: the order of cosines is then that of inner products. Equal vectors are one class with its
smallest ids. Classes are dealt by hash into parts of at most FLOATS numbers; a task indexes one part, and the queries
stream past it in batches and take their best from it. So the index is shuffled once, a query once for each part, and
memory holds one part and one batch.

Nulls: vectors that are null, zero or hold null or non-finite components take no part. A row without a vec_id is never
a query, but a candidate, after all others of its score; such rows of one vector are one. Vectors of other lengths have
no inner product with a query's, so each length is searched for itself. Repeated vec_ids with one vector are one
candidate; with different vectors they are several, and a query once for each, whose rows are ranked together. Ties go
to the smaller vec_id. Float columns stay floats on the way, others travel as doubles. No queries or no candidates give
an empty result. Further columns stay out of the result, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import hash_sample, written
from labelloom.llm.ego_join import numbers, unit, usable, vectors

NEAREST, EVERY, FLOATS, COVER, PROBES, ROTATIONS = 20, 20, 1 << 22, 0.985, 96, 4
#: Most bits that may differ in a substring of 16 bits for its values to be listed.
LISTED = 2


def completed(x: np.ndarray, longest: float) -> np.ndarray:
    """x over longest, and the coordinate that completes each row to length 1."""
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))])


def learn(x: np.ndarray, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and side by side the rotations whose signs quantise the rows of x well; up to 64 bits each."""
    mean = x.mean(0)
    bits = min(64, x.shape[1])
    main = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(x.shape[1]))[1][:, ::-1][:, :bits]
    z, out = (x - mean) @ main, []
    for k in range(ROTATIONS):
        turn = np.linalg.qr(np.random.default_rng(29 + k).normal(size=(bits, bits)))[0]
        for _ in range(turns):
            u, _, w = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
            turn = (u @ w).T
        out.append(main @ turn)
    return mean, np.concatenate(out, axis=1)


def packed(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words; each half of the bits fills half of the words, zeros behind it."""
    cut = -(-signs.shape[1] // 2)
    words = -(-cut // 64)
    halves = [np.pad(h, ((0, 0), (0, 64 * words - h.shape[1]))) for h in (signs[:, :cut], signs[:, cut:])]
    return np.concatenate([np.packbits(h, axis=1, bitorder="little").view(np.uint64) for h in halves], axis=1)


def codes(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The code of each row, as `packed` lays it out."""
    return packed((x - mean) @ turn >= 0)


@cache
def ball(radius: int) -> np.ndarray:
    """All numbers of 16 bits with at most radius ones."""
    x = np.arange(1 << 16, dtype=np.uint16)
    return x[np.bitwise_count(x) <= radius]


class Index:
    """Tables of one part for searches within a radius: of 16-bit substrings, if their values can be listed, or of halves."""

    def __init__(self, code: np.ndarray, bits: int, radius: int) -> None:
        self.radius, self.rows, self.probed = radius, len(code), 0
        half = code.shape[1] // 2
        self.words = [[np.ascontiguousarray(code[:, k]) for k in ks] for ks in (range(half), range(half, 2 * half))]
        cut = -(-bits // 2)
        self.short = [(h, k) for h, n in enumerate((cut, bits - cut)) for k in range(-(-n // 16))]
        self.listed = radius // len(self.short) <= LISTED
        if self.listed:
            self.tables = []
            for h, k in self.short:
                own = self._short(code[:, h * half + k // 4], k)
                order = np.argsort(own, kind="stable")
                self.tables.append((order, np.searchsorted(own[order], np.arange((1 << 16) + 1))))

    @staticmethod
    def _short(word: np.ndarray, k: int) -> np.ndarray:
        return (word >> np.uint64(16 * (k % 4)) & np.uint64(0xFFFF)).astype(np.uint16)

    def _far(self, h: int, query: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Bits of half h in which rows differ from query."""
        first = h * len(self.words[0])
        return sum(np.bitwise_count(w[rows] ^ query[first + k]).astype(np.uint16) for k, w in enumerate(self.words[h]))

    def within(self, query: np.ndarray) -> np.ndarray:
        """Rows whose code differs from query's in at most radius bits."""
        m = len(self.short) if self.listed else 2
        reach = [self.radius // m - (k > self.radius % m) for k in range(m)]
        if not self.listed:
            far = [self._far(h, query) for h in (0, 1)]
            rows = np.flatnonzero((far[0].astype(np.int64) <= reach[0]) | (far[1].astype(np.int64) <= reach[1]))
            self.probed += len(rows)
            return rows[far[0][rows] + far[1][rows] <= self.radius]
        seen = np.zeros(self.rows, bool)
        half = len(self.words[0])
        for (h, k), (order, starts), r in zip(self.short, self.tables, reach, strict=True):
            if r >= 0:
                near = (ball(r) ^ self._short(query[h * half + k // 4], k)).astype(np.int64)
                first, size = starts[near], starts[near + 1] - starts[near]
                seen[order[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        rows = np.flatnonzero(seen)
        self.probed += len(rows)
        return rows[self._far(0, query, rows) + self._far(1, query, rows) <= self.radius]


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the most best: largest score first, ties to the smaller id."""
    if len(scores) > 4 * most:
        cut = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:most]


def _searched(mean: np.ndarray, turn: np.ndarray, longest: float, radius: int, most: int):
    """Of a partition in order of (part, asks): the index rows of each part, then the queries that stream past them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, table, v, ids, low = None, [], None, None, None, None
        for batch in batches:
            parts, asks = batch.column("part").to_numpy(), batch.column("asks").to_numpy()
            out: list[tuple] = []
            for p in np.unique(parts):
                own = parts == p
                if p != part:
                    part, held, table = p, [], None
                rows = batch.filter(pa.array(own & (asks == 0)))
                if len(rows):
                    held.append((vectors(rows.column("v")), rows.column("class").to_numpy(), rows.column("low").to_numpy()))
                asking = batch.filter(pa.array(own & (asks == 1)))
                if not len(asking) or not (held or table):
                    continue
                if table is None:
                    v, ids, low = (np.concatenate(x) for x in zip(*held, strict=True))
                    table, held = Index(codes(completed(v, longest), mean, turn), turn.shape[1], radius), []
                q = vectors(asking.column("v"))
                top = np.abs(q).max(axis=1, keepdims=True)
                norm = np.sqrt((q / top * (q / top)).sum(1, keepdims=True)) * top
                asked = codes(np.column_stack([q / norm, np.zeros(len(q))]), mean, turn)
                for k, name in enumerate(asking.column("class").to_numpy()):
                    got = table.within(asked[k])
                    scores = v[got] @ q[k]
                    at = _best(scores, low[got], most)
                    out.append((np.full(len(at), name), ids[got][at], scores[at], low[got][at]))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "class", "score", "low"])

    return search


def _true_distances(mean: np.ndarray, turn: np.ndarray, longest: float, names: np.ndarray, q: np.ndarray, most: int):
    """For each probe query the best rows of a task, with the distance of their codes."""
    asked = codes(np.column_stack([unit(q), np.zeros(len(q))]), mean, turn)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v, low = batch.column(0).to_numpy(), vectors(batch.column(1)), batch.column(2).to_numpy()
            if not len(v):
                continue
            scores, code = v @ q.T, codes(completed(v, longest), mean, turn)
            out = []
            for k, name in enumerate(names):
                own = np.where(ids == name, -np.inf, scores[:, k])
                at = _best(own, low, most)
                out.append((np.full(len(at), name), own[at], np.bitwise_count(code[at] ^ asked[k]).sum(1, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "score", "far"])

    return compare


def _length(v: str) -> Column:
    """The length of an array of numbers, without overflow."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(F.array(top), lambda t: t * F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") / t) * (x.cast("double") / t))))[0]


#: Stands for a missing vec_id inside, so that it comes after all others.
NO_ID = 2**63 - 1


def _nearest_classes(classes: DataFrame, queries: DataFrame, width: int, need: int, keep: int, sample: int) -> DataFrame:
    """query, class, score and low: of each query (class, v) its best `keep` classes of vectors with so many components, or more."""
    spark = classes.sparkSession
    n = classes.count()
    longest = classes.agg(F.max(_length("v"))).first()[0]
    part = lambda df, k: hash_sample(df, sample if k else PROBES, k, "class").toPandas()  # noqa: E731  bounded
    mean, turn = learn(completed(np.stack(part(classes.select("class", "v"), 1)["v"].to_numpy()).astype(np.float64), longest))
    probes = part(queries.select("class", "v"), 0)
    compare = _true_distances(mean, turn, longest, probes["class"].to_numpy(), np.stack(probes["v"].to_numpy()).astype(np.float64), keep - 1)
    true = classes.select("class", "v", "low").mapInArrow(compare, "query long, score double, far long")
    true = true.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("rank") < keep)
    radius = int(true.agg(F.percentile("far", COVER)).first()[0] or 0) + 1

    # Parts no larger than a task should hold; in a small table as many as there are cores.
    parts = max(-(-n * width // FLOATS), min(spark.sparkContext.defaultParallelism, -(-n // 2048)))
    held = classes.select(F.pmod(F.xxhash64("class", F.lit(3)), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("asks"), "class", "low", "v")
    best, done = Window.partitionBy("query").orderBy(F.desc("score"), "low"), []
    while True:
        asking = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("asks"), "class", F.lit(0).cast("long").alias("low"), "v")
        met = held.union(asking).repartitionById(parts, "part").sortWithinPartitions("part", "asks")
        found = met.mapInArrow(_searched(mean, turn, longest, radius, keep), "query long, class long, score double, low long")
        found = written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).drop("rank"), "found")
        got = found.join(classes.select("class", "n"), "class").groupBy("query").agg(F.sum("n").alias("n"))
        full = got.where(F.col("n") >= need).select("query")
        if radius >= turn.shape[1] or (short := written(queries.join(full.withColumnRenamed("query", "class"), "class", "left_anti"), "short")).isEmpty():
            done.append(found)
            break
        done.append(found.join(full, "query", "left_semi"))
        queries, radius = short, min(turn.shape[1], 2 * radius)
    return reduce(DataFrame.unionByName, done)


def nearest(table: DataFrame, every: int = EVERY, most: int = NEAREST, sample: int = 10_000) -> DataFrame:
    """query_id, rank, vec_id and score: of each query (vec_id divisible by every) the `most` nearest rows found."""
    spark, keep = table.sparkSession, most + 1
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), numbers(table, "embedding").alias("v")).where(usable("v"))
    id_, n = F.coalesce("vec_id", F.lit(NO_ID)), max(1, rows.count())
    # A hot vector's ids are cut to the smallest ones in two turns, so no task collects them all.
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // 10_000))).alias("salt")).agg(F.slice(F.array_sort(F.collect_set(id_)), 1, keep).alias("ids"))
    classes = salted.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    classes = written(classes.select(F.xxhash64("v").alias("class"), F.size("v").alias("width"), "v", "ids", F.col("ids")[0].alias("low"), F.size("ids").alias("n")), "classes")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", F.xxhash64("v").alias("class")).distinct()
    asked = written(asked, "asked")
    queries = written(classes.join(asked.select("class").distinct(), "class", "left_semi").select("class", "width", "v"), "queries")
    found = []
    for width, all_ in sorted(tuple(r) for r in classes.groupBy("width").agg(F.sum("n")).collect()):  # one row a length
        own = queries.where(F.col("width") == width)
        if not own.isEmpty():
            found.append(_nearest_classes(classes.where(F.col("width") == width), own.select("class", "v"), width, min(keep, all_), keep, sample))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, found).join(asked.select(F.col("vec_id").alias("query_id"), F.col("class").alias("query")), "query")
    found = found.join(classes.select("class", "ids"), "class").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
