"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance, found by pigeonring filtering.

A fingerprint is cut into m = 3 t + 1 segments on a ring (t: the largest distance). If two fingerprints differ in
at most t bits, then from some segment on every chain of l consecutive segments differs in at most floor(l t / m)
bits. So the first three segments of that chain agree, and of the next three at most one differs: five whole
segments, about half of the bits, agree. Those five are the join key (3 m keys a fingerprint); candidates must then
keep within the budget of the longer chains before the whole distance is counted.

The nodes are the fingerprints themselves: copies never meet each other in a join, and what a doc_id stands for
doesn't matter. Keys with few fingerprints are self-joined; those of a dense group are compared in pairs of bounded
blocks that give back a forest, not the pairs.

Nulls and blanks: a null or blank text has fingerprint 0, linked like any other. A row without a doc_id links as any
other does; it is never a component_id, unless no row of its component has one (then that is null). Repeated rows each
come back. Different texts under one doc_id are rows of their own, which belong to the components of their texts. Very
long texts are hashed whole, in pieces of bounded memory. An empty table gives an empty result. Further columns of the
input stay out of the result of `near_duplicates` and pass `deduplicated` unchanged; names that clash do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import components, fresh, in_small_batches, small, written

SEED = 42
#: Keys with more fingerprints than FEW are compared in blocks of about BLOCK.
FEW, BLOCK = 24, 1024


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of the word shingles of text, A-Z lower-cased; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    hashes = np.fromiter((h(line[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out.view(np.int64))], ["doc_id", "key", "fp"])


def segments(distance: int) -> list[int]:
    """Masks of the 3 distance + 1 segments of 64 bits, in order."""
    m = 3 * distance + 1
    cuts = [round(64 * k / m) for k in range(m + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_keys(distance: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each key its mask, and for longer chains from the same segment (mask, most differing bits)."""
    parts = segments(distance)
    m, keys = len(parts), []
    ring = lambda start, length: sum(parts[(start + k) % m] for k in range(length))
    if not distance:
        return [(parts[0], [(parts[0], 0)])]
    for start in range(m):
        chains = [(ring(start, n), n * distance // m) for n in (6, 9, m) if n <= m]
        keys += [(ring(start, min(6, m)) & ~parts[(start + 3 + left) % m], chains) for left in range(min(3, m - 3))]
    return keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(distance: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Forest of the fingerprints of one block pair: whole groups by breadth-first search."""
        pdf = pdf.sort_values("node")
        fps, nodes = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
        left, a, b = np.arange(len(fps)), [], []
        while len(left):
            top, front, left = left[0], [left[0]], left[1:]
            while front and len(left):
                near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= distance
                front += left[near].tolist()
                a.append(nodes[left[near]])
                b.append(np.full(int(near.sum()), nodes[top]))
                left = left[~near]
        return pd.DataFrame({"a": np.concatenate(a) if a else np.array([], np.int64), "b": np.concatenate(b) if b else np.array([], np.int64)})

    return links


def near_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints (fp, distinct) differ in 1 to distance bits: enough of them to
    connect whatever is linked, not all pairs of a dense group.

    Spark takes exploded rows to be as large as those they come from, so it would send them; the hints forbid that.
    """
    keys = chain_keys(distance)
    probes = F.array(*(F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bits")) for k, (mask, _) in enumerate(keys)))
    rows = fps.select("fp", "node", F.explode(probes).alias("p")).select("fp", "node", "p.k", F.xxhash64("p.k", "p.bits").alias("key"))
    shared = written(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "key"), "chains")

    few = shared.where(F.col("n") <= FEW).select("key", "k", "fp", "node")
    x, other = F.col("fp").bitwiseXOR(F.col("fp2")), few.select("key", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    within = F.lit(True)
    for at in range(len(keys[0][1])):
        mask = F.element_at(F.array(*(F.lit(_signed(chains[at][0])) for _, chains in keys)), F.col("k") + 1)
        within = within & (F.bit_count(x.bitwiseAND(mask)) <= keys[0][1][at][1])
    pairs = few.join(other.hint("merge"), "key").where("node < node2").where(within & (F.bit_count(x) <= distance))

    many = shared.where(F.col("n") > FEW).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    dealt = many.withColumn("own", own).select(
        "key", "fp", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met")
    ).select("key", "fp", "node", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"))
    dense = dealt.groupBy("key", "i", "j").applyInPandas(_linked(distance), "a long, b long")
    return pairs.select(F.col("node2").alias("a"), F.col("node").alias("b")).union(dense)


def _components(fps: DataFrame, distance: int) -> DataFrame:
    """own (each fingerprint) and root (one fingerprint of its component) for distinct fingerprints (fp)."""
    links = near_links(fps.select("fp", F.col("fp").alias("node")), distance)
    roots = components(links).withColumnRenamed("node", "of")
    return fps.join(roots.hint("merge"), F.col("fp") == F.col("of"), "left").select(F.col("fp").alias("own"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of docs."""
    rows = written(in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = written(_components(nodes.select("fp"), distance).join(nodes.hint("merge"), F.col("own") == F.col("fp")).select("own", "root", "low"), "roots")
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = roots.select("own", "root").join(lows.hint("merge"), "root").select("own", "component_id")
    return rows.join(classes.hint("merge"), F.col("fp") == F.col("own")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Most kept documents whose ids are sent to every executor; beyond that they are joined with a shuffle of the texts.
SENT = 500_000


def deduplicated(docs: DataFrame, distance: int = 3) -> DataFrame:
    """docs with one row of each near-duplicate component kept: the smallest doc_id, nulls last; then a hash of the text.

    Rows are told apart by doc_id and that hash, so unrelated texts under one doc_id both stay, and rows without a
    doc_id are deduplicated like any others. Of rows alike in both, the smallest by all columns stays.
    """
    key, id_, n, of, with_ = (fresh(docs, c) for c in ("_key", "_id", "_n", "_of", "_with"))
    keyed = docs.withColumns({key: F.xxhash64("text"), id_: F.col("doc_id").cast("long")})
    rows = in_small_batches(keyed.select(F.col(id_).alias("doc_id"), F.col("text"), F.col(key).alias("key"))).mapInArrow(_keyed_fingerprints, "doc_id long, key long, fp long")
    rows = written(rows, "fingerprints")
    roots = _components(written(rows.select("fp").distinct(), "nodes"), distance)
    firsts = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("first"))
    firsts = firsts.join(roots.hint("merge"), F.col("fp") == F.col("own")).groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.key")
    counts = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    kept = firsts.alias("f").join(counts.alias("c").hint("merge"), F.col("f.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("f.key") == F.col("c.key")))
    kept = written(kept.select(F.col("f.doc_id").alias(of), F.col("f.key").alias(with_), F.col("n").alias(n)), "kept")
    found = keyed.join(small(kept, SENT), F.col(id_).eqNullSafe(F.col(of)) & (F.col(key) == F.col(with_))).drop(of, with_)
    names = [F.col(f"`{c}`") for c in docs.columns]
    if kept.where(F.col(n) > 1).isEmpty():
        return found.select(*names)
    one = found.where(F.col(n) > 1).groupBy(id_, key).agg(F.min(F.struct(*names)).alias(n)).select(f"{n}.*")
    return found.where(F.col(n) == 1).select(*names).unionByName(one)
