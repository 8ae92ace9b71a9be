"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source gets the same expected number of copies, target / source_size. The whole part is sure.
The fractions are rounded in pairs: of two documents one hands words to the other, in a direction drawn at random so
that no expectation changes, until the share of one is 0 or 1. The pair's words stay as many as they were, so a
source's sum can only miss its target by the last document left, whose share a last draw rounds. Long documents are
paired first, so that one is likely short.

Pairs meet in a reduction tree: blocks of about BLOCK documents of a source, dealt by hash, each leave one document
with an open share; these meet in blocks again, and so on. A level shuffles ids and sizes, never texts, and the number
of levels grows with the logarithm of the largest source. A hot source is many blocks.

Nulls and blanks: a null text has size 0 and takes 0 words; null is a source of its own, last in order, and a null
doc_id an id like any other. An empty table gives an empty result; sources of size 0 have target 0. Repeated rows are
documents of their own: rows alike in id, source and text are counted and numbered, and the number goes into every
draw, so a group of copies is dealt over all blocks. Very long texts count by their words alone. Documents of one size
are paired in the order of a hash. Draws are hashes of ids, sizes and texts, so reruns agree. Further columns stay out
of `mixed` and pass `mixed_documents` unchanged; names that clash do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import same_rows, small, uniform, word_count, written
from labelloom.operators.curation import placed

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK = 64
#: Most documents whose copies are sent to every executor; beyond that they are joined with a shuffle of the texts.
SENT = 500_000
UNIT = "struct<doc_id:bigint,size:bigint,h:bigint,own:bigint,p:double>"
DONE = "array<struct<doc_id:bigint,size:bigint,h:bigint,up:boolean>>"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, n for each source of sizes (source, size).

    Targets are proportional to weight (in source order, repeating) and sum to share of all sizes. Those above most
    times their source's size stop there and the excess is shared again by weight, until none is above: each turn is
    one aggregation over the sources, and the next level (words per unit of weight) comes from its three sums.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    by = placed(by, F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int") + 1)
    by = written(by.select("source", "source_size", "n", w.alias("w"), (F.col("source_size") * most).alias("stop")), "weighed")
    whole, open_w = by.agg(F.sum("source_size"), F.sum("w")).first()
    level, before = share * (whole or 0) / (open_w or 1.0), 0
    while True:
        full = F.col("stop") < F.col("w") * level
        n, stopped, open_w = by.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("stop"))), F.lit(0.0)), F.sum(F.when(~full, F.col("w")))).first()
        if n == before:
            break
        before, level = n, (share * whole - stopped) / open_w if open_w else float("inf")
    return by.select("source", "source_size", F.least(F.col("stop"), F.col("w") * level).alias("target"), "n")


def _pair(a: Column, b: Column, seed: int) -> Column:
    """Of two documents with open shares: struct(open, done), one of them open still and the other decided."""
    up_a, down_a = a["size"] * (1 - a["p"]), a["size"] * a["p"]
    up_b, down_b = b["size"] * (1 - b["p"]), b["size"] * b["p"]
    to_a, to_b = F.least(up_a, down_b), F.least(down_a, up_b)
    draw = uniform(a["own"], b["own"], F.lit(seed))

    def settle(x: Column) -> Column:
        to_a, to_b = x["to_a"], x["to_b"]
        unit = lambda d, p: F.struct(*(d[c].alias(c) for c in ("doc_id", "size", "h", "own")), p.alias("p"))
        done = lambda d, up: F.struct(*(d[c].alias(c) for c in ("doc_id", "size", "h")), F.lit(up).alias("up"))
        both = lambda o, d: F.struct(o.alias("open"), d.alias("done"))
        grow = F.when(up_a <= down_b, both(unit(b, b["p"] - to_a / b["size"]), done(a, True))).otherwise(both(unit(a, a["p"] + to_a / a["size"]), done(b, False)))
        shrink = F.when(down_a <= up_b, both(unit(b, b["p"] + to_b / b["size"]), done(a, False))).otherwise(both(unit(a, a["p"] - to_b / a["size"]), done(b, True)))
        return F.when(draw * (to_a + to_b) < to_b, grow).otherwise(shrink)

    return F.transform(F.array(F.struct(to_a.alias("to_a"), to_b.alias("to_b"))), settle)[0]


def _block(units: Column, seed: int) -> Column:
    """units in order, each paired with the one left open before it: struct(open, done)."""
    start = F.struct(F.lit(None).cast(UNIT).alias("open"), F.array().cast(DONE).alias("done"))
    kind = f"struct<open:{UNIT},done:{DONE}>"

    def step(state: Column, unit: Column) -> Column:
        met = F.transform(
            F.array(_pair(state["open"], unit, seed)),
            lambda x: F.struct(x["open"].alias("open"), F.concat(state["done"], F.array(x["done"])).alias("done")),
        )[0]
        first = F.struct(unit.alias("open"), state["done"].alias("done"))
        return F.when(state["open"].isNull(), first.cast(kind)).otherwise(met.cast(kind))

    return F.aggregate(units, start.cast(kind), step)


def _slim(docs: DataFrame) -> list[Column]:
    """The columns by which documents are told apart in a mix."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h")]


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """doc_id, source_name, size, text_hash, source_size, target, copies and taken (words of all copies) of every row of docs."""
    sizes = written(same_rows(docs.select(*_slim(docs)), ["doc_id", "source", "size", "h"]), "sizes")
    goal = written(targets(sizes, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.least(F.floor(rate + 1e-12), F.lit(int(most)))).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    near = small(goal.withColumnRenamed("source", "of"), 10_000)
    met = sizes.join(near, F.col("source").eqNullSafe(F.col("of")))
    is_open = (F.col("size") > 0) & (F.col("p") > 1e-12)
    sure = met.where(~is_open).select("doc_id", "source", "size", "h", F.lit(False).alias("up"))

    own = F.xxhash64("doc_id", "size", "h", "nth").alias("own")
    units = met.where(is_open).select("source", "doc_id", "size", "h", own, "p", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    done, most_blocks, level = [sure], goal.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 1, 0
    while True:
        at = F.pmod(F.xxhash64("own", F.lit(seed + level)), F.col("blocks"))
        blocks = units.groupBy("source", "blocks", at.alias("at")).agg(
            F.collect_list(F.struct((-F.col("size")).alias("first"), F.xxhash64("own", F.lit(-seed - level)).alias("turn"), "doc_id", "size", "h", "own", "p")).alias("units"))
        plain = F.transform(F.array_sort("units"), lambda u: F.struct(*(u[c].alias(c) for c in ("doc_id", "size", "h", "own", "p"))))
        blocks = blocks.select("source", "blocks", _block(plain, seed + 100 * level).alias("x"))
        blocks = written(blocks.select("source", "blocks", "x.open", "x.done"), "rounded")
        done.append(blocks.select("source", F.explode("done").alias("d")).select("d.doc_id", "source", "d.size", "d.h", "d.up"))
        if most_blocks == 1:
            break
        most_blocks, level = -(-most_blocks // BLOCK), level + 1
        units = blocks.select("source", "open.*", F.ceil(F.col("blocks") / BLOCK).alias("blocks"))
    last = blocks.select("source", "open.*")
    done.append(last.select("doc_id", "source", "size", "h", (uniform(F.col("own"), F.lit(seed - 1)) < F.col("p")).alias("up")))
    rows = done[0].select("doc_id", "source", "size", "h", "up")
    for more in done[1:]:
        rows = rows.union(more.select("doc_id", "source", "size", "h", "up"))
    copies = F.col("whole").cast("int") + F.col("up").cast("int")
    return rows.join(near, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", F.col("source").alias("source_name"), "size", F.col("h").alias("text_hash"), "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, chunk: int = 10_000) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (rows without words once a sure copy), in their own columns.

    Only ids, sizes and hashes are mixed; the copies come back to the texts by a join. Rows alike in id, source and
    text share their group's copies, some one more than others: such groups are counted by whole rows, and given out
    in chunks, however many rows they have.
    """
    taken = mixed(docs, weights, share, most).groupBy("doc_id", "source_name", "size", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    taken = written(taken.select(F.struct("doc_id", F.col("source_name").alias("source"), "size", F.col("text_hash").alias("h")).alias("of"), "copies", "n"), "taken")
    keyed = docs.select(F.struct(*_slim(docs)).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    same = [F.col(f"key.{c}").eqNullSafe(F.col(f"of.{c}")) for c in ("doc_id", "source", "size", "h")]
    met = keyed.join(small(taken, SENT), same[0] & same[1] & same[2] & same[3])
    out = met.where("n = 1").select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
    if taken.where("n > 1 and copies > 0").isEmpty():
        return out
    rows = met.where("n > 1").groupBy("key", "copies", "n", "doc").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("key").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.col("k"), F.greatest(F.lit(0), F.col("copies") % F.col("n") - before))
    rows = rows.withColumn("times", F.floor(F.col("copies") / F.col("n")) * F.col("k") + more).where("times > 0")
    parts = rows.select("doc", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(chunk).cast("long"))).alias("at"))
    parts = parts.repartition(F.xxhash64("doc"), "at").select("doc", F.explode(F.sequence("at", F.least(F.col("times"), F.col("at") + chunk) - 1)))
    return out.union(parts.select("doc.*"))
