"""Sharding by a hypergeometric communication matrix, in DataFrame functions only: a uniform shuffle whose shards
have exact sizes.

Rows lie in P blocks by hash. How many rows each block sends to each shard is drawn before any row moves: the matrix
with the blocks' row counts and the shards' exact sizes as margins, from the distribution that a uniform permutation
would give. It is drawn down a binary tree of blocks, the left half's counts being multivariate hypergeometric given
the whole. Then each block permutes its rows and cuts them by its row of the matrix, the rows are exchanged, and each
shard permutes what it got. Both permutations are sorts of bounded pieces, so no task holds a block's texts or a shard.

The law is `rows`: shard sizes differ by one row at most. Equal texts are not kept together: a uniform shuffle spreads
them like any rows.

Nulls and blanks: a null text has size 1 (no bytes, plus 1) and checksum 0; a null doc_id is a row like any other.
Fewer rows than shards leave the last shards empty; an empty table gives an empty result. Repeated rows are rows of
their own: they are counted and numbered, and the number goes into every hash, so they lie in all blocks. Very long
texts count by size and checksum, which read them whole. Rows whose hashes tie are ordered by id, size, checksum and
number. Every draw is a hash, so reruns agree. Further columns stay out of the result, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import same_rows, small, uniform, written

SHARDS = 8
#: Rows of a block or of a piece of a shard, about; the tree has 2 ** DEPTHS[0] to 2 ** DEPTHS[1] blocks, so that beyond
#: 2e10 rows blocks grow with the table. Tables by block of more than SENT rows are joined with a shuffle, not sent.
ROWS, DEPTHS, SENT = 20_000, (4, 20), 1 << 17


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` from `total` things, `good` of them good, are good: inverse distribution at u in [0, 1).

    From the mode upwards, then from the mode downwards, until the chances passed exceed u. Chances come from the
    ratio of neighbours, relative to the mode's; 12 standard deviations each way hold all that doubles can tell.
    """

    def draw(x: Column) -> Column:
        g, t, n, u = x["g"], x["t"], x["n"], x["u"]
        bad = t - g

        def spread(y: Column) -> Column:
            mode, up, down = y["mode"], y["up"], y["down"]
            ratio = lambda k: (g - k) * (n - k) / ((k + 1) * (bad - n + k + 1))  # noqa: E731  chance of k + 1 by that of k

            def weigh(s: Column, i: Column) -> Column:
                """The chance of the i-th value, given that of the value before it."""
                return (
                    F.when(i == 0, F.lit(1.0))
                    .when(i <= up, s["w"] * ratio(mode + i - 1))
                    .otherwise(F.when(i == up + 1, F.lit(1.0)).otherwise(s["w"]) / ratio(mode - (i - up)))
                )

            def add(s: Column, i: Column) -> Column:
                return F.transform(F.array(weigh(s, i)), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), s["at"].alias("at")))[0]

            def seek(goal: Column):
                def step(s: Column, i: Column) -> Column:
                    return F.transform(F.array(weigh(s, i)), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), F.when((s["at"] < 0) & (s["sum"] + w > goal), i.cast("double")).otherwise(s["at"]).alias("at")))[0]

                return step

            zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"))
            steps = F.transform(F.sequence(F.lit(0).cast("long"), (up + down).cast("long")), lambda i: i.cast("double"))
            whole = F.aggregate(steps, zero, add)["sum"]
            at = F.transform(F.array(whole), lambda all_: F.aggregate(steps, zero, seek(u * all_))["at"])[0]
            return F.transform(F.array(at), lambda i: F.when(i < 0, mode).when(i <= up, mode + i).otherwise(mode - (i - up)))[0]

        low, high = F.greatest(F.lit(0.0), n - bad), F.least(n, g)
        mode = F.least(high, F.greatest(low, F.floor((n + 1) * (g + 1) / (t + 2)).cast("double")))
        reach = F.ceil(12 * F.sqrt(n * g / F.greatest(t, F.lit(1.0)) * bad / F.greatest(t, F.lit(1.0)) * (t - n) / F.greatest(t - 1, F.lit(1.0)))) + 20
        shape = F.struct(mode.alias("mode"), F.least(high - mode, reach.cast("double")).alias("up"), F.least(mode - low, reach.cast("double")).alias("down"))
        return F.transform(F.array(shape), spread)[0]

    given = F.struct(good.cast("double").alias("g"), total.cast("double").alias("t"), draws.cast("double").alias("n"), u.alias("u"))
    return F.transform(F.array(given), draw)[0].cast("long")


def _left_counts(counts: Column, draws: Column, node: Column, seed: int) -> Column:
    """Of rows with counts by shard, the counts of a uniform choice of draws of them."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c)
    start = F.struct(draws.cast("long").alias("left"), total.alias("total"), F.lit(0).alias("j"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        got = hypergeometric(c, s["total"], s["left"], uniform(F.lit(seed), node, s["j"]))
        return F.transform(F.array(got), lambda x: F.struct((s["left"] - x).alias("left"), (s["total"] - c).alias("total"), (s["j"] + 1).alias("j"), F.concat(s["out"], F.array(x)).alias("out")))[0]

    return F.aggregate(counts, start, step)["out"]


def communication_matrix(sizes: DataFrame, depth: int, shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """block, counts (rows to each shard) for 2 ** depth blocks with the row counts in sizes (block, n)."""
    spark = sizes.sparkSession
    all_sizes = spark.range(1 << depth).withColumnRenamed("id", "block").join(sizes, "block", "left").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).cast("long").alias("n")))), lambda x: x["n"]).alias("sizes"))
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, c: s + c)
    share = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.floor(F.col("n") / shards).cast("long") + F.when(j < F.col("n") % shards, 1).otherwise(0))
    tree = all_sizes.withColumn("n", add(F.col("sizes"))).select(F.lit(1).cast("long").alias("node"), "sizes", share.cast("array<bigint>").alias("counts"))
    for level in range(depth):
        half = 1 << (depth - level - 1)
        tree = tree.withColumn("left", _left_counts(F.col("counts"), add(F.slice("sizes", 1, half)), F.col("node"), seed))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        tree = tree.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.slice("sizes", 1, half).alias("sizes"), F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.slice("sizes", half + 1, half).alias("sizes"), right.alias("counts")),
        )).alias("x")).select("x.*")
        if level % 4 == 3:
            tree = written(tree.repartition(min(64, 1 << level), "node"), "matrix")
    return tree.select((F.col("node") - (1 << depth)).alias("block"), "counts")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs, by the law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = written(same_rows(rows, ["doc_id", "size", "text_crc32"]), "rows")
    depth = max(DEPTHS[0], min(DEPTHS[1], (max(rows.count() // ROWS, 1) - 1).bit_length()))
    blocks = 1 << depth
    own = lambda n: F.xxhash64("doc_id", "size", "text_crc32", "nth", F.lit(seed + n))
    rows = rows.withColumn("block", F.pmod(own(0), F.lit(blocks)))
    matrix = communication_matrix(rows.groupBy("block").agg(F.count("*").alias("n")), depth, shards, seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("counts", 1, j), F.lit(0).cast("long"), lambda s, c: s + c))
    matrix = written(matrix.select("block", ends.alias("ends")), "matrix")
    place = F.row_number().over(Window.partitionBy("block").orderBy(own(1), "doc_id", "size", "text_crc32", "nth"))
    dealt = rows.withColumn("place", place).join(small(matrix, SENT), "block").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    dealt = written(dealt.select("doc_id", "size", "text_crc32", "nth", "shard", F.pmod(own(2), F.lit(blocks)).alias("piece")), "dealt")
    pieces = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = written(pieces.select("shard", "piece", before.alias("before")), "pieces")
    order = Window.partitionBy("shard", "piece").orderBy(own(3), "doc_id", "size", "text_crc32", "nth")
    return dealt.join(small(pieces, SENT), ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("before") + F.row_number().over(order) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
