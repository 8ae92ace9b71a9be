"""Conversations as one row each, their turns in order; those that are too long for a row are cut into stretches.

Rows are (conv_id, turn, role, text), role and text without nulls. Order within a conversation: turn, nulls first, then
role, then text. Rows without a conv_id make up one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from labelloom.llm.common import in_small_batches, written
from labelloom.operators.sides import small

#: A conversation of more rows or bytes is long: its rows are spread over tasks.
MOST_ROWS, MOST_BYTES = 4_096, 1 << 20
ORDER = ("known", "turn", "role", "text")


def plain(rows: DataFrame, null: str) -> DataFrame:
    """conv_id, turn, role and text alone, with `null` for a missing role or text."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(null)).alias("role"), F.coalesce("text", F.lit(null)).alias("text"))


def split(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that fit in a row each, and rows of the others, with width: how many of them fit in one stretch.

    None if there are no others. width is a power of two.
    """
    size = F.octet_length("role") + F.octet_length("text") + 32
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("most"))
    fit = F.least(F.lit(most_rows), F.greatest(F.lit(1), F.floor(F.lit(most_bytes) / F.col("most"))))
    long = written(sizes.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("_long"), F.pow(F.lit(2.0), F.floor(F.log2(fit))).cast("long").alias("width")), "long")
    if long.isEmpty():
        return rows, None
    long, met = small(long), F.col("conv_id").eqNullSafe(F.col("_long"))
    return rows.join(long, met, "left_anti"), rows.join(long, met).drop("_long")


def _turns(*more: str) -> Column:
    """The turns of a group, in order."""
    known = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", *more)
    return F.transform(F.sort_array(F.collect_list(known)), lambda t: F.struct(*(t[c].alias(c) for c in ("turn", "role", "text", *more)))).alias("turns")


def gathered(rows: DataFrame, *more: str) -> DataFrame:
    """conv_id, stretch (0) and turns, an array of (turn, role, text, more): one row a conversation."""
    return rows.groupBy("conv_id").agg(_turns(*more)).select("conv_id", F.lit(0).cast("long").alias("stretch"), "turns")


def cut(rows: DataFrame, *more: str) -> DataFrame:
    """The same for long conversations, of up to width turns a row; stretches of a conversation are in the order of their numbers.

    Rows are dealt by ranges of conversation and order, so a conversation of any length lies in as many tasks as it
    fills; places in these sorted partitions number the stretches.
    """
    keyed = rows.withColumn("known", F.col("turn").isNotNull())
    keys = ["conv_id", *ORDER, *more]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return placed.groupBy("conv_id", (F.col("_at") - F.col("_at") % F.col("width")).alias("stretch")).agg(_turns(*more))


def chained(parts: DataFrame, between: str = "", *texts: str) -> DataFrame:
    """conv_id and, for each of texts, the sha256 of what its stretches hold, in order, with `between` between those that aren't null.

    A digest runs over its text from the first byte to the last, so a conversation's stretches pass one task, one after
    another and never all in memory.
    """
    rows = parts.select("conv_id", "stretch", *texts)
    schema = rows.drop("stretch").schema
    out = to_arrow_schema(schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, begun = None, None, [False] * len(texts)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([own, *(s.hexdigest() for s in state)], out, strict=True)], schema=out)

        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column(0)[k].as_py()
                if state is None or key != own:
                    if state is not None:
                        yield row()
                    own, state, begun = key, [hashlib.sha256() for _ in texts], [False] * len(texts)
                for at in range(len(texts)):
                    if (text := batch.column(2 + at)[k].as_py()) is not None:
                        state[at].update((between * begun[at] + text).encode())
                        begun[at] = True
        if state is not None:
            yield row()

    return in_small_batches(rows.repartition("conv_id").sortWithinPartitions("conv_id", "stretch")).mapInArrow(digests, schema)
