"""Conversations as one text for training, with a loss mask that follows the tokens' offsets.

A conversation is rendered whole: each turn is START role SEP text END. START, SEP and END are tokens of their own that
the tokenizer is given besides its vocabulary; control strings inside a role or text are escaped (a backslash more
between `<` and `|`, which is taken out again when it is read), so none of them can be told for a mark. The text is
encoded once, with the offsets of its tokens; the spans of turns are in order, and so are those of tokens, so a binary
search finds the first and last token of each assistant text. Marks are tokens, so no token lies across a span's end.

A conversation beyond the bounds of `turns.split` is several rows, cut between turns: there a mark begins, so its tokens
are the same as if it were encoded whole.

Nulls and blanks: a null role or text is an empty one; rows without a turn come first, rows without a conv_id are one
conversation. Rows that tie in turn are in order of role, then text; repeated rows are turns of their own. An empty
text has no token and no loss. Very long texts are encoded whole. An empty table gives an empty result. Further columns
stay out of the result, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelloom.llm import packing, turns
from labelloom.llm.common import in_small_batches

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS = ("assistant",)
#: Characters of rendered text that a worker returns at once.
AT_ONCE = 1 << 22


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def rendered(rows: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text of turns (role, text), and of each turn its role and where its escaped text begins and ends."""
    out, spans, at = [], [], 0
    for role, text in rows:
        head, body = f"{START}{escaped(role)}{SEP}", escaped(text)
        spans.append((role, at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at = spans[-1][2] + len(END)
    return "".join(out), spans


@cache
def tokenizer(vocabulary: str | None = None):
    """The tokenizer in the file vocabulary (default: the public byte-level one), with the template's marks as tokens."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    full = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    full.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
    return full


@cache
def _lengths(vocabulary: str | None, ranks: str | None) -> np.ndarray:
    """Bytes of each token, by id; marks have those of their strings."""
    fast, full = packing.tokenizers(vocabulary, ranks)[2], tokenizer(vocabulary)
    out = np.zeros(full.get_vocab_size(), np.int64)
    for k in range(fast.n_vocab):
        try:
            out[k] = len(fast.decode_single_token_bytes(k))
        except KeyError:
            continue  # an id without a token
    for x in (START, SEP, END):
        out[full.token_to_id(x)] = len(x)
    return out


def encoded(text: str, spans: list[tuple[str, int, int]], vocabulary: str | None = None, ranks: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends (in code points) of the tokens of a rendered text.

    Texts that both tokenizer libraries surely cut alike go through the faster one, a role or text at a time, which is the
    same as encoding the whole, as marks keep them apart; its offsets follow from the bytes of its tokens.
    """
    full = tokenizer(vocabulary)
    if packing.RUN.search(text) or not packing.PLAIN.fullmatch(text):
        found = full.encode(text, add_special_tokens=False)
        starts, ends = np.asarray(found.offsets, np.int32).reshape(-1, 2).T
        return np.asarray(found.ids, np.int32), starts, ends
    fast = packing.tokenizers(vocabulary, ranks)[2]
    start, sep, end = (full.token_to_id(x) for x in (START, SEP, END))
    ids: list[int] = []
    for role, a, b in spans:
        ids.append(start)
        ids += fast.encode_ordinary(escaped(role))
        ids.append(sep)
        ids += fast.encode_ordinary(text[a:b])
        ids.append(end)
    out = np.asarray(ids, np.int32)
    ends = np.cumsum(_lengths(vocabulary, ranks)[out])
    starts = ends - _lengths(vocabulary, ranks)[out]
    if not text.isascii():
        begun = np.r_[0, np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)]  # code points begun before each byte
        starts, ends = begun[starts + 1] - 1, begun[ends]
    return out, starts.astype(np.int32), ends.astype(np.int32)


def masked(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of spans (begin, end), both in order: from the first that ends behind a begin to the last that starts before its end."""
    first = np.searchsorted(ends, spans[:, 0], "right")
    behind = np.maximum(np.searchsorted(starts, spans[:, 1], "left"), first)
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, behind, -1)
    return np.cumsum(steps)[:-1] > 0


def covered(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The stretches of text that tokens under the mask cover, once each (tokens of one character's bytes share it)."""
    starts, ends = starts[loss], ends[loss]
    if not len(starts):
        return []
    high = np.maximum.accumulate(ends)
    new = np.flatnonzero(starts[1:] > high[:-1]) + 1
    return [text[a:b] for a, b in zip(starts[np.r_[0, new]].tolist(), high[np.r_[new - 1, len(high) - 1]].tolist(), strict=True)]


FORMATTED = "text string, turns array<struct<role:string,start:int,end:int>>, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def _formatted(schema: StructType, roles: tuple[str, ...], vocabulary: str | None, ranks: str | None):
    out = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, rows = 0, 0, []
            for k in range(batch.num_rows):
                text, spans = rendered([(t["role"], t["text"]) for t in batch.column(2)[k].as_py()])
                ids, starts, ends = encoded(text, spans, vocabulary, ranks)
                loss = masked(starts, ends, np.asarray([(a, b) for role, a, b in spans if role in roles and a < b], np.int64).reshape(-1, 2))
                rows.append((text, [{"role": role, "start": a, "end": b} for role, a, b in spans], ids, starts, ends, loss))
                size += len(text)
                if size >= AT_ONCE or k == batch.num_rows - 1:
                    columns = [*batch.slice(first, len(rows)).columns[:2], *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(out)[2:], strict=True))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)
                    first, size, rows = k + 1, 0, []

    return each


def _schema(df: DataFrame, ddl: str) -> StructType:
    return StructType(df.select("conv_id", "stretch").schema.fields + df.sparkSession.createDataFrame([], ddl).schema.fields)


def formatted(conversations: DataFrame, roles: tuple[str, ...] = LOSS, vocabulary: str | None = None, ranks: str | None = None, most_rows: int = turns.MOST_ROWS, most_bytes: int = turns.MOST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Of each conversation: conv_id, stretch, text, turns (role, start and end of its text), and of each token its id,
    start, end and whether it counts for the loss, as texts of `roles` do (vocabulary, ranks: files of the tokenizer). First those that are one row each, then the
    stretches of longer ones, None if there are none."""
    whole, long = turns.split(turns.plain(conversations, ""), most_rows, most_bytes)

    def each(rows: DataFrame) -> DataFrame:
        schema = _schema(rows, FORMATTED)
        return in_small_batches(rows).mapInArrow(_formatted(schema, roles, vocabulary, ranks), schema)

    return each(turns.gathered(whole)), None if long is None else each(turns.cut(long))


READ = "n_turns long, said string, loss string, loss_chars long, formatted_chars long"


def _read(schema: StructType):
    out = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, *tokens in zip(*(batch.column(c) for c in ("text", "starts", "ends", "loss")), strict=True):
                text = text.as_py()
                said = [unescaped(x) for turn in text.split(END)[:-1] for x in turn.removeprefix(START).split(SEP)]
                loss = "".join(map(unescaped, covered(text, *(t.values.to_numpy(zero_copy_only=False) for t in tokens))))
                rows.append((len(said) // 2, "".join(f"{x}\n" for x in said), loss, len(loss), len(text)))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:2], out, strict=False)), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, list(out)[2:], strict=True))], schema=out)

    return each


def read_back(rows: DataFrame) -> DataFrame:
    """Of formatted rows: conv_id, stretch, n_turns, said (role and text of each turn, a line end behind each), loss (all
    text under the mask, unescaped), loss_chars and formatted_chars. Turns are found by the marks, loss by tokens alone."""
    schema = _schema(rows, READ)
    return rows.select("conv_id", "stretch", "text", "starts", "ends", "loss").mapInArrow(_read(schema), schema)


def digests(whole: DataFrame, long: DataFrame | None) -> DataFrame:
    """One row a conversation, by what is read back: n_turns, sha256 of turns and of loss, and lengths."""
    numbers = ("n_turns", "loss_chars", "formatted_chars")
    back = read_back(whole)
    out = back.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), "loss_chars", F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    if long is None:
        return out
    back = read_back(long)
    sums = back.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in numbers)).withColumnRenamed("conv_id", "own")
    rows = turns.chained(back, "", "said", "loss").join(sums, F.col("conv_id").eqNullSafe(F.col("own")))
    return out.unionByName(rows.select("conv_id", "n_turns", F.col("said").alias("turns_sha256"), "loss_chars", F.col("loss").alias("loss_sha256"), "formatted_chars"))
