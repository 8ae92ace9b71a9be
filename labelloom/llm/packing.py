"""Best-fit packing with swap-based local search.

Documents become tokens and a closing id; those longer than a sequence are cut so that only their first piece is
short. Whole pieces are sequences already. The others, slim rows without tokens, are dealt by hash into groups of
about GROUP pieces, so a task's work is bounded. In a group, best fit in decreasing order gives a first packing; then
the emptiest sequence tries to pass its documents on: it moves one, swaps one for a smaller one, or two for one, into
the sequence where the sum of squared fills grows most, until it is empty or no exchange helps. What lies in
sequences with much room left is dealt again over fewer groups, and packed once more.

Nulls and blanks: a null or empty text is the closing id alone; a null doc_id stays null in each piece. Repeated rows
are documents of their own. A text that holds the tokenizer's added tokens has their ids. Very long texts are many
whole pieces, each a sequence. Sizes that tie are taken in order of doc_id, piece and checksum. An empty table gives an
empty result. Further columns stay out of the result, so their names can't clash.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import in_small_batches, written

LENGTH, CLOSE, GROUP = 1024, 2, 6_000
#: What a sequence may leave free and yet not be packed again; after how many sequences in a row that can't be emptied
#: the search ends.
ROOM, GIVE_UP = 48, 3
#: Texts that the two tokenizer libraries surely cut alike: assigned Latin letters and marks, and no very long run.
PLAIN = regex.compile(r"[\t-\r\x20-ɏ‐-‧‰-⁞€]*+")
RUN = regex.compile(r"\S{2000}|\s{2000}")


@cache
def tokenizers(vocabulary: str | None = None, ranks: str | None = None):
    """The tokenizer in the file vocabulary, a pattern of the tokens added to it, and a faster tokenizer of the same
    vocabulary by ranks, which knows no added tokens; default: the public files."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    added = regex.compile("|".join(regex.escape(t.content) for t in full.get_added_tokens_decoder().values()) or r"(?!)")
    lines = open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    with lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return full, added, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def tokens(text: str | None) -> np.ndarray:
    """Ids of text and the closing id."""
    full, added, fast = tokenizers()
    text = text or ""
    if PLAIN.fullmatch(text) and not RUN.search(text) and not added.search(text):
        ids = fast.encode_ordinary(text)
    else:
        ids = full.encode(text, add_special_tokens=False).ids
    return np.append(np.asarray(ids, np.uint32), np.uint32(CLOSE)).astype("<u4")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens(text.as_py())
                first = (len(ids) - 1) % length + 1
                cuts = [0, *range(first, len(ids) + 1, length)]
                out += [(doc_id, k, a, b - a, crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def best_fit(sizes: np.ndarray, most: int) -> list[list[int]]:
    """Bins of positions in sizes: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room, bin), in order
    for k in np.argsort(-sizes, kind="stable").tolist():
        at = bisect_left(free, (int(sizes[k]), -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = most, len(bins)
            bins.append([])
        bins[b].append(k)
        insort(free, (room - int(sizes[k]), b))
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], most: int) -> list[list[int]]:
    """bins after exchanges that pass on what the emptiest ones hold, each of which raises the sum of squared fills."""
    bin_of = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        bin_of[items] = b
    fill = np.bincount(bin_of, sizes, len(bins)).astype(np.int64)
    missed = 0
    for giver in np.argsort(fill, kind="stable").tolist():
        if missed == GIVE_UP:
            break
        if fill[giver] == most:
            continue
        others = (fill > 0) & (fill < most)
        others[giver] = False
        if (most - fill[others]).sum() < fill[giver]:
            missed += 1
            continue
        while fill[giver]:
            # Of documents of one size in one sequence one speaks for all: a sequence has few different sizes.
            mine: dict[int, list[int]] = {}
            for k in np.flatnonzero(bin_of == giver).tolist():
                mine.setdefault(int(sizes[k]), []).append(k)
            singles = {a: (ks[0],) for a, ks in mine.items()}
            pairs = {a + b: (mine[a][0], mine[b][-1]) for a in mine for b in mine if a < b or a == b and len(mine[a]) > 1}
            theirs = np.flatnonzero(others[bin_of])
            theirs = theirs[np.unique(bin_of[theirs] * (most + 1) + sizes[theirs], return_index=True)[1]]
            room, back = (most - fill)[bin_of[theirs]], sizes[theirs]
            open_bins = np.flatnonzero(others)
            best = (0, None, None, None)
            for amount, given in [*singles.items(), *pairs.items()]:
                fit = most - fill[open_bins]
                ok = fit >= amount
                if len(given) == 1 and ok.any():
                    to = open_bins[ok][np.argmax(fill[open_bins][ok])]
                    rise = 2 * amount * (int(fill[to]) - int(fill[giver]) + amount)
                    if rise > best[0]:
                        best = (rise, given, None, int(to))
                gain = amount - back
                ok = (gain > 0) & (gain <= room)
                if ok.any():
                    rise = 2 * gain[ok] * (fill[bin_of[theirs[ok]]] - fill[giver] + gain[ok])
                    at = int(np.argmax(rise))
                    if rise[at] > best[0]:
                        k = int(theirs[ok][at])
                        best = (int(rise[at]), given, k, int(bin_of[k]))
            if best[1] is None:
                break
            _, given, k, to = best
            moved = int(sizes[list(given)].sum()) - (int(sizes[k]) if k is not None else 0)
            bin_of[list(given)] = to
            if k is not None:
                bin_of[k] = giver
            fill[to] += moved
            fill[giver] -= moved
            others[to] = fill[to] < most
        missed = missed + 1 if fill[giver] else 0
    order = np.argsort(bin_of, kind="stable")
    cuts = np.flatnonzero(np.diff(bin_of[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(order) else []


def _packed(most: int, turn: int):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins = local_search(sizes, best_fit(sizes, most), most)
        order = np.concatenate([np.array(b) for b in bins])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = pdf.iloc[order][["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (turn << 60) + (int(key[0]) << 24) + number
        out["offset"] = np.concatenate([np.cumsum([0, *sizes[b[:-1]]]) for b in bins])
        out["filled"] = np.repeat([int(sizes[b].sum()) for b in bins], [len(b) for b in bins])
        return out

    return pack


OUT = PIECES + ", sequence_id long, offset long, filled long"


def packed(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    pieces = written(in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_pieces(length), PIECES), "pieces")
    whole = pieces.where(F.col("length") == length).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    parts = pieces.where(F.col("length") < length)
    out = [whole]
    for turn in (1, 2):
        groups = max(1, -(-parts.count() // group))
        own = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
        done = written(parts.withColumn("group", own).groupBy("group").applyInPandas(_packed(length, turn), OUT), "packed")
        settled = F.col("filled") >= (length - ROOM if turn == 1 else 0)
        out.append(done.where(settled).drop("filled"))
        parts = done.where(~settled).select("doc_id", "piece", "start", "length", "ids_crc32")
    return out[0].union(out[1]).union(out[2])
