"""Conversation structure repair: the cheapest edits that make roles alternate, found by a Viterbi search that forgets.

Of each conversation's rows, in order, faults are counted first (blank, duplicate, truncated; a row's first one counts).
Edits: K keeps a row, R gives it the role user or assistant, D deletes it, I inserts an empty user or assistant turn.
Blank and duplicate rows must go. What stays must be an optional system turn and then pairs of user and assistant, or
nothing. Of equally cheap edits the least string of initials counts.

The search has four states: nothing yet, after a system turn, after a user, after an assistant. Each state's survivor is
a node of a backpointer tree. Nodes count what refers to them, and go when nothing does; when all survivors share an
ancestor, the edits up to it are emitted, so memory holds only what is still open. A survivor that another one beats in
whatever may follow is dropped, since with it nothing would ever be shared: deleting all rows so far is always possible.
Where costs tie, the whole open parts of both paths are compared. Equally cheap paths to one state over the same rows
never begin with each other, since only insertions could follow and they cost, so comparing them as they are is right.

A conversation of up to `most_rows` rows (and bytes) is searched in one piece. A longer one lies in stretches; each is
searched from each state it may begin in, costs and edits of stretches are joined in order, ties by the whole strings
again, and the chosen edits are applied to the stretches where they lie. What one task holds of such a conversation is
one letter an edit.

Nulls and blanks: a null role or text is one space, so such a text is blank, and such a role can't be kept; rows without
a turn come first, rows without a conv_id are one conversation. Rows that tie in turn are in order of role, then text.
Repeated rows are duplicates. Very long texts are read whole. An empty table gives an empty result. Further columns stay
out of the result, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelloom.llm import turns
from labelloom.llm.common import in_small_batches, same_rows, written

#: States, and what each edit costs; a truncated row that stays costs CUT more.
NONE, SYSTEM, USER, ASSISTANT = range(4)
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS = " \t\n\v\f\r"
LEGAL = ("su", "ua", "au")


class Node:
    """An edit, and the path before it; refs: later nodes, and 1 for a state whose survivor it is."""

    __slots__ = ("before", "edit", "refs")

    def __init__(self, before: Node | None, edit: str) -> None:
        self.before, self.edit, self.refs = before, edit, 0
        if before is not None:
            before.refs += 1


def released(node: Node) -> None:
    """One reference less to node; nodes without any go."""
    node.refs -= 1
    while node.refs == 0 and node.before is not None:
        node = node.before
        node.refs -= 1


class Search:
    """Survivors of each state from one beginning; edits that are settled go to `emitted`."""

    def __init__(self, state: int) -> None:
        self.root = Node(None, "")
        self.best: list[tuple[int, Node] | None] = [None] * 4
        self.best[state] = (0, self.root)
        self.root.refs = 1
        self.emitted: list[str] = []
        self.open = 0  # most open edits so far
        self._inserted()

    def path(self, node: Node) -> str:
        """The open edits that lead to node."""
        out = []
        while node is not self.root:
            out.append(node.edit)
            node = node.before
        return "".join(reversed(out))

    def _better(self, cost: int, before: Node, edit: str, than: tuple[int, Node, str] | None) -> bool:
        if than is None or cost != than[0]:
            return than is None or cost < than[0]
        return self.path(before) + edit < self.path(than[1]) + than[2]

    def _inserted(self) -> None:
        """Survivors with insertions: a user after any other state, then an assistant after a user."""
        for now, others in ((USER, (NONE, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            own = self.best[now]
            chosen = own and (own[0], own[1].before, own[1].edit)
            if own and own[1] is self.root:
                continue  # nothing is cheaper than nothing done
            for x in others:
                if (s := self.best[x]) and self._better(s[0] + INSERT, s[1], "I", chosen):
                    chosen = (s[0] + INSERT, s[1], "I")
            if chosen and not (own and chosen[1] is own[1].before and chosen[2] == own[1].edit):
                node = Node(chosen[1], "I")
                node.refs += 1
                self.best[now] = (chosen[0], node)
                if own:
                    released(own[1])

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        found: list[tuple[int, Node, str] | None] = [None] * 4
        kept = CUT if truncated else 0
        for x, s in enumerate(self.best):
            if s is None:
                continue
            ways = [(x, s[0] + DELETE, "D")]
            if not must_go:
                ways.append((ASSISTANT if x == USER else USER, s[0] + RENAME + kept, "R"))
                if initial == "s" and x == NONE:
                    ways.append((SYSTEM, s[0] + kept, "K"))
                elif initial == "u" and x != USER:
                    ways.append((USER, s[0] + kept, "K"))
                elif initial == "a" and x == USER:
                    ways.append((ASSISTANT, s[0] + kept, "K"))
            for y, cost, edit in ways:
                if self._better(cost, s[1], edit, found[y]):
                    found[y] = (cost, s[1], edit)
        old, self.best = self.best, [f and (f[0], Node(f[1], f[2])) for f in found]
        for s in self.best:
            if s:
                s[1].refs += 1
        for s in old:
            if s:
                released(s[1])
        self._inserted()
        self._dropped()
        self._settled()

    def _dropped(self) -> None:
        """Without survivors that the one after an assistant beats whatever follows: it can do all that they can, but
        for a system turn, which it deletes."""
        if a := self.best[ASSISTANT]:
            for x, more in ((NONE, DELETE), (SYSTEM, 0)):
                if (s := self.best[x]) and s[0] > a[0] + more:
                    released(s[1])
                    self.best[x] = None

    def _settled(self) -> None:
        """Emits the edits that all survivors share."""
        survivors = [s[1] for s in self.best if s]
        chain, node = [], survivors[0]
        while node is not self.root:
            chain.append(node)
            node = node.before
        held = {id(n) for n in survivors}
        self.open = max(self.open, len(chain))
        while chain and self.root.refs == 1 and id(self.root) not in held:
            self.root = chain.pop()
            self.root.before = None
            self.emitted.append(self.root.edit)

    def ends(self) -> dict[int, tuple[int, str]]:
        """Of each state that may be reached, the least cost and the edits."""
        head = "".join(self.emitted)
        return {x: (s[0], head + self.path(s[1])) for x, s in enumerate(self.best) if s}


def cheapest(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The best way to end with nothing or after an assistant."""
    return min(ends[x] for x in (NONE, ASSISTANT) if x in ends)


def joined(first: dict[int, tuple[int, list[tuple[int, str]]]], ways: dict[tuple[int, int], tuple[int, str]]) -> dict[int, tuple[int, list[tuple[int, str]]]]:
    """Ways through one more stretch: of each state the cost, and of each stretch the state it begins in and its edits."""
    out: dict[int, tuple[int, list[tuple[int, str]]]] = {}
    for (x, y), (cost, edits) in ways.items():
        if x not in first:
            continue
        total, way = first[x][0] + cost, [*first[x][1], (x, edits)]
        if y not in out or total < out[y][0] or total == out[y][0] and "".join(e for _, e in way) < "".join(e for _, e in out[y][1]):
            out[y] = (total, way)
    return out


def applied(rows: list[tuple[str, str]], state: int, edits: str) -> list[tuple[str, str]]:
    """rows (role, text) with the edits, which begin in the given state."""
    out, left = [], iter(rows)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        out.append((role, text))
    return out


def faults(rows: Iterable[tuple[str, str]], again: Iterable[bool | None]) -> list[str]:
    """"blank", "duplicate", "truncated" or "" of each row; again: whether role and text came before, None: see the rows."""
    seen, out = set(), []
    for row, known in zip(rows, again, strict=True):
        text = row[1].rstrip(BLANKS)
        repeated = row in seen if known is None else known
        seen.add(row)
        out.append("blank" if not text else "duplicate" if repeated else "truncated" if text[-1] not in ".!?" else "")
    return out


def searched(rows: list[tuple[str, str]], found: list[str], state: int = NONE) -> Search:
    search = Search(state)
    for (role, _), fault in zip(rows, found, strict=True):
        search.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    return search


def told(numbers: list[int | None], rows: list[tuple[str, str]], found: list[str]) -> dict[str, object]:
    """What one stretch adds to its conversation's figures."""
    known = [n for n in numbers if n is not None]
    initials = [role[:1] for role, _ in rows]
    return {
        "low": known[0] if known else None, "high": known[-1] if known else None, "distinct": len(set(known)), "first": initials[0], "last": initials[-1],
        "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
    }


def added(a: dict, b: dict) -> dict:
    """Figures of two stretches, one after the other."""
    if a["high"] is None or b["low"] is None:
        low, high, distinct = (a if b["low"] is None else b)["low"], (a if b["low"] is None else b)["high"], a["distinct"] + b["distinct"]
    else:
        low, high, distinct = a["low"], b["high"], a["distinct"] + b["distinct"] - (a["high"] == b["low"])
    return {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated")} | {"low": low, "high": high, "distinct": distinct, "first": a["first"], "last": b["last"], "illegal": a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in LEGAL)}


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
DONE = ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired array<struct<role:string,text:string>>"
WAYS = "low long, high long, distinct long, first string, last string, blank long, duplicate long, truncated long, illegal long, ways array<struct<begin:int,end:int,cost:long,audit:string>>"
CHOSEN = ", ".join(f"{c} long" for c in FIGURES) + ", begin int, audit string"


def _figures(t: dict, cost: int) -> list[int]:
    return [0 if t["low"] is None else t["high"] - t["low"] + 1 - t["distinct"], t["blank"], t["duplicate"], t["truncated"], t["illegal"], cost]


def _mapped(rows: DataFrame, ddl: str, made, *columns: str) -> DataFrame:
    """rows' conv_id and stretch with what made gives of each row's columns."""
    schema = StructType(rows.select("conv_id", "stretch").schema.fields + rows.sparkSession.createDataFrame([], ddl).schema.fields)
    out = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [made(*(batch.column(k)[at].as_py() for k in range(2, batch.num_columns))) for at in range(batch.num_rows)]
            own = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True) if done else [[]] * (len(out) - 2), list(out)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:2], out, strict=False)), *own], schema=out)

    return in_small_batches(rows.select("conv_id", "stretch", *columns)).mapInArrow(each, schema)


def _plain(rows: list[dict]) -> tuple[list[int | None], list[tuple[str, str]]]:
    return [r["turn"] for r in rows], [(r["role"], r["text"]) for r in rows]


def _listed(rows: list[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in rows]


def _whole(rows: list[dict]) -> tuple:
    numbers, said = _plain(rows)
    found = faults(said, [None] * len(said))
    cost, audit = cheapest(searched(said, found).ends())
    return (*_figures(told(numbers, said, found), cost), audit, _listed(applied(said, NONE, audit)))


def _ways(rows: list[dict]) -> tuple:
    numbers, said = _plain(rows)
    found = faults(said, [r["again"] for r in rows])
    ways = [{"begin": x, "end": y, "cost": cost, "audit": audit} for x in range(4) for y, (cost, audit) in searched(said, found, x).ends().items()]
    return (*told(numbers, said, found).values(), ways)


def _chosen(rows: DataFrame) -> DataFrame:
    """conv_id, stretch, the conversation's figures, and where and with which edits the stretch begins; one task a conversation, a letter an edit."""
    names = [f.name for f in rows.sparkSession.createDataFrame([], WAYS).schema.fields]
    schema = StructType(rows.select("conv_id", "stretch").schema.fields + rows.sparkSession.createDataFrame([], CHOSEN).schema.fields)
    out = to_arrow_schema(schema)

    def ended(key, places, figures, first) -> pa.RecordBatch:
        cost, way = min((first[x] for x in (NONE, ASSISTANT) if x in first), key=lambda f: (f[0], "".join(e for _, e in f[1])))
        done = [(key, at, *_figures(figures, cost), x, edits) for at, (x, edits) in zip(places, way, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, places, figures, first = None, [], None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                key, place, *values = (c[at].as_py() for c in batch.columns)
                now = dict(zip(names, values, strict=True))
                if places and key != own:
                    yield ended(own, places, figures, first)
                    places = []
                if not places:
                    own, figures, first = key, None, {NONE: (0, [])}
                places.append(place)
                first = joined(first, {(w["begin"], w["end"]): (w["cost"], w["audit"]) for w in now["ways"]})
                figures = now if figures is None else added(figures, now)
        if places:
            yield ended(own, places, figures, first)

    return in_small_batches(rows.repartition("conv_id").sortWithinPartitions("conv_id", "stretch")).mapInArrow(each, schema)


def _again(long: DataFrame) -> DataFrame:
    """long with again: whether a row's role and text came before in its conversation."""
    nth = same_rows(long, ["conv_id", "turn", "role", "text", "width"]).withColumn("_key", F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = nth.groupBy(F.col("conv_id").alias("_of"), F.col("_key").alias("_same")).agg(F.min(turn).alias("_first"))
    met = F.col("conv_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_same"))
    return nth.join(firsts, met).select("conv_id", "turn", "role", "text", "width", ((F.col("nth") > 0) | (turn > F.col("_first"))).alias("again"))


def repaired(conversations: DataFrame, most_rows: int = turns.MOST_ROWS, most_bytes: int = turns.MOST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Of each conversation: conv_id, stretch, its gaps (numbers missing between the least and the largest turn), blank,
    duplicate, truncated and illegal (neighbours that may not follow each other) as counts, cost, audit (initials of the
    edits) and repaired (role and text of what stays). First those that are one row each, then the stretches of longer
    ones with the whole conversation's figures and their own edits and rows; None if there are none."""
    whole, long = turns.split(turns.plain(conversations, " "), most_rows, most_bytes)
    done = _mapped(turns.gathered(whole), DONE, _whole, "turns")
    if long is None:
        return done, None
    parts = written(turns.cut(_again(long), "again"), "stretches")
    chosen = _chosen(_mapped(parts, WAYS, _ways, "turns")).withColumnRenamed("conv_id", "_of")
    met = parts.withColumnRenamed("stretch", "_at").join(chosen, (F.col("_at") == F.col("stretch")) & F.col("conv_id").eqNullSafe(F.col("_of")))

    def applied_there(*values) -> tuple:
        *figures, begin, audit, rows = values
        return (*figures, audit, _listed(applied(_plain(rows)[1], begin, audit)))

    return done, _mapped(met, DONE, applied_there, *FIGURES, "begin", "audit", "turns")


def report(whole: DataFrame, long: DataFrame | None) -> DataFrame:
    """One row a conversation: figures, audit and the sha256 of the repaired rows, as role:text, one a line."""
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    out = whole.select("conv_id", *FIGURES, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    if long is None:
        return out
    rows = written(long.select("conv_id", "stretch", *FIGURES, "audit", F.when(F.size("repaired") > 0, lines).alias("lines")), "repaired")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "audit"))), lambda x: x["audit"]), "")
    sums = rows.groupBy("conv_id").agg(*(F.first(c).alias(c) for c in FIGURES), audit.alias("audit")).withColumnRenamed("conv_id", "_of")
    met = turns.chained(rows, "\n", "lines").join(sums, F.col("conv_id").eqNullSafe(F.col("_of")))
    return out.unionByName(met.select("conv_id", *FIGURES, "audit", F.col("lines").alias("repaired_sha256")))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (nulls as one space) with faults by crc32 of conv_id:turn, modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.plain(conversations, " ").withColumn("_hit", F.crc32(key) % 20).where("_hit <> 0")
    text: Column = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def with_all(done: DataFrame, conversations: DataFrame) -> DataFrame:
    """done, with a row of zeros, no edits and the digest of nothing for each conv_id of conversations that it lacks."""
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    rows = ids.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return rows.select(F.col("_id").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FIGURES), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
