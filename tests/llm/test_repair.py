"""Structure repair against exhaustive search and against a plain table of whole strings."""

import hashlib
import random
from itertools import product
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import queries, repair
from tests.llm import edges

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROW = st.tuples(st.sampled_from("suat"), st.sampled_from(["", "blank", "duplicate", "truncated"]))


def exhaustive(rows):
    """The best (cost, audit) by trying all edits, with up to two insertions at each place."""
    best = None
    todo = [(0, 0, "", "", 0)]
    while todo:
        k, cost, audit, now, added = todo.pop()
        if k == len(rows) and now in ("", "a") and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if added < 2 and (y := "a" if now == "u" else "u"):
            todo.append((k, cost + 3, audit + "I", y, added + 1))
        if k < len(rows):
            role, fault = rows[k]
            todo.append((k + 1, cost + 4, audit + "D", now, 0))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                todo.append((k + 1, cost + 3 + more, audit + "R", "a" if now == "u" else "u", 0))
                if y := STEP.get((now, role)):
                    todo.append((k + 1, cost + more, audit + "K", y, 0))
    return best


def table(rows):
    """The same by a table of whole strings."""
    def inserted(best):
        for _ in range(3):
            for x, (cost, audit) in list(best.items()):
                y = "a" if x == "u" else "u"
                best[y] = min(best.get(y, (10**9, "")), (cost + 3, audit + "I"))
        return best

    best = inserted({"": (0, "")})
    for role, fault in rows:
        new = {}
        for x, (cost, audit) in best.items():
            ways = [(x, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append(("a" if x == "u" else "u", cost + 3 + more, "R"))
                if (x, role) in STEP:
                    ways.append((STEP[x, role], cost + more, "K"))
            for y, c, e in ways:
                new[y] = min(new.get(y, (10**9, "")), (c, audit + e))
        best = inserted(new)
    return min(best[x] for x in ("", "a") if x in best)


def ours(rows):
    search = repair.Search(repair.NONE)
    for role, fault in rows:
        search.row(role, fault in ("blank", "duplicate"), fault == "truncated")
    return search


@given(st.lists(ROW, max_size=5))
@settings(max_examples=300, deadline=None)
def test_small_ones_by_trying_all(rows):
    assert repair.cheapest(ours(rows).ends()) == exhaustive(rows) == table(rows)


@pytest.mark.parametrize("roles", ["sua", "ua", "u", "a", "us", "suat", "uaus"])
def test_long_ones_against_whole_strings(roles):
    rng = random.Random(roles)
    for n in (1, 7, 60, 150):
        rows = [(rng.choice(roles), rng.choice(["", "", "", "blank", "truncated", "duplicate"])) for _ in range(n)]
        assert repair.cheapest(ours(rows).ends()) == table(rows)
        cuts = sorted(rng.choices(range(n + 1), k=3))
        first = {repair.NONE: (0, [])}
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            found = [f for _, f in rows[a:b]]
            ways = {(x, y): w for x in range(4) for y, w in repair.searched([(r, "") for r, _ in rows[a:b]], found, x).ends().items()}
            first = repair.joined(first, ways)
        cost, audit = min((c, "".join(e for _, e in way)) for c, way in (first[x] for x in (repair.NONE, repair.ASSISTANT) if x in first))
        assert (cost, audit) == table(rows)


def test_edits_are_emitted_and_memory_is_bounded():
    rng, search = random.Random(1), repair.Search(repair.NONE)
    for k in range(20_000):
        role = "ua"[k % 2] if rng.random() > 0.2 else rng.choice("suat")
        search.row(role, rng.random() < 0.05, rng.random() < 0.05)
    assert len(search.emitted) > 19_000 and search.open < 200


def test_tied_suffixes_are_compared_whole():
    """Two paths stay tied over a long stretch, and the letter that tells is its first."""
    for rows in product([("u", ""), ("a", ""), ("u", "truncated")], repeat=6):
        assert repair.cheapest(ours(list(rows)).ends()) == table(list(rows))


def plain_damaged(rows):
    for key, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        hit = crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        row = (key, turn, "user" if hit == 4 else role, text)
        yield from [row, row] if hit == 3 else [row]


def plain_report(ids, rows):
    by = {key: [] for key in ids}
    for r in rows:
        by[r[0]].append(r)
    out = []
    for key, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, kinds = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = table([(r[2][:1], f) for r, f in zip(own, kinds, strict=True)])
        now, k, lines = "", 0, []
        for e in audit:
            role, text = ("", "") if e == "I" else own[k][2:]
            k += e != "I"
            if e != "D":
                role = role if e == "K" else "assistant" if now == "u" else "user"
                now = role[0]
                lines.append(f"{role}:{text}")
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        out.append((key, gaps, *(kinds.count(c) for c in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=edges.key)


def test_query(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = queries.op13_structure_repair(spark, folder)
        assert got.dtypes == [("conv_id", "bigint"), *((c, "bigint") for c in repair.FIGURES), ("audit", "string"), ("repaired_sha256", "string")]
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert sorted(map(tuple, got.collect()), key=edges.key) == plain_report({r[0] for r in rows}, plain_damaged(rows))


def odd(seed=5):
    rng = random.Random(seed)
    rows = [(k // 9, k % 9, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "no", "Why?", "", None, " \t", "\xa0", "Well. \n", f"{k}!"])) for k in range(400)]
    rows += [(100, None, "user", "a."), (100, None, "user", "b."), (100, 3, "assistant", "c."), (100, 3, "assistant", "c."), (None, 1, "user", "x."), (None, None, None, None)]
    rows += [(101, k, ["user", "assistant"][k % 2], f"{rng.randrange(40)}.") for k in range(300)] + [(102, None, "user", None)] * 3 + [(103, 0, "user", "long " * 50_000 + ".")]
    return rows


@pytest.mark.parametrize(("most_rows", "most_bytes"), [(4096, 1 << 20), (1, 1 << 20), (4, 1 << 20), (64, 5_000)])
def test_odd_rows_whole_and_in_stretches(spark, most_rows, most_bytes):
    rows = odd()
    df = spark.createDataFrame([(*r, 1, 2, "a") for r in rows], "conv_id long, turn long, role string, text string, stretch int, nth int, again string").repartition(5)
    damaged = repair.damaged(df)
    whole, long = repair.repaired(damaged, most_rows, most_bytes)
    assert (long is None) == (most_rows == 4096)
    got = repair.with_all(repair.report(whole, long), df)
    assert sorted(map(tuple, got.collect()), key=edges.key) == plain_report({r[0] for r in rows}, plain_damaged(rows))
    whole, long = repair.repaired(df, most_rows, most_bytes)
    plain = [(a, b, c if c is not None else " ", d if d is not None else " ") for a, b, c, d in rows]
    assert sorted(map(tuple, repair.report(whole, long).collect()), key=edges.key) == plain_report({r[0] for r in rows}, plain)


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.with_all(repair.report(*repair.repaired(repair.damaged(none))), none).count() == 0
    gone = next(k for k in range(1000) if crc32(f"{k}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    row = repair.with_all(repair.report(*repair.repaired(repair.damaged(one))), one).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
