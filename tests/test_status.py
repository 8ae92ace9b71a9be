"""Status rows with keyed state: batches, restarts, late rows, forgotten keys."""

import json

import pytest

from labelloom.streaming import status

DDL = "f string, status string, o long, at timestamp"


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("f", "status", "o", "at"), r, strict=True))) + "\n" for r in rows))


@pytest.fixture
def run(spark, tmp_path):
    def go(**more):
        status.follow(spark, str(tmp_path / "in"), DDL, str(tmp_path / "log"), str(tmp_path / "cp"), "f", "o", "at", files=1, **more)
        log = spark.read.schema(DDL).parquet(str(tmp_path / "log"))
        return sorted((r["f"], r["status"], r["o"]) for r in log.collect()), {r["f"]: (r["status"], r["o"]) for r in status.current(log, "f", "o").collect()}

    return go


def test_batches_and_restart(tmp_path, run):
    put(tmp_path / "in", "1.json", ("a", "failed", 1, "2024-01-01 00:00:00"), ("b", "ok", 1, "2024-01-01 00:00:00"), ("a", "skipped", 2, "2024-01-01 00:01:00"))
    put(tmp_path / "in", "2.json", ("a", "failed", 3, "2024-01-01 00:02:00"), ("b", "done", 2, "2024-01-01 00:02:00"), ("c", "other", 3, "2024-01-01 00:02:00"))
    log, now = run()
    assert now == {"a": ("skipped", 2), "b": ("done", 2), "c": ("other", 3)}
    assert log == [("a", "skipped", 2), ("b", "done", 2), ("b", "ok", 1), ("c", "other", 3)]  # a's failure changed nothing
    put(tmp_path / "in", "3.json", ("a", "ok", 4, "2024-01-01 00:03:00"), ("b", "failed", 9, "2024-01-01 00:03:00"), ("d", "failed", 1, "2024-01-01 00:03:00"))
    log, now = run()  # a new query over the same checkpoint
    assert now == {"a": ("ok", 4), "b": ("done", 2), "c": ("other", 3), "d": ("failed", 1)} and len(log) == 6
    assert run() == (log, now)  # nothing new, nothing read again


def test_late_rows_and_forgotten_keys(tmp_path, run):
    put(tmp_path / "in", "1.json", ("a", "ok", 1, "2024-01-01 00:00:00"), ("b", "failed", 1, "2024-01-01 00:00:00"))
    put(tmp_path / "in", "2.json", ("c", "ok", 1, "2024-03-01 00:00:00"))
    put(tmp_path / "in", "3.json", ("c", "failed", 2, "2024-03-01 00:00:01"))
    run(quiet="1 day")
    put(tmp_path / "in", "4.json", ("b", "ok", 2, "2024-01-02 00:00:00"), ("a", "failed", 2, "2024-03-01 00:00:02"))
    log, now = run(quiet="1 day")
    assert now["a"] == ("ok", 1) and ("a", "failed", 2) in log  # forgotten, so it is told again; the manifest knows better
    assert now["b"] == ("failed", 1) and now["c"] == ("ok", 1)  # two months late is left out


def test_keys_of_one_bucket(spark, tmp_path):
    """The timer of a bucket is that of the key to be forgotten first; the others stay until their own time."""

    def go():
        status.follow(spark, str(tmp_path / "in"), DDL, str(tmp_path / "log"), str(tmp_path / "cp"), "f", "o", "at", files=1, quiet="1 day", buckets=1)
        return [(r["f"], r["status"], r["o"]) for r in spark.read.schema(DDL).parquet(str(tmp_path / "log")).collect()]

    many = [(f"k{n}", "failed", 1, "2024-01-01 12:00:00") for n in range(40)]
    put(tmp_path / "in", "1.json", ("a", "ok", 5, "2024-01-01 00:00:00"), ("b", "ok", 5, "2024-01-01 12:00:00"), (None, "ok", 5, "2024-01-01 12:00:00"), *many)
    put(tmp_path / "in", "2.json", ("c", "ok", 5, "2024-01-02 06:00:00"))
    put(tmp_path / "in", "3.json", ("c", "failed", 6, "2024-01-02 06:00:01"))
    first = go()
    assert len(first) == 44
    again = [(k, "failed", 7, "2024-01-02 06:00:02") for k in ("a", "b", "c", None)]
    put(tmp_path / "in", "4.json", *again, ("k7", "skipped", 2, "2024-01-02 06:00:02"), ("k7", "skipped", 3, "2024-01-02 06:00:02"), ("k8", "failed", 1, "2024-01-02 06:00:02"))
    second = go()
    for row in first:
        second.remove(row)
    assert sorted(second) == [("a", "failed", 7), ("k7", "skipped", 3)]  # only a was forgotten


def test_state_is_by_bucket(spark, tmp_path):
    """Calls into Python and words with the store don't grow with the keys."""
    put(tmp_path / "in", "1.json", *((f"k{n}", "ok", n, "2024-01-01 00:00:00") for n in range(300)))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", status.STORE)
    try:
        out = status.changes(spark.readStream.schema(DDL).json(str(tmp_path / "in")), "f", "o", "at", buckets=8)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert spark.read.schema(DDL).parquet(str(tmp_path / "log")).count() == 300
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) <= 3 * 8  # a value and a timer, in two tables
