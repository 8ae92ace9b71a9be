"""Supervised extraction: limits, failures, tries and reruns."""

import os
import time

from pyspark.sql import functions as F

from labelloom.sources import extracts


def test_a_stuck_dataset_ends_and_the_others_finish(spark, tmp_path):
    seen = []

    def flaky():
        seen.append(1)
        if len(seen) == 1:
            raise ValueError("not yet\nsecond line")
        return spark.range(7)

    slow = F.pandas_udf(lambda x: (time.sleep(120), x)[1], "long")
    stuck = lambda: spark.range(2, numPartitions=1).select(slow("id").alias("id"))
    broken = lambda: spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    hung = lambda: time.sleep(60)
    began = time.monotonic()
    datasets = {"stuck": stuck, "one": lambda: spark.range(10), "flaky": flaky, "broken": broken, "hung": hung, "two": lambda: spark.range(20), "old": lambda: spark.range(5)}
    status = extracts.supervised(spark, datasets, str(tmp_path), seconds=12, at_once=2, tries=2, done=["old"])
    assert time.monotonic() - began < 50
    rows = {r["name"]: (r["status"], r["n_rows"], r["tries"]) for r in status.collect()}
    assert rows == {"stuck": ("timeout", None, 1), "one": ("ok", 10, 1), "flaky": ("ok", 7, 2), "broken": ("failed", None, 2), "hung": ("timeout", None, 1), "two": ("ok", 20, 1), "old": ("skipped", None, 0)}
    assert "broken" in status.where("name = 'broken'").first()["error"]
    assert sorted(os.listdir(tmp_path)) == ["flaky", "one", "two"]
    while not spark.sparkContext.statusTracker().getActiveJobsIds() == []:
        time.sleep(0.2)
        assert time.monotonic() - began < 60  # the stuck job was cancelled
    again = extracts.supervised(spark, {**datasets, "stuck": lambda: spark.range(1), "broken": lambda: spark.range(2), "hung": lambda: spark.range(3)}, str(tmp_path), seconds=60, done=extracts.finished(status))
    assert {r["name"]: r["status"] for r in again.collect()} == {"stuck": "ok", "broken": "ok", "hung": "ok", "old": "ok", "one": "skipped", "flaky": "skipped", "two": "skipped"}


def test_nothing_to_do(spark, tmp_path):
    assert extracts.supervised(spark, {}, str(tmp_path)).count() == 0
