"""Extraction of many datasets side by side: each in Spark jobs of its own, with a time limit, and a status row whatever happens.

A dataset's jobs carry a tag and run in a fair pool of its own, so a large one doesn't hold back small ones. One that takes
too long has its jobs cancelled by that tag; one that fails is tried again. Neither stops the others. What is written is
written by Spark's committer, so an interrupted dataset leaves no rows, and a rerun takes up the datasets that weren't
finished.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from queue import Empty, Queue

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sources.files import discard

STATUS = "name string, status string, n_rows long, tries int, seconds double, error string"


def _extracted(spark: SparkSession, made: Callable[[], DataFrame], path: str) -> int:
    """Rows written to path, counted from the files."""
    made().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).count()


def finished(status: DataFrame) -> set[str]:
    """Datasets of status tables (all runs in one) that have been extracted: a rerun leaves them as they are."""
    return {r["name"] for r in status.where("status = 'ok'").select("name").distinct().collect()}


def supervised(
    spark: SparkSession,
    datasets: dict[str, Callable[[], DataFrame]],
    folder: str,
    seconds: float = 3600.0,
    at_once: int = 4,
    tries: int = 2,
    done: Iterable[str] = (),
) -> DataFrame:
    """Writes each dataset to folder/name and returns a status row for each: ok, failed, timeout or skipped.

    datasets: by name, what makes the rows; it is called where the dataset runs. seconds: a dataset's limit for all its
    tries. at_once: datasets that run side by side. done: names that are skipped, see `finished`. A limit ends a dataset's
    Spark jobs; code on the driver that hangs outside of Spark is left behind in its thread, and told as a timeout too.
    """
    context, done, results = spark.sparkContext, set(done), Queue()
    rows = [(name, "skipped", None, 0, 0.0, None) for name in datasets if name in done]
    waiting = [name for name in datasets if name not in done]
    running: dict[str, tuple[float, str]] = {}  # when it must end, and its tag

    def run(name: str, tag: str, ends: float) -> None:
        began, error, count = time.monotonic(), "", 0
        context.setLocalProperty("spark.scheduler.pool", name)
        context.addJobTag(tag)
        while count < tries and time.monotonic() < ends:
            count += 1
            try:
                n = _extracted(spark, datasets[name], f"{folder}/{name}")
                results.put((name, tag, (name, "ok", n, count, time.monotonic() - began, None)))
                return
            except Exception as e:  # whatever ends a dataset becomes its status, and the others go on
                error = f"{type(e).__name__}: {e}".split("\n")[0][:500]
        status = "failed" if time.monotonic() < ends else "timeout"
        results.put((name, tag, (name, status, None, count, time.monotonic() - began, error)))

    while waiting or running:
        while waiting and len(running) < at_once:
            name, tag = waiting.pop(0), f"extract-{uuid.uuid4().hex}"
            running[name] = (time.monotonic() + seconds, tag)
            InheritableThread(target=run, args=(name, tag, running[name][0]), daemon=True).start()
        try:
            name, tag, row = results.get(timeout=max(0.0, min(ends for ends, _ in running.values()) - time.monotonic()))
            if running.get(name, (0, ""))[1] == tag:
                del running[name]
                rows.append(row)
        except Empty:
            for name, (ends, tag) in list(running.items()):
                if time.monotonic() >= ends:
                    context.cancelJobsWithTag(tag)
                    del running[name]
                    rows.append((name, "timeout", None, 1, float(seconds), f"took more than {seconds:g} seconds"))
    for name, status, *_ in rows:
        if status in ("failed", "timeout"):
            discard(spark, f"{folder}/{name}")
    return spark.createDataFrame(rows, STATUS).select("*", F.current_timestamp().alias("at"))
