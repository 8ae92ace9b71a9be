"""Status rows as a stream with keyed state: the best status of each key is kept in a state store, not reread from a table.

State is kept by buckets of keys, as each call into Python and each word with the store costs more than a key's rows do: a
micro-batch touches only the buckets of the keys it holds, and appends a row for each key whose best status has changed;
nothing that was written is read or rewritten. Of a change log the best row of each key is the manifest, whatever was in
state, so state may be dropped: a timer does so for keys that had no row for `quiet` of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from labelloom.operators.manifest import best_status, priority

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BestStatus(StatefulProcessor):
    """Per bucket of keys, of each: the highest priority so far, of equals the last in order; emits the rows that take the lead.

    Rows have best_key (the key's text), best_p (priority), best_place (sorts as order does) and best_ends (when the key may be forgotten, ms).
    """

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "keys array<string>, priorities array<int>, places array<string>, ends array<long>")

    def _held(self) -> dict[str | None, tuple[int, str, int]]:
        held = self.best.get()
        return {k: (p, place, ends) for k, p, place, ends in zip(*held, strict=True)} if held else {}

    def _keep(self, best: dict[str | None, tuple[int, str, int]], timer: int | None) -> None:
        """Stores a bucket; its one timer (now at `timer`) is that of the key to be forgotten first."""
        first = min((ends for _, _, ends in best.values()), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if best:
            self.best.update((list(best), *(list(c) for c in zip(*best.values(), strict=True))))
        else:
            self.best.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        best, out = self._held(), None
        timer = min((ends for _, _, ends in best.values()), default=None)
        for part in rows:
            led = {}
            for at, (k, p, place, ends) in enumerate(zip(part["best_key"], part["best_p"].tolist(), part["best_place"], part["best_ends"].tolist(), strict=True)):
                held = best.get(k)
                if held is None or (p, place) > held[:2]:
                    led[k] = at
                    best[k] = (p, place, max(ends, held[2]) if held else ends)
                elif ends > held[2]:
                    best[k] = (*held[:2], ends)
            if led:  # one row a key stays, however many parts there are
                new = part.iloc[list(led.values())]
                out = new if out is None else pd.concat([out[~out["best_key"].isin(led)], new])
        self._keep(best, timer)
        if out is not None:
            yield out[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        self._keep({k: v for k, v in self._held().items() if v[2] > now}, None)  # a timer that rang is gone by itself
        yield from ()

    def close(self) -> None:
        pass


def changes(rows: DataFrame, key: str, order: str, time: str, late: str = "1 hour", quiet: str = "7 days", buckets: int = 1 << 12) -> DataFrame:
    """Of a stream of status rows those that take the lead of their key: at most one a key and micro-batch.

    key: a text, number, date or timestamp. order: a number, 0 or more. time: a timestamp; rows later than `late` behind the
    stream's latest are left out, and a key without rows for `quiet` is forgotten, so that a later row of it is a change
    again. buckets: a row costs up to one part in so many of the state, a micro-batch up to so many calls; with another
    number over the same checkpoint keys may be told again.
    """
    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    marked = rows.withWatermark(time, late).withColumns({
        "best_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), "best_key": F.col(key).cast("string"), "best_p": priority("status"),
        "best_place": F.lpad(F.floor(order).cast("string"), 20, "0"), "best_ends": F.unix_millis(time) + ms,
    })
    return marked.groupBy("best_bucket").transformWithStateInPandas(
        statefulProcessor=BestStatus(rows.columns), outputStructType=rows.schema, outputMode="Append", timeMode="EventTime")


def follow(spark: SparkSession, source: str, ddl: str, log: str, checkpoint: str, key: str, order: str, time: str, files: int = 1000, late: str = "1 hour", quiet: str = "7 days", buckets: int = 1 << 12) -> None:
    """New JSON-lines files of a folder into a change log (Parquet, appended); state and what was read are in checkpoint, so a
    stopped call goes on where it was."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).json(source)
        out = changes(stream, key, order, time, late, quiet, buckets).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def current(log: DataFrame, key: str, order: str) -> DataFrame:
    """The manifest of a change log: of each key the best status."""
    return best_status(log, key, order=order)
