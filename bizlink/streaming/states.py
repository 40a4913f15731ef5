"""Keyed state that expires: last progress, changes, and the funnel as a changelog.

Each is a stateful processor with typed values and timers. Time is that of the events (a
watermark moves it) or of the clock; by the clock a key's state goes without further input.
Run under the RocksDB state store (:func:`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bizlink.operators.outreach import KEYS

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that typed state needs, for the session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Expiring(StatefulProcessor):
    """A value per key with one timer, moved at each input."""

    schema = ""

    def __init__(self, seconds: int, by_clock: bool) -> None:
        self.limit, self.by_clock = seconds * 1000, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def wait(self, timers, last_ms: int) -> None:
        """Expire ``limit`` after the last event, or after now by the clock."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        now = timers.getCurrentProcessingTimeInMs() if self.by_clock else max(last_ms, timers.getCurrentWatermarkInMs() + 1 - self.limit)
        self.handle.registerTimer(now + self.limit)

    def close(self) -> None:
        pass


def _ms(stamp: pd.Timestamp) -> int:
    return stamp.value // 1_000_000


class LatestProgress(_Expiring):
    schema = "ms bigint, seq bigint"
    columns = ["job_id", "ts_ms", "seq", "pct", "stage", "type"]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = pd.concat(list(rows)).sort_values(["ts", "seq"]).iloc[-1]
        ms = _ms(last["ts"])
        if self.value.exists() and tuple(self.value.get()) > (ms, last["seq"]):
            return
        self.value.update((ms, int(last["seq"])))
        self.wait(timerValues, ms)
        yield pd.DataFrame([(key[0], ms, last["seq"], last["pct"], last["stage"], last["type"])], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms, seq = self.value.get()
        self.value.clear()
        yield pd.DataFrame([(key[0], ms + self.limit, seq, None, None, "expired")], columns=self.columns)


class ChangesOnly(_Expiring):
    schema = "pct int, over boolean, before bigint"
    columns = ["job_id", "seq", "pct", "type"]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, over, before = self.value.get() if self.value.exists() else (-1, False, None)
        keep = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            now = _ms(r.ts)
            if before is not None and now - before > self.limit:
                last, over = -1, False
            if not over and (r.pct != last or r.type == "done"):
                keep.append((key[0], r.seq, r.pct, r.type))
                last, over = r.pct, r.type == "done"
            before = now
        self.value.update((int(last), bool(over), int(before)))
        self.wait(timerValues, before)
        yield pd.DataFrame(keep, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        return iter([])


class Dispositions(_Expiring):
    """A business's last disposition; each change takes the old one back and adds the new one."""

    schema = "ms bigint, attempt bigint, disposition string"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows))
        last = frame.sort_values(["attempted_at", "attempt_id"]).iloc[-1]
        ms, attempt, disposition = _ms(last["attempted_at"]), int(last["attempt_id"]), str(last["disposition"])
        old = tuple(self.value.get()) if self.value.exists() else None
        changes = [("", len(frame), 0)]
        if old is None or old[:2] < (ms, attempt):
            if old is None or old[2] != disposition:
                changes += ([(old[2], 0, -1)] if old else []) + [(disposition, 0, 1)]
            self.value.update((ms, attempt, disposition))
        self.wait(timerValues, ms)
        yield pd.DataFrame(changes, columns=["disposition", "attempts", "businesses"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        return iter([])


def _run(stream: DataFrame, keys: list[str], when: str, late: str, processor: _Expiring, schema: str) -> DataFrame:
    use_state_store(stream.sparkSession)
    if not processor.by_clock:
        stream = stream.withWatermark(when, late)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if processor.by_clock else "EventTime")


def latest_progress(progress: DataFrame, ttl_seconds: int = 3600, by_clock: bool = False) -> DataFrame:
    """Changes of the last progress per job, as an append stream: a row with a job's newest
    progress, and a row of type ``expired`` when the job has been silent for ``ttl_seconds``,
    upon which its state goes. :func:`live_progress` reads the table from it."""
    return _run(progress, ["job_id"], "ts", "10 minutes", LatestProgress(ttl_seconds, by_clock), "job_id long, ts_ms long, seq long, pct int, stage string, type string")


def live_progress(changes: DataFrame) -> DataFrame:
    """Last progress of the jobs that haven't expired."""
    last = changes.groupBy("job_id").agg(F.max(F.struct("ts_ms", "seq", "pct", "stage", "type")).alias("l"))
    return last.where("l.type <> 'expired'").select("job_id", "l.seq", "l.pct", "l.stage", "l.type")


def changes_only(progress: DataFrame, give_up_seconds: int = 8100, by_clock: bool = False) -> DataFrame:
    """Updates of a job where its percentage changed, until a terminal one; nothing after that.
    A job without updates for ``give_up_seconds`` is given up: its state goes, and what comes
    later is like a new job's, whether the gap ends inside a batch or not."""
    return _run(progress, ["job_id"], "ts", "10 minutes", ChangesOnly(give_up_seconds, by_clock), "job_id long, seq long, pct int, type string")


def funnel_changes(attempts: DataFrame, ttl_seconds: int = 400 * 86_400, by_clock: bool = False) -> DataFrame:
    """The funnel as a changelog ``(disposition, attempts, businesses)`` to be summed: attempts
    stand beside an empty disposition; a business counts -1 where it was and +1 where it is.
    After ``ttl_seconds`` without attempts its state goes: it stays counted where it was last,
    and a later attempt counts it once more."""
    return _run(attempts, KEYS, "attempted_at", "1 hour", Dispositions(ttl_seconds, by_clock), "disposition string, attempts long, businesses long")


def funnel_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps each batch's sums under its number, so that a batch
    that runs again replaces its own."""

    def write(batch: DataFrame, n: int) -> None:
        batch.groupBy("disposition").agg(F.sum("attempts").alias("attempts"), F.sum("businesses").alias("businesses")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def read_funnel(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The funnel after a batch (default: all), in the columns of the table's funnel."""
    rows = spark.read.schema("disposition string, attempts long, businesses long, batch long").parquet(path)
    if batch is not None:
        rows = rows.where(F.col("batch") <= batch)
    of = lambda d: F.coalesce(F.sum(F.when(F.col("disposition") == d, F.col("businesses"))), F.lit(0)).alias(d)
    one = rows.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("businesses"), F.lit(0)).alias("contacted"), of("booked"), of("interested"))
    tenths = F.floor((F.col("booked") * 2000 + F.col("contacted")) / (F.col("contacted") * 2))
    return one.withColumn("conversion_pct", F.when(F.col("contacted") > 0, tenths / 10).otherwise(0.0))


def state_keys(spark: SparkSession, checkpoint: str) -> int:
    """How many keys the ``value`` state of a stream's last batch holds."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "value").load().count()
