"""Stateful jobs over streams of progress, attempts, deliveries and probes.

Every function takes a streaming DataFrame and returns one, or a started query; ``collect_all``
runs a stream over what is there and returns the result as a table, for tests and back-fills.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bizlink.operators.entities import EntityStore
from bizlink.operators.outreach import KEYS
from bizlink.scratch import scratch_path as scratch


def events_stream(spark: SparkSession, folder: str, table: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """A landed Parquet table as a stream of its files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def collect_all(stream: DataFrame, mode: str, tag: str, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream to the end of its input into a table: the last batch's rows in complete
    mode, all rows otherwise. A batch that runs again replaces its own rows."""
    spark = stream.sparkSession
    out, state = scratch(spark, tag), scratch(spark, f"{tag}-state")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch-{n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink or write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out) if sink is None else None


def pool_sink(store: EntityStore, target: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that resolves tiles against the store's index and merges them into
    its pool: a new spelling of a known business joins it. A batch is taken in once by its
    number, whole or not at all. A pool that has ``target`` records takes no more tiles."""

    def write(batch: DataFrame, n: int) -> None:
        if target is None or n == 0 or store.pool().count() < target:
            store.merge(batch, n)

    return write


def silent_jobs(progress: DataFrame, seconds: int = 9000) -> DataFrame:
    """A row per silence: a job that shows no sign for ``seconds`` of event time, with the last
    sign. A gap that ends inside a batch counts as one that times out."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit = seconds * 1000
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], last)], columns=["job_id", "last_ms"])
            return
        seen = sorted(t.value // 1_000_000 for f in frames for t in f["ts"])
        if state.exists:
            seen = [state.get[0], *seen]
        gaps = [(key[0], a) for a, b in zip(seen, seen[1:]) if b - a > limit]  # noqa: B905
        state.update((max(seen),))
        state.setTimeoutTimestamp(max(max(seen) + limit, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(gaps, columns=["job_id", "last_ms"])

    return progress.withWatermark("ts", "10 minutes").groupBy("job_id").applyInPandasWithState(step, "job_id long, last_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_dispositions(attempts: DataFrame) -> DataFrame:
    """Last attempt of each business as a running aggregate (update or complete mode)."""
    last = F.max(F.struct("attempted_at", "attempt_id", "disposition"))
    return attempts.groupBy(*KEYS).agg(last.alias("l")).select(*KEYS, F.col("l.attempt_id").alias("attempt_id"), F.col("l.disposition").alias("disposition"))


def ledger_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends businesses the ledger at ``path`` lacks. Written
    under the batch's number, so that a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col("phone7").isNotNull() | F.col("name_norm").isNotNull()).dropDuplicates(KEYS)
        if n > 0:
            had = spark.read.schema("phone7 string, name_norm string, batch long").parquet(path).where(F.col("batch") < n).select(*(F.col(k).alias(f"_{k}") for k in KEYS))
            fresh = fresh.join(had, fresh["phone7"].eqNullSafe(had["_phone7"]) & fresh["name_norm"].eqNullSafe(had["_name_norm"]), "left_anti")
        fresh.select(*KEYS).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def deliveries(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """Deliveries once per business inside the watermark; the ledger sink sees to the rest."""
    return stream.withWatermark("delivered_at", within).dropDuplicatesWithinWatermark(KEYS)


def with_fresh_verdict(stream: DataFrame, verdicts: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """Join the latest landed verdict of a key if it is no older than ``ttl_seconds`` before the
    row's own time; rows without one keep null."""
    last = verdicts.groupBy(key).agg(F.max(F.struct("checked_at", "verdict")).alias("v")).select(F.col(key).alias("_k"), F.col("v.checked_at").alias("_at"), F.col("v.verdict").alias("_verdict"))
    joined = stream.join(last, stream[key] == last["_k"], "left")
    fresh = F.col("_at") >= F.col("ts") - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return joined.withColumn("verdict", F.when(fresh, F.col("_verdict"))).drop("_k", "_at", "_verdict")


def failure_streaks(probes: DataFrame, limit: int) -> DataFrame:
    """Per server the running count of failures in a row, and whether ``limit`` was reached by
    then: rows are numbered within the runs that successes separate."""
    w = Window.partitionBy("server").orderBy("ts", "seq")
    runs = probes.withColumn("run", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy("server", "run").orderBy("ts", "seq")
    counted = runs.withColumn("streak", F.sum((~F.col("ok")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return counted.withColumn("tripped", F.max("streak").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) >= limit).drop("run")


def attempts_per_window(attempts: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: attempts per event-time window and disposition, late rows up to ``late``."""
    return attempts.withWatermark("attempted_at", late).groupBy(F.window("attempted_at", size), "disposition").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "disposition", "n")
