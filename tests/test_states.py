"""Typed state: expiry by the clock, the funnel's changelog after every batch."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

from bizlink.operators.outreach import funnel
from bizlink.streaming import states

ATTEMPT = "phone7 string, name_norm string, attempt_id long, disposition string, attempted_at timestamp"


def test_funnel_stream_equals_the_table_after_every_batch(spark, tmp_path):
    rng, rows = random.Random(1), []
    start = datetime(2024, 1, 1)
    for i in range(400):
        rows.append((rng.choice([None, "5550101", "5550102"]), rng.choice([None, *(f"b{k}" for k in range(30))]), i, rng.choice(["booked", "interested", "no_answer"]), start + timedelta(minutes=i - rng.randint(0, 40))))
    tiles = [rows[k * 100 : k * 100 + 100] for k in range(4)]
    for k, tile in enumerate(tiles):
        spark.createDataFrame(tile, ATTEMPT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.05)
    stream = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    stream.transform(states.funnel_changes).writeStream.foreachBatch(states.funnel_sink(out)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    for k in range(4):
        want = funnel(spark.createDataFrame([r for t in tiles[: k + 1] for r in t], ATTEMPT)).first().asDict()
        assert states.read_funnel(spark, out, k).first().asDict() == want
    assert states.state_keys(spark, f"{tmp_path}/cp") == len({r[:2] for r in rows})


def test_progress_expires_by_the_clock_and_its_state_goes(spark, tmp_path):
    schema = "job_id long, seq long, pct int, stage string, type string, ts timestamp"
    spark.createDataFrame([(1, 1, 10, "a", "progress", datetime(2024, 1, 1)), (2, 1, 20, "a", "progress", datetime(2024, 1, 1))], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    changes = states.latest_progress(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3, by_clock=True)
    query = changes.writeStream.format("memory").queryName("expired_progress").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(0.5)
            found = spark.table("expired_progress").groupBy("type").count().collect()
            if {r["type"]: r["count"] for r in found} == {"progress": 2, "expired": 2}:
                break
        assert {r["type"]: r["count"] for r in found} == {"progress": 2, "expired": 2}
    finally:
        query.stop()
    assert states.state_keys(spark, f"{tmp_path}/cp") == 0
    assert states.live_progress(spark.table("expired_progress")).count() == 0
