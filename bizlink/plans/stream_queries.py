"""Streaming queries run to the end of their input, each with the batch result as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlink.plans.outreach_queries import FUNNEL
from bizlink.plans.record_queries import CLOSURE
from bizlink.plans.registry import query
from bizlink.plans.views import OUTREACH, PROGRESS, table
from bizlink.streaming import jobs, states

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf_dir, sql):
    return spark.sql(sql, events=jobs.events_stream(spark, sf_dir, "events", _EVENTS))


@query("SELECT job_id, seq, pct, stage, type FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM v_progress) WHERE rn = 1 AND epoch_us(ts) // 1000 + 86400000 >= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM v_progress)")
def t1_latest_progress(spark, sf_dir):
    return states.live_progress(jobs.collect_all(states.latest_progress(_stream(spark, sf_dir, PROGRESS), 86_400), "append", "t1"))


@query("""SELECT job_id, seq, pct, type FROM (SELECT *, lag(pct) OVER w AS before, coalesce(sum(CASE WHEN type = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, life ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dones
 FROM (SELECT *, sum(CASE WHEN gap > 90000000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, seq) AS life FROM (SELECT *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY job_id ORDER BY ts, seq) AS gap FROM v_progress)) WINDOW w AS (PARTITION BY job_id, life ORDER BY ts, seq)) WHERE dones = 0 AND (before IS NULL OR before <> pct OR type = 'done')""")
def t2_progress_changes(spark, sf_dir):
    return jobs.collect_all(states.changes_only(_stream(spark, sf_dir, PROGRESS), 90_000), "append", "t2")


@query("SELECT job_id, epoch_us(ts) // 1000 AS last_ms FROM (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts) AS nxt FROM v_progress) WHERE epoch_us(nxt) // 1000 - epoch_us(ts) // 1000 > 90000000 OR (nxt IS NULL AND epoch_us(ts) // 1000 + 90000000 < (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM v_progress))")
def t3_silent_jobs(spark, sf_dir):
    return jobs.collect_all(jobs.silent_jobs(_stream(spark, sf_dir, PROGRESS), 90_000), "append", "t3")


@query("SELECT phone7, name_norm, attempt_id, disposition FROM (SELECT *, row_number() OVER (PARTITION BY phone7, name_norm ORDER BY attempted_at DESC, attempt_id DESC) AS rn FROM v_outreach) WHERE rn = 1")
def t4_latest_disposition(spark, sf_dir):
    return jobs.collect_all(jobs.latest_dispositions(_stream(spark, sf_dir, OUTREACH)), "complete", "t4")


@query(FUNNEL)
def t4_funnel_stream(spark, sf_dir):
    path = jobs.scratch(spark, "funnel")
    jobs.collect_all(states.funnel_changes(_stream(spark, sf_dir, OUTREACH)), "append", "t4f", states.funnel_sink(path))
    return states.read_funnel(spark, path).withColumn("conversion_pct", F.col("conversion_pct").cast("double"))


@query("SELECT DISTINCT phone7, name_norm FROM v_outreach WHERE phone7 IS NOT NULL OR name_norm IS NOT NULL")
def t5_delivery_ledger(spark, sf_dir):
    path = jobs.scratch(spark, "ledger")
    stream = jobs.deliveries(_stream(spark, sf_dir, OUTREACH).withColumnRenamed("attempted_at", "delivered_at"))
    jobs.collect_all(stream, "append", "t5", jobs.ledger_sink(path))
    return spark.read.schema("phone7 string, name_norm string, batch long").parquet(path).select("phone7", "name_norm")


_VERDICTS = "SELECT o_custkey AS user_id, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '9500' DAY AS checked_at, o_orderstatus AS verdict FROM {orders}"


@query("SELECT p.seq AS seq, CASE WHEN v.at >= p.ts - INTERVAL '400' DAY THEN v.verdict END AS verdict FROM (SELECT event_id AS seq, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events) p LEFT JOIN (SELECT user_id, max(checked_at) AS at, max(struct_pack(a := checked_at, b := verdict)).b AS verdict FROM (" + _VERDICTS.replace("{orders}", "orders").replace("INTERVAL '9500' DAY", "INTERVAL 9500 DAY") + ") GROUP BY user_id) v ON p.user_id = v.user_id")
def t6_fresh_verdicts(spark, sf_dir):
    events = _stream(spark, sf_dir, "SELECT event_id AS seq, user_id, CAST(ts AS TIMESTAMP) AS ts FROM {events}")
    verdicts = spark.sql(_VERDICTS, orders=table(spark, sf_dir, "orders"))
    return jobs.collect_all(jobs.with_fresh_verdict(events, verdicts, "user_id", 400 * 86400).select("seq", "verdict"), "append", "t6")


@query(f"""SELECT cluster AS ord, arg_min(name, ord) AS name, arg_min(phone, ord) FILTER (phone <> '') AS phone, arg_min(address, ord) FILTER (address <> '') AS address,
 array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, CAST(max(ord % 5) AS INT) AS phone_source_count FROM ({CLOSURE}) GROUP BY cluster""")
def t7_incremental_pool(spark, sf_dir):
    from bizlink.operators.entities import EntityStore
    from bizlink.plans.views import view

    path = jobs.scratch(spark, "tiles")
    tiles = view(spark, sf_dir, "businesses").select("ord", F.col("source").alias("sources"), (F.col("ord") % 5).cast("int").alias("phone_source_count"), "name", "phone", "address")
    tiles.repartitionByRange(3, F.col("ord") % 1000).write.parquet(path)
    stream = spark.readStream.schema(tiles.schema).option("maxFilesPerTrigger", 1).parquet(path)
    store = EntityStore(spark, jobs.scratch(spark, "pool"), ["name", "phone", "address"], 32)
    jobs.collect_all(stream, "append", "t7", jobs.pool_sink(store))
    return store.pool().select("ord", "name", "phone", "address", "sources", "phone_source_count")


@query("""SELECT seq, CAST(streak AS BIGINT) AS streak, max(streak) OVER (PARTITION BY server ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 5 AS tripped FROM (
 SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY server, run ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM (
  SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY server ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT event_id AS seq, user_id AS server, ts, event_type IN ('purchase', 'signup') AS ok FROM events)))""")
def t8_failure_streaks(spark, sf_dir):
    probes = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("server"), "ts", F.col("event_type").isin("purchase", "signup").alias("ok"))
    return jobs.failure_streaks(probes, 5).select("seq", "streak", "tripped")


@query("SELECT date_trunc('day', attempted_at) AS start, disposition, count(*) AS n FROM v_outreach GROUP BY ALL")
def ext_attempts_per_day(spark, sf_dir):
    return jobs.collect_all(jobs.attempts_per_window(_stream(spark, sf_dir, OUTREACH)), "complete", "ext")
