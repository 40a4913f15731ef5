"""Ranking, cutting and gating per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlink.functions.identity import filled
from bizlink.functions.scoring import is_accurate, is_contactable, is_verified, n_sources


def first_by(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts inside the tasks before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def gated_export(leads: DataFrame, target: int, score: str = "lead_score", milli: str = "conf_milli") -> DataFrame:
    """The leads each job delivers, best first, with their place in ``export_rank``.

    Gates in turn: verified and accurate, else verified, each cut at ``target``; else all that
    are validated, else all. Of these the contactable ones, unless that leaves none. Flags are
    counted per job and the gate is chosen from the counts, so one job is one window, sorted once.
    """
    job = Window.partitionBy("job_id")
    ok, sure = is_verified(score), is_accurate(milli)
    tier = F.when(ok & sure, 3).when(ok, 2).when(F.col("status") == "validated", 1).otherwise(0)
    flagged = leads.withColumn("_tier", tier).withColumn("_valid", F.col("status") == "validated")
    best = F.max("_tier").over(job)
    chosen = flagged.withColumn("_best", F.when(best >= 2, best).when(F.max(F.col("_valid").cast("int")).over(job) == 1, 1).otherwise(0))
    pool = chosen.where(F.when(F.col("_best") >= 2, F.col("_tier") >= F.col("_best")).when(F.col("_best") == 1, F.col("_valid")).otherwise(True))
    order = [F.coalesce(score, F.lit(0)).desc(), F.coalesce(milli, F.lit(0)).desc(), F.col("ord"), F.col("lead_id")]
    by_rank = job.orderBy(*order)
    cut = pool.withColumn("_rn", F.row_number().over(by_rank)).where((F.col("_best") < 2) | (F.col("_rn") <= target))
    reach = cut.withColumn("_reach", is_contactable().cast("int")).withColumn("_any", F.max("_reach").over(job))
    kept = reach.where((F.col("_any") == 0) | (F.col("_reach") == 1))
    return kept.withColumn("export_rank", F.row_number().over(by_rank)).drop("_tier", "_valid", "_best", "_rn", "_reach", "_any")


def batch_cut(leads: DataFrame, target: int, batch: int = 50, score: str = "lead_score") -> DataFrame:
    """The prefix of each job's ranked candidates that work reaches: whole batches, until the
    verified ones so far (those already scored included) meet the target.

    Batches are summed first and the running sum is taken over batches, not rows."""
    w = Window.partitionBy("job_id").orderBy("ord", "lead_id")
    numbered = leads.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch)).withColumn("_ok", is_verified(score).cast("int"))
    done = F.col("status") == "validated"
    per = numbered.groupBy("job_id", "batch").agg(F.sum(F.when(done, F.col("_ok")).otherwise(0)).alias("had"), F.sum(F.when(done, 0).otherwise(F.col("_ok"))).alias("new"))
    before = Window.partitionBy("job_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    reached = per.withColumn("verified_before", F.sum("had").over(Window.partitionBy("job_id")) + F.coalesce(F.sum("new").over(before), F.lit(0)))
    return numbered.join(reached.where(F.col("verified_before") < target).select("job_id", "batch", "verified_before"), ["job_id", "batch"]).drop("_ok")


def likelihood_order() -> list[Column]:
    """Most likely to verify first: sources, maps, npi, phone, website, then arrival."""
    npi = F.array_contains(F.split(F.coalesce("sources", F.lit("")), ","), "npi")
    flags = [n_sources(), F.coalesce("has_google_maps", F.lit(False)), npi, filled(F.col("phone")), filled(F.col("website"))]
    return [*(f.desc() for f in flags), F.col("ord")]


def source_rank_order() -> list[Column]:
    return [n_sources().desc(), F.coalesce("has_google_maps", F.lit(False)).desc(), F.col("ord")]


def pool_size(limit: Column, factor: float = 1.5, most: int = 800) -> Column:
    return F.least(F.floor(limit * F.lit(factor)).cast("int"), F.lit(most))


def page(df: DataFrame, number: int, per_page: int, order: list) -> DataFrame:
    """One page in a total order; ``per_page`` from 1 to 200."""
    if number < 1 or not 1 <= per_page <= 200:
        raise ValueError("page from 1, per_page from 1 to 200")
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def tab(df: DataFrame, name: str) -> DataFrame:
    """Rows of a result tab; an unknown tab filters nothing."""
    site = F.col("category") == "has_website"
    conds = {"no_website": ~site, "has_website": site, "has_gmaps": F.coalesce("has_google_maps", F.lit(False)), "owner_found": filled(F.col("owner_name")), "high_value": F.col("lead_score") >= 70}
    return df.where(conds[name]) if name in conds else df


def stale_jobs(jobs: DataFrame, as_of: Column, seconds: int = 9000) -> DataFrame:
    """Running jobs whose last sign of life is older than ``seconds`` before ``as_of``."""
    seen = F.coalesce("heartbeat_at", "created_at")
    return jobs.where((F.col("status") == "running") & (seen < as_of - F.make_dt_interval(secs=F.lit(seconds))))
