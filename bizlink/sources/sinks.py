"""What runs write: export views, manifests, prompts; and how partitions are replaced."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlink.streaming.jobs import scratch

__all__ = ["scratch", "export_view", "write_partitioned", "replace_jobs", "without_jobs", "manifests", "report_sections", "prompt_table", "dossier_facts", "ask", "dates_in"]
#: Columns of the export in order; what a frame lacks comes as null.
EXPORT = [
    "name", "business_category", "lead_score", "data_confidence", "verification_tier", "phone_formatted", "phone_verified", "owner_name", "owner_phone", "owner_phone_type",
    "owner_phone_confidence", "owner_email", "email_verified", "pitch_ready", "website", "website_cms", "has_ssl", "website_name_found", "google_maps_url", "google_rating",
    "google_review_count", "hours", "address", "social_facebook", "social_instagram", "sources", "description", "employee_count", "year_founded", "partners",
    "recent_activity", "services", "owner_title", "review_weaknesses", "review_weakness_count", "review_themes", "last_review_date", "owner_responds", "legal_name",
    "entity_type", "entity_status", "registration_date", "registry_source", "external_platforms", "marketing_stack", "pitch_angle", "pain_points", "opener",
]


def export_view(leads: DataFrame) -> DataFrame:
    """Key columns, category and the export's own columns."""
    have = set(leads.columns)
    own = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EXPORT]
    return leads.select("lead_id", "job_id", "category", *own)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Rows of a partition together in few files, sorted best first inside them."""
    order = [F.col("lead_score").desc()] if "lead_score" in df.columns else []
    df.repartition(*(F.col(c) for c in by), F.pmod(F.xxhash64("lead_id"), F.lit(16))).sortWithinPartitions(*by, *order).write.mode("overwrite").partitionBy(*by).parquet(path)


def replace_jobs(leads: DataFrame, path: str) -> None:
    """Write leads partitioned by job; the partitions of the jobs in the frame are replaced
    as a whole, all others stay. A run that is repeated gives the same table."""
    leads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def without_jobs(leads: DataFrame, jobs: DataFrame) -> DataFrame:
    """All leads but those of the jobs given; the ledger isn't touched."""
    return leads.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def manifests(leads: DataFrame, jobs: DataFrame | None = None, files: dict[str, str] | None = None) -> DataFrame:
    """``(job_id, manifest)``: counts and score range of each job as JSON. ``jobs`` brings
    ``niche, location, total_scraped, total_verified``, ``files`` names what was written."""
    n, s = F.count("*"), F.sum(F.coalesce("lead_score", F.lit(0)))
    low = F.coalesce("lead_score", F.lit(0))
    score = F.struct(F.min(low).alias("min"), F.max(low).alias("max"), (F.floor((s * 20 + n) / (n * 2)) / 10).cast("double").alias("avg"))
    made = leads.groupBy("job_id").agg(n.alias("exported"), score.alias("lead_score"))
    names = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in (files or {}).items()))) if files else F.lit("{}")
    if jobs is None:
        jobs = made.select("job_id", *(F.lit(None).cast(t).alias(c) for c, t in (("niche", "string"), ("location", "string"), ("total_scraped", "long"), ("total_verified", "long"))))
    both = made.join(jobs.select("job_id", "niche", "location", "total_scraped", "total_verified"), "job_id", "left")
    counts = F.struct("total_scraped", "total_verified", "exported")
    whole = F.struct("job_id", "niche", "location", counts.alias("counts"), "exported", "lead_score", F.from_json(names, "map<string, string>").alias("files"))
    return both.select("job_id", F.to_json(whole).alias("manifest"))


def report_sections(leads: DataFrame) -> DataFrame:
    """``(job_id, section, place, lead_id)``: a job's two sections, no website first, each by
    falling score; equal scores by arrival."""
    kept = leads.where(F.col("category").isin("no_website", "has_website"))
    w = Window.partitionBy("job_id", "category").orderBy(F.coalesce("lead_score", F.lit(0)).desc(), "ord")
    return kept.select("job_id", F.when(F.col("category") == "no_website", 1).otherwise(2).alias("section"), F.row_number().over(w).alias("place"), "lead_id")


def socials_of() -> Column:
    return F.concat_ws(", ", *(F.when(F.coalesce(F.col(f"social_{s}") != "", F.lit(False)), s) for s in ("facebook", "instagram", "linkedin", "twitter")))


def _or(c: Column, default: str) -> Column:
    text = c.cast("string")
    return F.when(F.coalesce(text != "", F.lit(False)), text).otherwise(default)


def lead_facts(review_texts: Column, velocity: Column) -> dict[str, Column]:
    """Stored facts of a lead under their names, with the words that stand for what is missing."""
    c = F.col
    yes = lambda name: F.when(F.coalesce(c(name), F.lit(False)), "yes").otherwise("no/unknown")
    rating = F.when(c("google_rating").isNotNull(), F.format_string("%.1f", "google_rating"))
    return {
        "name": _or(c("name"), ""), "category": _or(c("business_category"), "(unknown)"), "location": _or(c("address"), "(unknown)"), "website": _or(c("website"), "(none)"), "platform": _or(c("website_cms"), "(unknown)"),
        "ssl": yes("has_ssl"), "services": _or(c("services"), "(none listed)"), "about": _or(c("description"), "(none)"), "rating": _or(rating, "(unknown)"), "reviews": _or(c("google_review_count"), "(unknown)"),
        "reviews_per_year": _or(velocity, "unknown"), "open_now": _or(c("google_is_open"), "(unknown)"), "platforms": _or(c("external_platforms"), "(none detected)"), "marketing": _or(c("marketing_stack"), "(none detected)"),
        "weaknesses": F.when(F.coalesce(c("review_weakness_count") > 0, F.lit(False)), c("review_weakness_count").cast("string")).otherwise("(none found)"), "review_texts": _or(review_texts, "(none)"),
        "owner": _or(c("owner_name"), "(unknown)"), "owner_title": _or(c("owner_title"), "(unknown)"), "team_size": _or(c("employee_count"), "(unknown)"), "founded": _or(c("year_founded"), "(unknown)"), "socials": _or(socials_of(), "(none found)"),
    }


def prompt_table(leads: DataFrame, review_texts: Column | None = None, velocity: Column | None = None) -> DataFrame:
    """One text of stored facts per lead, a line for each, to hand to a model."""
    none = F.lit(None).cast("string")
    facts = lead_facts(none if review_texts is None else review_texts, none if velocity is None else velocity)
    return leads.withColumn("facts", F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in facts.items())))


def dossier_facts(leads: DataFrame, page_text: Column, rivals: Column) -> DataFrame:
    """The prompt's facts with what the dossier adds: the site's text (5000 characters are
    what a prompt takes), and named competitors."""
    known = prompt_table(leads)
    more = [F.concat(F.lit("page_text: "), _or(F.substring(page_text, 1, 5000), "(website text unavailable)")), F.concat(F.lit("competitors: "), _or(rivals, "(none)"))]
    return known.withColumn("facts", F.concat_ws("\n", "facts", *more))


def ask(prompts: DataFrame, model: Callable[[list[str]], list[str | None]] | None, column: str = "facts") -> DataFrame:
    """Add ``reply``: what ``model`` answers to a batch of prompts, run inside the tasks. Without
    a model there are no replies; a batch that fails gives none either, and others go on."""
    if model is None:
        return prompts.withColumn("reply", F.lit(None).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", reply string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            try:
                replies = model(pdf[column].tolist())
            except Exception:  # noqa: BLE001 - whatever a user's function raises
                logging.getLogger(__name__).exception("the model failed for a batch")
                replies = [None] * len(pdf)
            yield pdf.assign(reply=pd.Series(replies, dtype=object, index=pdf.index))

    return prompts.mapInPandas(run, schema)


def dates_in(text: Column) -> Column:
    """Distinct dates a page names: in time elements, as ISO dates or with the month's English name."""
    plain = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"""<time[^>]*datetime=["'](\d{4}[-/]\d{1,2}[-/]\d{1,2})""", r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b")))
    iso = F.transform(F.filter(plain, lambda d: d.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}")), lambda d: F.try_to_date(F.replace(d, F.lit("/"), F.lit("-")), "yyyy-MM-dd"))
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    long_ = F.transform(F.regexp_extract_all(text, F.lit(rf"((?:{months})\s+\d{{1,2}},?\s+\d{{4}})"), F.lit(1)), lambda d: F.try_to_date(F.replace(d, F.lit(","), F.lit("")), "MMMM d yyyy"))
    return F.array_distinct(F.array_compact(F.concat(iso, long_)))
