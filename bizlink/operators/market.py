"""Competitors, vertical profiles, summaries and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlink.functions.identity import filled

#: Profile names in order with the words that select them; the first hit wins.
PROFILES = [
    ("Roofing", ["roof"]),
    ("HVAC", ["hvac", "heating", "air conditioning", "cooling", "furnace", "ac repair"]),
    ("Plumbing", ["plumb"]),
    ("Electrical", ["electric"]),
    ("Solar", ["solar", "photovoltaic"]),
    ("Restoration (water/fire/mold)", ["restoration", "water damage", "fire damage", "mold", "disaster"]),
    ("Landscaping / Lawn", ["landscap", "lawn", "hardscape", "irrigation", "lawn care", "tree service"]),
    ("Concrete / Masonry / Paving", ["concrete", "masonry", "paving", "asphalt", "driveway"]),
    ("Painting", ["paint"]),
    ("Remodeling / General Contractor", ["remodel", "kitchen", "bath", "general contractor", "construction", "builder", "contractor", "renovation"]),
    ("Restaurant", ["restaurant", "cafe", "coffee", "bar", "grill", "pizzeria", "pizza", "diner", "eatery", "bakery", "bistro", "pub", "taco", "sushi", "kitchen"]),
    ("Hospitality / Lodging", ["hotel", "motel", "inn", "lodge", "resort", "hostel", "suites", "bed and breakfast", "b&b", "guest house"]),
]
FALLBACK = "Local business"


def profile_of(category: Column, profiles: list[tuple[str, list[str]]] | None = None) -> Column:
    """Name of the first profile whose word is in the category. The profiles are a handful of
    literals (rows may be added), so a CASE does what a join would, without one."""
    text, out = F.lower(F.coalesce(category, F.lit(""))), F.lit(FALLBACK)
    for name, words in reversed(profiles or PROFILES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def competitors(leads: DataFrame, most: int = 6) -> DataFrame:
    """Each named lead's strongest peers in its job, best first, at most ``most``.

    The top ``most + 1`` of each job are found once and joined to the job's leads; dropping
    self leaves at least ``most``. No lead is compared with all others."""
    order = [F.coalesce("google_rating", F.lit(0.0)).desc(), F.coalesce("google_review_count", F.lit(0)).desc(), F.col("lead_id")]
    w = Window.partitionBy("job_id").orderBy(*order)
    top = leads.where(filled(F.col("name"))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most + 1)
    top = top.select("job_id", F.col("lead_id").alias("rival_id"), F.col("name").alias("rival_name"), "google_rating", "google_review_count", "r")
    own = top.where(F.col("r") <= most).select(F.col("rival_id").alias("lead_id"), F.col("r").alias("own_r"))
    both = leads.select("job_id", "lead_id").join(top, "job_id").where("lead_id <> rival_id").join(own, "lead_id", "left")
    place = F.col("r") - F.when(F.col("own_r") < F.col("r"), 1).otherwise(0)
    return both.withColumn("place", place).where(F.col("place") <= most).select("job_id", "lead_id", "place", "rival_id", "rival_name")


def counts(leads: DataFrame) -> DataFrame:
    """The summary sheet's figures in one pass, one row per metric."""
    n = lambda cond: F.count_if(cond)
    has = lambda name: n(filled(F.col(name)))
    yes = lambda name: n(F.coalesce(F.col(name), F.lit(False)))
    from_source = lambda s: n(F.coalesce(F.contains(F.col("sources"), F.lit(s)), F.lit(False)))
    figures = {
        "Total Leads": F.count("*"),
        "No Website (Hot)": n(F.col("category") == "no_website"),
        "Has Website": n(F.col("category") == "has_website"),
        "With Owner Name": has("owner_name"),
        "With Owner Phone": has("owner_phone"),
        "With Owner Title": has("owner_title"),
        "With Email": has("owner_email"),
        "Verified Email": yes("email_verified"),
        "Verified Phone": yes("phone_verified"),
        "Tier: Verified": n(F.col("tier") == "verified"),
        "Tier: Corroborated": n(F.col("tier") == "corroborated"),
        "Tier: Unverified": n(F.col("tier") == "unverified"),
        "On Google Maps": yes("has_google_maps"),
        "Name On Website": yes("website_name_found"),
        "Pitch Ready": n(F.col("pitch") == "Ready"),
        "With Services": has("services"),
        "With Team Roster": has("team_members"),
        "Count Emp. Count": n(F.coalesce(F.col("employee_count") != 0, F.lit(False))),
        "Count Year Founded": n(F.coalesce(F.col("year_founded") != 0, F.lit(False))),
        "Count Partners": has("partners"),
        "From Google Maps": from_source("google_maps"),
        "From YellowPages": from_source("yellowpages"),
        "From Yelp": from_source("yelp"),
        "From Hotfrog": from_source("hotfrog"),
    }
    one = leads.agg(*(v.cast("double").alias(k.replace(".", "")) for k, v in figures.items()), F.sum(F.coalesce("lead_score", F.lit(0))).alias("_s"), F.sum(F.coalesce("conf_milli", F.lit(0))).alias("_c"))
    total = F.greatest(F.lit(1), F.col("`Total Leads`").cast("long"))
    avg = F.floor((F.coalesce("_s", F.lit(0)) * 20 + total) / (total * 2)) / 10
    conf = F.floor((F.coalesce("_c", F.lit(0)) * 2 + total * 10) / (total * 20)) / 100
    pairs = [*(f"'{k}', `{k.replace('.', '')}`" for k in figures), "'Avg Lead Score', _avg", "'Avg Confidence', _conf"]
    return one.select("*", avg.cast("double").alias("_avg"), conf.cast("double").alias("_conf")).selectExpr(f"stack({len(pairs)}, {', '.join(pairs)}) as (metric, value)")
