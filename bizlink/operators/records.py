"""Landed documents to listing rows: registry JSON, JSON-LD, panels; reviews and model replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NPI = "struct<number: string, basic: struct<organization_name: string, first_name: string, last_name: string>, addresses: array<struct<address_purpose: string, address_1: string, address_2: string, city: string, state: string, postal_code: string, telephone_number: string>>, taxonomies: array<struct<desc: string, primary: boolean>>>"
LD = "struct<name: string, telephone: string, description: string, url: string, servesCuisine: string, sameAs: array<string>, address: struct<streetAddress: string, addressLocality: string, addressRegion: string, postalCode: string>, aggregateRating: struct<ratingValue: string, reviewCount: string, ratingCount: string>>"
#: Marks of medical niches.
MEDICAL = [
    "medical", "clinic", "health", "doctor", "physician", "dentist", "dental", "hospital", "urgent care", "pediatric", "therapy", "therapist", "chiropract", "psych", "mental", "rehab", "nursing",
    "care", "surgery", "surgeon", "optometr", "optical", "dermatolog", "cardiolog", "orthoped", "pharmacy", "wellness", "diagnostic", "radiology", "veterinar", "obgyn", "gynecolog", "podiatr",
    "acupunctur", "chiropractor", "physiotherap", "imaging", "lab", "hospice", "home health", "behavioral", "counseling", "midwife", "audiolog",
]
SOCIAL_HOSTS = "facebook.com|instagram.com|twitter.com|x.com|linkedin.com|youtube.com"


def _blank_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def npi_listing(raw: DataFrame) -> DataFrame:
    """Registry JSON to listings: organisation else person name, the practice address else the
    first, the primary speciality else the first; rows without a name go."""
    doc = raw.select("*", F.from_json("json", NPI).alias("d"))
    d = F.col("d")
    name = F.coalesce(_blank_null(d["basic"]["organization_name"]), _blank_null(F.concat_ws(" ", _blank_null(d["basic"]["first_name"]), _blank_null(d["basic"]["last_name"]))))
    place = F.coalesce(F.get(F.filter(d["addresses"], lambda a: a["address_purpose"] == "LOCATION"), F.lit(0)), F.get(d["addresses"], F.lit(0)))
    kind = F.coalesce(F.get(F.filter(d["taxonomies"], lambda t: t["primary"]), F.lit(0)), F.get(d["taxonomies"], F.lit(0)))
    address = _blank_null(F.concat_ws(", ", *(_blank_null(place[p]) for p in ("address_1", "address_2", "city", "state", "postal_code"))))
    return doc.select(*raw.columns, name.alias("name"), address.alias("address"), place["telephone_number"].alias("phone"), kind["desc"].alias("category"), place["state"].alias("state"), F.lit("npi").alias("source")).where("name is not null")


def is_medical(niche: Column) -> Column:
    low = F.lower(F.coalesce(niche, F.lit("")))
    return F.exists(F.array(*(F.lit(m) for m in MEDICAL)), lambda m: F.contains(low, m))


def npi_select(listings: DataFrame, term: Column, most: int) -> DataFrame:
    """Per job: rows whose category holds the term, or all if none does; equal (name, phone)
    once; at most ``most`` by ``ord``."""
    from bizlink.functions.identity import match_digits

    hit = F.coalesce(F.contains(F.lower("category"), term), F.lit(False))
    marked = listings.withColumn("_hit", hit).withColumn("_any", F.max(F.col("_hit").cast("int")).over(Window.partitionBy("job_id")))
    kept = marked.where(F.col("_hit") | (F.col("_any") == 0))
    once = Window.partitionBy("job_id", F.lower("name"), match_digits(F.col("phone"))).orderBy("ord")
    unique = kept.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return unique.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy("ord"))).where(F.col("_n") <= most).drop("_hit", "_any", "_n")


def ld_listing(raw: DataFrame, dialect: str) -> DataFrame:
    """JSON-LD blocks to listings. The review site's url is its own page; the directory's may
    be the business's site, else the first ``sameAs`` that is no social network."""
    doc = raw.select("*", F.from_json("block", LD).alias("d")).where(F.col("d.name").isNotNull())
    d = F.col("d")
    address = _blank_null(F.concat_ws(", ", *(_blank_null(d["address"][p]) for p in ("streetAddress", "addressLocality", "addressRegion", "postalCode"))))
    count = F.coalesce(d["aggregateRating"]["reviewCount"].try_cast("int"), d["aggregateRating"]["ratingCount"].try_cast("int"), F.lit(0))
    own = F.get(F.filter(d["sameAs"], lambda u: ~u.rlike(SOCIAL_HOSTS)), F.lit(0))
    site = F.lit(None).cast("string") if dialect == "review" else F.coalesce(F.when(~d["url"].rlike("hotfrog|" + SOCIAL_HOSTS), d["url"]), own)
    return doc.select(*raw.columns, d["name"].alias("name"), address.alias("address"), d["telephone"].alias("phone"), site.alias("website"), d["servesCuisine"].alias("category"), d["aggregateRating"]["ratingValue"].try_cast("double").alias("google_rating"), count.alias("google_review_count"), d["url"].alias("source_url"))


def panel_listing(panels: DataFrame) -> DataFrame:
    """Place panels to listings: rating and count from text, coordinates from the address,
    the open flag from the hours (unknown without any)."""
    num = lambda c, p: F.regexp_extract(c, p, 1).try_cast("double")
    u = F.col("url")
    pair = lambda i: F.coalesce(F.regexp_extract(u, r"@(-?\d+\.\d+),(-?\d+\.\d+)", i).try_cast("double"), F.regexp_extract(u, r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)", i).try_cast("double"))
    name = F.when(F.lower(F.trim("name")).isin("results", "sponsored", "ad", ""), F.col("fallback_name")).otherwise(F.col("name"))
    return panels.select(
        "panel_id", name.alias("name"), num(F.replace("rating_text", F.lit(","), F.lit(".")), r"(\d+\.\d+|\d+)").alias("google_rating"),
        F.coalesce(F.replace(F.regexp_extract("rating_text", r"\(([\d,]+)\)", 1), F.lit(","), F.lit("")).try_cast("int"), F.lit(0)).alias("google_review_count"),
        F.when(F.col("hours") != "", ~F.contains(F.lower("hours"), F.lit("closed"))).alias("google_is_open"), pair(1).alias("latitude"), pair(2).alias("longitude"),
    )


def stars_of(label: Column) -> Column:
    """1 to 5 from a label such as "Rated 2.0 out of 5"; halves to the even number."""
    value = F.regexp_extract(label, r"(?i)([0-5](?:\.\d)?)\s*(?:star|out of)", 1).try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.bround(value, 0).cast("int"))))


def review_weaknesses(reviews: Column, histogram: Column, responds: Column) -> tuple[Column, Column]:
    """Text and count from evidence: low reviews (at most 3), a low share of a fifth or more
    (2), an owner who doesn't answer them (1)."""
    low = F.size(F.filter(reviews, lambda r: r["stars"] <= 2))
    bad = F.coalesce(F.try_element_at(histogram, F.lit("1")), F.lit(0)) + F.coalesce(F.try_element_at(histogram, F.lit("2")), F.lit(0))
    total = F.aggregate(F.map_values(histogram), F.lit(0), lambda a, x: a + x)
    share = F.coalesce((total > 0) & (bad * 5 >= total), F.lit(False))
    silent = F.coalesce(~responds, F.lit(False)) & (low > 0)
    pct = F.floor((bad * 200 + total) / (total * 2)).cast("string")
    text = F.concat_ws(", ", F.when(low > 0, F.concat(low.cast("string"), F.lit(" recent 1-2★ review(s) with complaint text"))), F.when(share, F.concat(pct, F.lit("% of reviews are 1-2★"))), F.when(silent, "Owner does not reply to negative reviews (reputation-management gap)"))
    count = F.least(F.lit(3), F.greatest(F.lit(0), low)) + F.when(share, 2).otherwise(0) + F.when(silent, 1).otherwise(0)
    return F.when(text != "", text), count


def worst_first(reviews: Column, most: int = 10) -> Column:
    """Texts of the reviews, lowest stars first, no stars as five, ties in given order."""
    order = F.array_sort(F.transform(F.filter(reviews, lambda r: F.coalesce(r["text"] != "", F.lit(False))), lambda r: F.struct(F.coalesce(r["stars"], F.lit(5)).alias("s"), r["pos"].alias("p"), r["text"].alias("t"))))
    return F.transform(F.slice(order, 1, most), lambda r: r["t"])


def review_lists(rows: DataFrame) -> DataFrame:
    """One array of reviews and one histogram per lead from a row per review."""
    one = F.array_sort(F.collect_list(F.struct("pos", "stars", "text")))
    bins = F.map_from_arrays(F.array(*(F.lit(str(k)) for k in range(1, 6))), F.array(*(F.count_if(F.col("stars") == k).cast("int") for k in range(1, 6))))
    return rows.groupBy("lead_id").agg(one.alias("reviews"), bins.alias("histogram"))


def reviews_unavailable(panel: Column) -> Column:
    """A place's header without a number of reviews, or no header: reviews were held back, which
    isn't the same as none."""
    return ~F.coalesce(panel.rlike(r"\(\s*[\d,]+\s*\)"), F.lit(False))


def review_snippets(reviews: Column, most: int = 6) -> Column:
    """The worst reviews with a text in one line, 160 characters of each; empty if there are none."""
    told = F.filter(reviews, lambda r: F.coalesce(r["text"] != "", F.lit(False)))
    order = F.array_sort(F.transform(told, lambda r: F.struct(F.coalesce(r["stars"], F.lit(5)).alias("s"), r["pos"].alias("p"), r["stars"].alias("n"), r["text"].alias("t"))))
    return F.array_join(F.transform(F.slice(order, 1, most), lambda r: F.concat(F.coalesce(r["n"].cast("string"), F.lit("?")), F.lit("★: "), F.substring(r["t"], 1, 160))), " | ")


def degraded_jobs(flags: DataFrame) -> DataFrame:
    """Jobs of which half the leads or more came back without their reviews."""
    return flags.groupBy("job_id").agg(F.count_if("unavailable").alias("degraded"), F.count("*").alias("n")).where("degraded * 2 >= n")


def apply_reviews(leads: DataFrame, found: DataFrame) -> DataFrame:
    """New weaknesses where there are some; text and count change together."""
    new = found.select("lead_id", F.col("weaknesses").alias("_w"), F.col("weakness_count").alias("_c"))
    take = F.coalesce(F.col("_w") != "", F.lit(False))
    return leads.join(new, "lead_id", "left").withColumn("weaknesses", F.when(take, F.col("_w")).otherwise(F.col("weaknesses"))).withColumn("weakness_count", F.when(take, F.col("_c")).otherwise(F.col("weakness_count"))).drop("_w", "_c")


def rule_weaknesses(year: int) -> tuple[Column, Column]:
    """Text and count from a lead's stored signals."""
    c = F.col
    reviews, rating = F.coalesce("google_review_count", F.lit(0)), c("google_rating")
    age = F.lit(year) - c("year_founded")
    tenths = F.when((reviews > 0) & (c("year_founded") > 0), F.floor((reviews * 20 + F.greatest(F.lit(1), age)) / (F.greatest(F.lit(1), age) * 2)))
    slow = F.coalesce((tenths < 50) & (age >= 3), F.lit(False))
    many = F.coalesce((reviews > 50) & (rating > 0) & (rating < 3.5), F.lit(False))
    from bizlink.functions.identity import filled

    mail, phone, site = filled(c("owner_email")), filled(c("phone")), filled(c("website"))
    rules = [
        (slow, F.concat(F.lit("Low review velocity (~"), F.format_string("%.1f", tenths / 10), F.lit("/yr for time in business)")), 1),
        (F.coalesce(rating < 2.0, F.lit(False)), F.lit("Very poor reputation (rating < 2.0)"), 3),
        (F.coalesce((rating >= 2.0) & (rating < 3.0), F.lit(False)), F.lit("Poor reputation (rating < 3.0)"), 2),
        (F.coalesce((rating >= 3.0) & (rating < 3.5), F.lit(False)), F.lit("Mixed reviews (rating < 3.5)"), 1),
        (F.coalesce((rating >= 3.5) & (rating < 4.0), F.lit(False)), F.lit("Below-average rating (< 4.0)"), 1),
        (many, F.lit("Systemic complaints (many reviews, low rating)"), 2),
        (~site, F.lit("No website presence"), 1),
        (site & F.coalesce(c("website_status") == "dead", F.lit(False)), F.lit("Website offline"), 1),
        (~mail, F.lit("No email address available"), 1),
        (~mail & ~phone, F.lit("No contact method available"), 1),
        (~F.coalesce("has_google_maps", F.lit(False)), F.lit("No Google Maps presence"), 1),
    ]
    text = F.concat_ws(", ", *(F.when(cond, t) for cond, t, _ in rules))
    return F.when(text != "", text), sum((F.when(cond, n).otherwise(0) for cond, _, n in rules), F.lit(0))


def clean_text(text: Column) -> Column:
    """One model-written string without mark-up and stray white space, null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\*\*|__|`", ""), r"(?m)^\s*#{1,6}\s+", "")
    out = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ \-–—:;]+|[ \-–—:;]+$", "")
    return F.when(out != "", out)


def has_placeholder(text: Column) -> Column:
    """A slot that was left for a human to fill."""
    words = "assumed|insert|placeholder|tbd|todo|fill in|name|city|company|business|owner|contact|email|phone|location|first|last|title|address|website|competitor|industry|service|client"
    return F.coalesce(text.rlike(rf"\[[^\]]*\b(?i:{words})\w*[^\]]*\]|\[[A-Z][A-Z_ ]{{2,}}[^\]]*\]|\{{\{{[^}}]*\}}\}}"), F.lit(False))


def repair_json(raw: str | None) -> str | None:
    """A JSON object out of fences or prose, closed where it was cut off; null if hopeless."""
    text = (raw or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text, re.S)
    text = fenced.group(1) if fenced else text
    start = text.find("{")
    if start < 0:
        return None
    decoder = json.JSONDecoder()
    try:
        return json.dumps(decoder.raw_decode(text, start)[0])
    except ValueError:
        pass
    closers, quoted, skip = [], False, False
    for ch in text[start:]:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            closers.append({"{": "}", "[": "]"}[ch])
        elif ch in "}]" and closers:
            closers.pop()
    body = text[start:] + '"' * quoted
    body = re.sub(r'(,\s*)?"[^"]*"\s*:\s*$', "", body.rstrip()).rstrip().rstrip(",")
    try:
        return json.dumps(json.loads(body + "".join(reversed(closers))))
    except ValueError:
        return None


def parse_replies(replies: DataFrame) -> DataFrame:
    """Add ``json``: well-formed replies natively, only the others through the repair."""

    @F.pandas_udf("string")
    def repaired(raw: pd.Series) -> pd.Series:
        return raw.map(repair_json)

    good = F.try_parse_json("raw").isNotNull() & F.col("raw").rlike(r"^\s*\{")
    return replies.where(good).withColumn("json", F.col("raw")).unionByName(replies.where(~F.coalesce(good, F.lit(False))).withColumn("json", repaired("raw")))


def sane_facts(json_: Column) -> dict[str, Column]:
    """Typed facts of a reply, null where absent, void or out of range."""
    from bizlink.functions.contact import plausible_person

    void = ["null", "none", "n/a", "unknown"]
    text = lambda k: F.when(~F.lower(clean_text(F.get_json_object(json_, f"$.{k}"))).isin(void), clean_text(F.get_json_object(json_, f"$.{k}")))
    number = lambda k, lo, hi: F.when(F.get_json_object(json_, f"$.{k}").try_cast("int").between(lo, hi), F.get_json_object(json_, f"$.{k}").try_cast("int"))
    person = text("owner_name")
    return {"services": text("services"), "owner_name": F.when(plausible_person(person), person), "owner_title": text("owner_title"), "employee_count": number("employee_count", 1, 50000), "year_founded": number("year_founded", 1701, 2100)}


def fill_gaps(leads: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Take a fact only where the lead has none."""
    new = facts.select("lead_id", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = leads.join(new, "lead_id", "left")
    return joined.select(*(F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_{c}")).alias(c) if c in columns else c for c in leads.columns))


def merge_partial(old: Column, new: Column, rejected: Column) -> Column:
    """New value if there is one, nothing if it was rejected, else the old one."""
    return F.when(new.isNotNull(), new).when(F.coalesce(rejected, F.lit(False)), F.lit(None)).otherwise(old)
