"""Scores, gates and labels of a lead. Points and thousandths are integers throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizlink.functions.identity import filled

VERIFY_MIN_SCORE = 40
MIN_CONFIDENCE_MILLI = 600
#: Local parts of shared mailboxes and domains of free mail.
ROLE_LOCALS = ["info", "contact", "support", "admin", "hello", "sales", "office", "team", "mail", "enquiries", "booking"]
FREE_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "mail.com", "protonmail.com", "proton.me", "zoho.com"]
c = F.col


def _points(cond: Column, n: int) -> Column:
    return F.when(cond, n).otherwise(0)


def _true(name: str) -> Column:
    return F.coalesce(c(name), F.lit(False))


def email_points() -> Column:
    local = F.lower(F.element_at(F.split(c("owner_email"), "@"), 1))
    domain = F.lower(F.coalesce(F.get(F.split(c("owner_email"), "@"), F.lit(1)), F.lit("")))
    on_site = F.coalesce(F.contains(F.lower(c("website")), domain) & filled(c("website")), F.lit(False))
    personal = local.rlike("^[a-z][a-z.]+[a-z]$") & (F.length(local) >= 4)
    role, free = local.isin(ROLE_LOCALS), domain.isin(FREE_DOMAINS)
    tier = F.when(personal & on_site, 30).when(personal, 20).when(~role & on_site, 20).when(role & on_site, 10).when(~free, 10).otherwise(5)
    return F.when(filled(c("owner_email")), tier).otherwise(0)


def score_parts() -> dict[str, Column]:
    """Points by part of the rubric, from a lead joined with its e-mail and phone verdicts."""
    has_mail, has_site = filled(c("owner_email")), filled(c("website"))
    mx = _true("mx_valid")
    verdict = _points(mx, 4) + F.when(_true("deliverable"), 4).when(_true("smtp_valid"), 2).otherwise(0) + _points(~_true("is_role") & mx, 2)
    phone = F.when(_true("phone_verified") & filled(c("phone")), 10 + _points(c("phone_type").isin("mobile", "voip", "toll_free"), 2)).otherwise(0)
    site = F.when(~has_site, 0).when(c("website_status") == "active", 15).when(c("website_status") == "none", 0).otherwise(5)
    rating = F.coalesce(c("google_rating"), F.lit(0.0))
    maps = F.when(_true("has_google_maps"), 5 + F.when(rating >= 4.0, 10).when(rating >= 3.0, 5).otherwise(0)).otherwise(0)
    social = F.least(F.lit(10), sum((_points(filled(c(f"social_{s}")), 5) for s in ("facebook", "instagram", "twitter")), F.lit(0)))
    line = F.when(filled(c("owner_phone")), 5).when(F.coalesce(c("google_review_count") > 50, F.lit(False)), 5).otherwise(0)
    staff = F.coalesce(c("employee_count"), F.lit(0))
    partners = F.when(filled(c("partners")), F.size(F.split(c("partners"), ","))).otherwise(0)
    return {
        "email": email_points(),
        "email_verify": F.when(has_mail, verdict).otherwise(0),
        "phone": phone,
        "website": site + _points(filled(c("website_cms")), 5) + _points(_true("has_ssl"), 5),
        "maps": maps,
        "social": social,
        "bonus": _points(filled(c("owner_name")), 5) + line + _points(_true("google_is_open"), 5),
        "intel": F.when(staff > 50, 5).when(staff > 10, 3).when(staff > 0, 1).otherwise(0) + _points(F.coalesce(c("year_founded") > 1900, F.lit(False)), 3) + F.when(partners >= 3, 2).when(partners >= 1, 1).otherwise(0),
        "research": _points(filled(c("services")), 2) + _points(filled(c("team_members")), 3) + _points(filled(c("owner_title")), 2),
        "penalty": -F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(c("review_weakness_count"), F.lit(0)))),
    }


def lead_score() -> Column:
    """Sum of the parts, at most 100; there is no floor."""
    return F.least(F.lit(100), sum(score_parts().values(), F.lit(0))).cast("int")


def n_sources() -> Column:
    return F.when(filled(c("sources")), F.size(F.split(c("sources"), ","))).otherwise(0)


def confidence_milli() -> Column:
    """Trust in a lead in thousandths, at most 1000. ``owner_phone_tenths`` is that phone's own trust."""
    parts = [
        F.when(_true("phone_verified"), 200).when(filled(c("phone")), 50).otherwise(0),
        F.when(_true("email_verified"), 200).when(filled(c("owner_email")), 50).otherwise(0),
        _points(F.coalesce(c("website_status") == "active", F.lit(False)), 150),
        _points(_true("website_name_found"), 80),
        _points(_true("has_google_maps"), 150),
        _points(filled(c("owner_name")), 100),
        F.when(filled(c("owner_phone")), 10 * F.coalesce(c("owner_phone_tenths"), F.lit(0))).otherwise(0),
        *(_points(F.coalesce(c(n) != 0, F.lit(False)), 50) for n in ("employee_count", "year_founded")),
        *(_points(filled(c(n)), p) for n, p in (("partners", 50), ("services", 50), ("team_members", 80), ("owner_title", 50))),
        _points(n_sources() >= 2, 100) + _points(n_sources() >= 3, 50),
        _points(F.coalesce(c("phone_source_count") >= 2, F.lit(False)), 50),
        _points(_true("address_valid"), 50),
    ]
    return F.least(F.lit(1000), sum(parts, F.lit(0))).cast("int")


def confidence() -> Column:
    """Thousandths as a number with two places, halves up."""
    return F.floor((confidence_milli() + 5) / 10) / 100


def is_verified(score: str = "lead_score") -> Column:
    rich = F.coalesce(c(score), F.lit(0)) >= VERIFY_MIN_SCORE
    return rich | (_true("phone_verified") & (_true("has_google_maps") | F.coalesce(F.contains(c("sources"), F.lit("npi")), F.lit(False))))


def is_contactable() -> Column:
    return filled(c("phone")) | filled(c("owner_email")) | filled(c("website"))


def is_accurate(milli: str = "conf_milli") -> Column:
    channel = _true("phone_verified") | _true("email_verified") | (_true("has_google_maps") & (n_sources() >= 2))
    return (F.coalesce(c(milli), F.lit(0)) >= MIN_CONFIDENCE_MILLI) & channel


def needs_maps() -> Column:
    return filled(c("name")) & ~_true("has_google_maps") & ~(filled(c("phone")) & F.coalesce(F.contains(c("sources"), F.lit("npi")), F.lit(False)))


def pitch_tier(score: str = "lead_score") -> Column:
    contact = filled(c("owner_email")) | filled(c("owner_phone")) | filled(c("phone"))
    site = _true("website_name_found") | _true("has_google_maps")
    ready = contact & site & filled(c("owner_name")) & (F.coalesce(c(score), F.lit(0)) >= 40)
    return F.when(ready, "Ready").when(contact & site, "Needs Owner").when(contact, "Needs Site").otherwise("Needs Contact")


def score_band(score: str = "lead_score") -> Column:
    return F.when(c(score) >= 70, "HIGH").when(c(score) >= 40, "MED").otherwise("LOW")


def category() -> Column:
    return F.when(filled(c("website")) & (c("website_status") == "active"), "has_website").otherwise("no_website")


def verification_tier() -> Column:
    return F.when(_true("phone_verified") | _true("email_verified"), "verified").when(_true("has_google_maps") & (n_sources() >= 2), "corroborated").otherwise("unverified")


def review_velocity(reviews: Column, founded: Column, year: int) -> Column:
    """Reviews a year since founding in tenths rounded half up, null without both."""
    years = F.greatest(F.lit(1), F.lit(year) - founded)
    return F.when((reviews > 0) & (founded > 0), F.floor((reviews * 20 + years) / (years * 2)) / 10)


def registry_gate(milli: Column, tier: Column, status: Column) -> tuple[Column, Column]:
    """Confidence and tier after the registry: dissolved cuts to three tenths, active adds a tenth."""
    cut = F.floor(milli * 3 / 10).cast("int")
    new = F.when(status == "dissolved", cut).when(status == "active", F.least(F.lit(1000), milli + 100)).otherwise(milli)
    return new, F.when(status == "dissolved", "unverified").otherwise(tier)
