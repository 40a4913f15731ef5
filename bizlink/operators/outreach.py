"""Attempt log: latest disposition, queue, funnel, follow-ups; and what was delivered before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlink.functions.identity import filled, name_key, phone_key
from bizlink.operators.select import first_by

#: Days until the next try by disposition, the default, and what closes a business.
RETRY_DAYS = {"no_answer": 2, "gatekeeper": 3, "spoke_owner": 7, "interested": 2, "not_interested": 90, "queued": 0}
DEFAULT_RETRY_DAYS = 7
CLOSED = ["booked", "do_not_contact", "bad_number"]
KEYS = ["phone7", "name_norm"]


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The last attempt of each (phone7, name_norm), null keys alike: one aggregate on the
    keys that combines before the shuffle, where a window would sort every attempt."""
    rest = [c for c in attempts.columns if c not in KEYS]
    last = F.max(F.struct("attempted_at", "attempt_id", *(c for c in rest if c not in ("attempted_at", "attempt_id"))))
    return attempts.groupBy(*KEYS).agg(last.alias("l")).select(*KEYS, *(F.col("l")[c].alias(c) for c in rest))


def retry_days(disposition: Column) -> Column:
    out = F.lit(DEFAULT_RETRY_DAYS)
    for k, v in RETRY_DAYS.items():
        out = F.when(disposition == k, v).otherwise(out)
    return out


def next_action(disposition: Column, attempted_at: Column) -> Column:
    """When to try again; null for closed dispositions and for zero days (due at once)."""
    days = retry_days(disposition)
    return F.when(~disposition.isin(CLOSED) & (days > 0), attempted_at + F.make_dt_interval(days))


def funnel(attempts: DataFrame) -> DataFrame:
    """One row: attempts, businesses, booked, interested, conversion in percent (one place)."""
    kinds = lambda d: F.count_if(F.col("l.disposition") == d)
    per = attempts.groupBy(*KEYS).agg(F.max(F.struct("attempted_at", "attempt_id", "disposition")).alias("l"), F.count("*").alias("n"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"), F.count("*").alias("contacted"), kinds("booked").alias("booked"), kinds("interested").alias("interested"))
    tenths = F.floor((F.col("booked") * 2000 + F.col("contacted")) / (F.col("contacted") * 2))
    return one.withColumn("conversion_pct", F.when(F.col("contacted") > 0, tenths / 10).otherwise(0.0))


def by_disposition(attempts: DataFrame) -> DataFrame:
    return latest_attempts(attempts).groupBy("disposition").agg(F.count("*").alias("n"))


def with_keys(leads: DataFrame) -> DataFrame:
    return leads.withColumn("phone7", phone_key(F.col("phone"))).withColumn("name_norm", name_key(F.col("name")))


def call_queue(leads: DataFrame, attempts: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Verified-phone leads worth a call at ``as_of``: not closed, due, one row per business,
    best score first."""
    last = latest_attempts(attempts).select(*(F.col(k).alias(f"_{k}") for k in KEYS), "disposition", next_action(F.col("disposition"), F.col("attempted_at")).alias("next_action_at"))
    able = with_keys(leads.where(F.coalesce("phone_verified", F.lit(False))))
    both = able.join(last, able["phone7"].eqNullSafe(last["_phone7"]) & able["name_norm"].eqNullSafe(last["_name_norm"]), "left")
    open_ = ~F.coalesce(F.col("disposition").isin(CLOSED), F.lit(False)) & F.coalesce(F.col("next_action_at") <= as_of, F.lit(True))
    order = [F.col("lead_score").desc(), F.col("lead_id")]
    out = first_by(both.where(open_), KEYS, order).drop("_phone7", "_name_norm")
    return out if limit is None else out.orderBy(*order).limit(limit)


def suppress_delivered(leads: DataFrame, delivered: DataFrame, match_on: tuple[str, ...] = ("phone", "name")) -> DataFrame:
    """Rows whose phone key or name key was not delivered before: one anti join per key, on
    distinct keys, nulls never matching; Spark broadcasts a key set only if it is small."""
    out = with_keys(leads)
    for kind, key in (("phone", "phone7"), ("name", "name_norm")):
        if kind in match_on:
            out = out.join(delivered.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return out


def delivered_keys(leads: DataFrame, ledger: DataFrame, verified: Column) -> DataFrame:
    """Key sets of verified leads and the durable ledger together."""
    return with_keys(leads.where(verified)).select(*KEYS).unionByName(ledger.select(*KEYS)).distinct()


def new_deliveries(leads: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows to append: the first of each (phone7, name_norm) that the ledger lacks;
    rows with neither key are skipped."""
    keyed = with_keys(leads).where(F.col("phone7").isNotNull() | F.col("name_norm").isNotNull())
    first = first_by(keyed, KEYS, [F.col("ord"), F.col("lead_id")])
    had = ledger.select(*(F.col(k).alias(f"_{k}") for k in KEYS)).distinct()
    return first.join(had, first["phone7"].eqNullSafe(had["_phone7"]) & first["name_norm"].eqNullSafe(had["_name_norm"]), "left_anti")


def hooks() -> Column:
    """Up to three stored facts to open a call with, strongest first."""
    rating, reviews = F.col("google_rating"), F.coalesce("google_review_count", F.lit(0))
    web = F.when(~filled(F.col("website")), "they have no website at all").when(F.col("website_status") == "dead", "their website is down").when(~F.coalesce("has_ssl", F.lit(False)), "their site has no SSL padlock — browsers flag it")
    shown = F.format_string("%.1f", rating)
    maps = F.when((rating > 0) & (reviews > 0), F.when((rating >= 4.5) & (reviews < 25), F.concat(F.lit("a "), shown, F.lit(" rating but only "), reviews.cast("string"), F.lit(" reviews — great service, invisible"))).when(rating < 4.0, F.concat(F.lit("a "), shown, F.lit(" rating from "), reviews.cast("string"), F.lit(" reviews"))).otherwise(F.concat(reviews.cast("string"), F.lit(" reviews at "), shown)))
    relies = F.when(filled(F.col("external_platforms")), F.concat(F.lit("they rely on "), F.col("external_platforms"), F.lit(" and pay commission")))
    blind = F.when(~filled(F.col("marketing_stack")), "no tracking on their site, so they can't see where leads come from")
    return F.slice(F.array_compact(F.array(web, maps, relies, blind)), 1, 3)


def greeting_ok(text: Column, owner: Column, name: Column) -> Column:
    """Whether a greeted first name is known from the owner's or the business's name."""
    greeted = F.lower(F.regexp_extract(text, r"^\s*(?:[Hh]i|[Hh]ello|[Hh]ey|[Gg]ood\s+\w+)[\s,]+([A-Z][a-z]+)\b", 1))
    known = F.lower(F.concat_ws(" ", owner, name))
    return text.isNull() | (greeted == "") | F.contains(known, greeted)


def scrub_greeting(text: Column, owner: Column, name: Column) -> Column:
    """The text without a greeting to an unknown name, capitalised; null if nothing is left."""
    rest = F.regexp_replace(F.regexp_replace(text, r"^\s*(?:[Hh]i|[Hh]ello|[Hh]ey|[Gg]ood\s+\w+)[\s,]+([A-Z][a-z]+)\b", ""), "^[ ,—-]+", "")
    cut = F.when(rest != "", F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 20)))
    return F.when(greeting_ok(text, owner, name), text).otherwise(cut)


def call_script(leads: DataFrame) -> DataFrame:
    """Script columns for the queue: whom to ask for, the opener, up to three facts."""
    biz = F.when(filled(F.col("name")), F.col("name")).otherwise("the business")
    facts = hooks()
    ask = F.when(filled(F.col("owner_name")), F.concat(F.lit("Could I grab "), "owner_name", F.lit(" for two minutes?"))).otherwise("Is the owner around, or whoever looks after your marketing?")
    with_facts = leads.withColumn("facts", facts)
    opener = F.concat(F.lit("I had a look at "), biz, F.lit(" before calling"), F.when(F.size("facts") > 0, F.concat(F.lit(" — "), F.get("facts", F.lit(0)), F.lit("."))).otherwise("."))
    return with_facts.select("lead_id", biz.alias("business"), F.concat(F.lit("Hi, this is <you> calling for "), biz, F.lit(". "), ask).alias("gatekeeper"), opener.alias("opener"), F.array_join("facts", "; ").alias("facts"), F.col("owner_email").alias("email_followup"))
