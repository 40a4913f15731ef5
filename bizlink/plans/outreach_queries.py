"""Queries over merged listings, the attempt log and the delivery ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlink.functions import scoring as S
from bizlink.operators import golden, outreach
from bizlink.operators.select import first_by
from bizlink.plans.lead_queries import _VERIFIED, SCORED, scored
from bizlink.plans.registry import query
from bizlink.plans.views import view

FIELDS = ["name", "phone", "address", "website", "google_rating", "description"]
_RANK = lambda order: "coalesce(list_position([" + ", ".join(f"'{s}'" for s in order) + f"], source) - 1, {len(order)})"
_FIRST = lambda f, order, zero: f"arg_min({f}, {_RANK(order)} * 100 + ord) FILTER ({f} IS NOT NULL AND {f} <> {zero})"
_DEFAULT = golden.PRIORITY["default"]
_D7 = lambda c: f"CASE WHEN regexp_replace(coalesce({c}, ''), '\\D', '', 'g') = '' THEN NULL ELSE right(regexp_replace({c}, '\\D', '', 'g'), 7) END"
#: The ordered description rule for at most three sources, one row each, arriving by rank 1, 2, 3.
_GOLDEN = f"""SELECT cluster, {_FIRST('name', _DEFAULT, "''")} AS name, {_FIRST('phone', golden.PRIORITY['phone'], "''")} AS phone, {_FIRST('address', _DEFAULT, "''")} AS address, {_FIRST('website', _DEFAULT, "''")} AS website,
 {_FIRST('google_rating', golden.PRIORITY['google_rating'], '0')} AS google_rating,
 list_reduce(list_prepend(CAST(NULL AS VARCHAR), list(description ORDER BY ord) FILTER (description IS NOT NULL AND description <> '')), lambda a, b: CASE WHEN a IS NULL OR length(b) > length(a) THEN b ELSE a END) AS description,
 string_agg(source, ',' ORDER BY ord) AS sources_str, list(struct_pack(s := source, d := {_D7('phone')})) AS ph FROM v_listings GROUP BY cluster"""


@query(f"SELECT cluster, name, phone, address, website, google_rating, description, sources_str, CASE WHEN {_D7('phone')} IS NULL THEN 0 ELSE len(list_filter(ph, lambda x: x.d = {_D7('phone')})) END AS phone_source_count FROM ({_GOLDEN})")
def a1_a3_golden_record(spark, sf_dir):
    return golden.golden_record(view(spark, sf_dir, "listings"), FIELDS)


@query(f"SELECT cluster, arg_min(name, ord) FILTER (name <> '') AS name, arg_min(phone, ord) FILTER (phone <> '') AS phone, arg_min(website, ord) FILTER (website <> '') AS website, arg_min(description, -length(description) * 100 + ord) FILTER (description <> '') AS description, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources_str, CAST(max(ord) AS INT) AS phone_source_count FROM v_listings GROUP BY cluster")
def j3_pool_merge(spark, sf_dir):
    pool = view(spark, sf_dir, "listings").withColumnRenamed("source", "sources").withColumn("phone_source_count", F.col("ord").cast("int"))
    return golden.merge_pool(pool, ["name", "phone", "website", "description"])


@query("SELECT source, count(*) AS n FROM v_listings WHERE source IN ('google_maps', 'npi') GROUP BY source")
def s1_gather_sources(spark, sf_dir):
    from bizlink.sources.listings import Registry

    one = view(spark, sf_dir, "listings")
    loaders = {s: (lambda s=s: one.where(F.col("source") == s)) for s in ("google_maps", "hotfrog", "npi")}
    return Registry(loaders, enabled=["google_maps", "hotfrog", "npi"]).gather(spark, only=["google_maps", "npi"]).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT source, cluster, name FROM (SELECT source, cluster, name, row_number() OVER (PARTITION BY source, lower(name) ORDER BY cluster) AS rn FROM (SELECT source, cluster, concat(substring(name, 1, 4), CAST(cluster % 400 AS STRING)) AS name FROM v_listings)) WHERE rn = 1")
def s8_crawl_dedup(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").select("source", "cluster", F.concat(F.substring("name", 1, 4), (F.col("cluster") % 400).cast("string")).alias("name"))
    return first_by(rows.withColumn("k", F.lower("name")), ["source", "k"], [F.col("cluster")]).select("source", "cluster", "name")


@query("SELECT phone7, name_norm, attempt_id, disposition FROM (SELECT *, row_number() OVER (PARTITION BY phone7, name_norm ORDER BY attempted_at DESC, attempt_id DESC) AS rn FROM v_outreach) WHERE rn = 1")
def w1_latest_attempt(spark, sf_dir):
    return outreach.latest_attempts(view(spark, sf_dir, "outreach")).select("phone7", "name_norm", "attempt_id", "disposition")


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phone7, name_norm ORDER BY attempted_at DESC, attempt_id DESC) AS rn FROM v_outreach) WHERE rn = 1)"


FUNNEL = f"SELECT (SELECT count(*) FROM v_outreach) AS attempts, count(*) AS contacted, count(*) FILTER (disposition = 'booked') AS booked, count(*) FILTER (disposition = 'interested') AS interested, floor((count(*) FILTER (disposition = 'booked') * 2000 + count(*)) / (count(*) * 2)) / 10 AS conversion_pct FROM {_LATEST}"


@query(FUNNEL)
def a6_funnel(spark, sf_dir):
    return outreach.funnel(view(spark, sf_dir, "outreach")).withColumn("conversion_pct", F.col("conversion_pct").cast("double"))


@query(f"SELECT disposition, count(*) AS n FROM {_LATEST} GROUP BY disposition")
def a6_by_disposition(spark, sf_dir):
    return outreach.by_disposition(view(spark, sf_dir, "outreach"))


_DAYS = "CASE disposition WHEN 'no_answer' THEN 2 WHEN 'gatekeeper' THEN 3 WHEN 'spoke_owner' THEN 7 WHEN 'interested' THEN 2 WHEN 'not_interested' THEN 90 WHEN 'queued' THEN 0 ELSE 7 END"
_NEXT = f"CASE WHEN disposition IN ('booked', 'do_not_contact', 'bad_number') THEN NULL ELSE attempted_at + to_days({_DAYS}) END"


@query(f"SELECT attempt_id, {_NEXT} AS next_action_at FROM v_outreach")
def c7_follow_up(spark, sf_dir):
    return view(spark, sf_dir, "outreach").select("attempt_id", outreach.next_action(F.col("disposition"), F.col("attempted_at")).alias("next_action_at"))


_NAME = "regexp_replace(regexp_replace(lower(name), '\\b(the|inc|llc|ltd|co|company|corp|plc|group)\\b', '', 'g'), '[^a-z0-9]', '', 'g')"
_KEYED = f"(SELECT *, CASE WHEN length(regexp_replace(coalesce(phone, ''), '\\D', '', 'g')) >= 7 THEN right(regexp_replace(phone, '\\D', '', 'g'), 7) END AS phone7, nullif({_NAME}, '') AS name_norm FROM {SCORED})"
#: Attempts on the leads' own keys, so that the queue meets them.
_TRIED = "(SELECT event_id AS attempt_id, concat('555', substring(CAST(10000 + user_id % 10000 AS STRING), 2, 4)) AS phone7, concat('smithsons', CAST(user_id AS STRING)) AS name_norm, disposition, attempted_at FROM (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'no_answer' WHEN 'click' THEN 'gatekeeper' WHEN 'signup' THEN 'interested' WHEN 'purchase' THEN 'booked' ELSE 'bad_number' END AS disposition, CAST(ts AS TIMESTAMP) AS attempted_at FROM {events}))"
_AS_OF = "2024-01-15 00:00:00"


@query(f"""SELECT lead_id, lead_score FROM (SELECT l.lead_id, l.lead_score, row_number() OVER (PARTITION BY l.phone7, l.name_norm ORDER BY lead_score DESC, l.lead_id) AS rn FROM {_KEYED} l
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phone7, name_norm ORDER BY attempted_at DESC, attempt_id DESC) AS rn FROM {_TRIED.format(events='events')}) WHERE rn = 1) a
 ON l.phone7 IS NOT DISTINCT FROM a.phone7 AND l.name_norm IS NOT DISTINCT FROM a.name_norm
 WHERE l.phone_verified AND coalesce(a.disposition NOT IN ('booked', 'do_not_contact', 'bad_number'), true) AND coalesce({_NEXT.replace('disposition', 'a.disposition').replace('attempted_at', 'a.attempted_at')} <= TIMESTAMP '{_AS_OF}', true)) WHERE rn = 1""")
def j14_call_queue(spark, sf_dir):
    tried = spark.sql(f"SELECT * FROM {_TRIED}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return outreach.call_queue(scored(spark, sf_dir), tried, F.lit(_AS_OF).cast("timestamp")).select("lead_id", "lead_score")


@query(f"SELECT lead_id FROM {_KEYED} WHERE (phone7 IS NULL OR phone7 NOT IN (SELECT phone7 FROM v_ledger)) AND (name_norm IS NULL OR name_norm NOT IN (SELECT name_norm FROM v_ledger))")
def j4_suppression(spark, sf_dir):
    return outreach.suppress_delivered(scored(spark, sf_dir), view(spark, sf_dir, "ledger")).select("lead_id")


@query(f"SELECT phone7, name_norm FROM {_KEYED} WHERE {_VERIFIED} UNION SELECT phone7, name_norm FROM v_ledger")
def u1_delivered_keys(spark, sf_dir):
    return outreach.delivered_keys(scored(spark, sf_dir), view(spark, sf_dir, "ledger"), S.is_verified())


@query(f"SELECT phone7, name_norm, lead_id FROM (SELECT *, row_number() OVER (PARTITION BY phone7, name_norm ORDER BY ord, lead_id) AS rn FROM {_KEYED} WHERE phone7 IS NOT NULL OR name_norm IS NOT NULL) l WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM v_ledger g WHERE g.phone7 IS NOT DISTINCT FROM l.phone7 AND g.name_norm IS NOT DISTINCT FROM l.name_norm)")
def s15_new_deliveries(spark, sf_dir):
    return outreach.new_deliveries(scored(spark, sf_dir), view(spark, sf_dir, "ledger")).select("phone7", "name_norm", "lead_id")


@query("SELECT source, cluster, sources_str FROM (SELECT source, cluster, array_to_string(list_sort(list_distinct([source, 'npi', 'yelp'])), ',') AS sources_str FROM v_listings)")
def u3_provenance_union(spark, sf_dir):
    both = F.array_sort(F.array_union(F.array("source"), F.array(F.lit("npi"), F.lit("yelp"))))
    return view(spark, sf_dir, "listings").select("source", "cluster", F.array_join(both, ",").alias("sources_str"))


_W = "CASE WHEN website IS NULL THEN 'they have no website at all' WHEN coalesce(website_status = 'dead', false) THEN 'their website is down' WHEN NOT has_ssl THEN 'their site has no SSL padlock — browsers flag it' END"
_M = "CASE WHEN google_rating > 0 AND google_review_count > 0 THEN CASE WHEN google_rating >= 4.5 AND google_review_count < 25 THEN printf('a %.1f rating but only %d reviews — great service, invisible', google_rating, google_review_count) WHEN google_rating < 4 THEN printf('a %.1f rating from %d reviews', google_rating, google_review_count) ELSE printf('%d reviews at %.1f', google_review_count, google_rating) END END"
_FACTS = f"list_filter([{_W}, {_M}, CASE WHEN external_platforms IS NOT NULL THEN concat('they rely on ', external_platforms, ' and pay commission') END, CASE WHEN marketing_stack IS NULL THEN 'no tracking on their site, so they can''t see where leads come from' END], lambda x: x IS NOT NULL)[1:3]"


@query(f"SELECT lead_id, name AS business, concat('Hi, this is <you> calling for ', name, '. ', CASE WHEN owner_name IS NOT NULL THEN concat('Could I grab ', owner_name, ' for two minutes?') ELSE 'Is the owner around, or whoever looks after your marketing?' END) AS gatekeeper, concat('I had a look at ', name, ' before calling', CASE WHEN len(f) > 0 THEN concat(' — ', f[1], '.') ELSE '.' END) AS opener, array_to_string(f, '; ') AS facts, owner_email AS email_followup FROM (SELECT *, {_FACTS} AS f FROM v_leads)")
def c5_s16_call_sheet(spark, sf_dir):
    return outreach.call_script(view(spark, sf_dir, "leads"))


_GREET = "CASE lead_id % 3 WHEN 0 THEN concat('Hi Peter, ', name) WHEN 1 THEN concat('Hello Acme team, ', name) ELSE concat('we saw ', name) END"
_WHO = "lower(concat(coalesce(concat(owner_name, ' '), ''), name))"


@query(f"SELECT lead_id, g = '' OR contains(who, g) AS real_name, CASE WHEN g = '' OR contains(who, g) THEN t ELSE concat(upper(substring(r, 1, 1)), substring(r, 2)) END AS scrubbed FROM (SELECT *, lower(regexp_extract(t, '^\\s*(?:[Hh]i|[Hh]ello|[Hh]ey|[Gg]ood\\s+\\w+)[\\s,]+([A-Z][a-z]+)\\b', 1)) AS g, regexp_replace(regexp_replace(t, '^\\s*(?:[Hh]i|[Hh]ello|[Hh]ey|[Gg]ood\\s+\\w+)[\\s,]+([A-Z][a-z]+)\\b', ''), '^[ ,—-]+', '') AS r FROM (SELECT *, {_GREET} AS t, {_WHO} AS who FROM v_leads))")
def f19_greeting_gate(spark, sf_dir):
    k, n = F.col("lead_id") % 3, F.col("name")
    text = F.when(k == 0, F.concat(F.lit("Hi Peter, "), n)).when(k == 1, F.concat(F.lit("Hello Acme team, "), n)).otherwise(F.concat(F.lit("we saw "), n))
    return view(spark, sf_dir, "leads").select("lead_id", outreach.greeting_ok(text, F.col("owner_name"), n).alias("real_name"), outreach.scrub_greeting(text, F.col("owner_name"), n).alias("scrubbed"))
