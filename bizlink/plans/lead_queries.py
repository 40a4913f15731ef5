"""Queries over scored leads: identity, scores, gates, selection, market figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlink.functions import identity as I
from bizlink.functions import scoring as S
from bizlink.operators import market, select
from bizlink.plans.registry import query
from bizlink.plans.views import view

#: Lead score and confidence as SQL, for the checks.
_B = "coalesce({0}, false)"
_F = "coalesce({0} <> '', false)"
_LOCAL = "lower(split_part(owner_email, '@', 1))"
_DOMAIN = "lower(split_part(owner_email, '@', 2))"
_PERSONAL = f"(regexp_matches({_LOCAL}, '^[a-z][a-z.]+[a-z]$') AND length({_LOCAL}) >= 4)"
_ON = f"(coalesce(website <> '', false) AND coalesce(contains(lower(website), {_DOMAIN}), false))"
_ROLES = ", ".join(f"'{x}'" for x in S.ROLE_LOCALS)
_FREE = ", ".join(f"'{x}'" for x in S.FREE_DOMAINS)
PARTS_SQL = {
    "email": f"CASE WHEN NOT {_F.format('owner_email')} THEN 0 WHEN {_PERSONAL} AND {_ON} THEN 30 WHEN {_PERSONAL} THEN 20 WHEN {_LOCAL} NOT IN ({_ROLES}) AND {_ON} THEN 20 WHEN {_LOCAL} IN ({_ROLES}) AND {_ON} THEN 10 WHEN {_DOMAIN} NOT IN ({_FREE}) THEN 10 ELSE 5 END",
    "email_verify": f"CASE WHEN {_F.format('owner_email')} THEN CASE WHEN {_B.format('mx_valid')} THEN 4 ELSE 0 END + CASE WHEN {_B.format('deliverable')} THEN 4 WHEN {_B.format('smtp_valid')} THEN 2 ELSE 0 END + CASE WHEN NOT {_B.format('is_role')} AND {_B.format('mx_valid')} THEN 2 ELSE 0 END ELSE 0 END",
    "phone": f"CASE WHEN phone_verified AND {_F.format('phone')} THEN 10 + CASE WHEN phone_type IN ('mobile', 'voip', 'toll_free') THEN 2 ELSE 0 END ELSE 0 END",
    "website": f"CASE WHEN NOT {_F.format('website')} THEN 0 WHEN website_status = 'active' THEN 15 WHEN website_status = 'none' THEN 0 ELSE 5 END + CASE WHEN {_F.format('website_cms')} THEN 5 ELSE 0 END + CASE WHEN has_ssl THEN 5 ELSE 0 END",
    "maps": "CASE WHEN has_google_maps THEN 5 + CASE WHEN coalesce(google_rating, 0) >= 4 THEN 10 WHEN coalesce(google_rating, 0) >= 3 THEN 5 ELSE 0 END ELSE 0 END",
    "social": "least(10, " + " + ".join(f"CASE WHEN {_F.format('social_' + s)} THEN 5 ELSE 0 END" for s in ("facebook", "instagram", "twitter")) + ")",
    "bonus": f"CASE WHEN {_F.format('owner_name')} THEN 5 ELSE 0 END + CASE WHEN {_F.format('owner_phone')} THEN 5 WHEN google_review_count > 50 THEN 5 ELSE 0 END + CASE WHEN {_B.format('google_is_open')} THEN 5 ELSE 0 END",
    "intel": "CASE WHEN coalesce(employee_count, 0) > 50 THEN 5 WHEN coalesce(employee_count, 0) > 10 THEN 3 WHEN coalesce(employee_count, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(year_founded, 0) > 1900 THEN 3 ELSE 0 END + CASE WHEN partners IS NULL THEN 0 WHEN len(string_split(partners, ',')) >= 3 THEN 2 ELSE 1 END",
    "research": f"CASE WHEN {_F.format('services')} THEN 2 ELSE 0 END + CASE WHEN {_F.format('team_members')} THEN 3 ELSE 0 END + CASE WHEN {_F.format('owner_title')} THEN 2 ELSE 0 END",
    "penalty": "-greatest(0, least(5, coalesce(review_weakness_count, 0)))",
}
_NS = "CASE WHEN coalesce(sources <> '', false) THEN len(string_split(sources, ',')) ELSE 0 END"
CONF_SQL = "least(1000, " + " + ".join([
    f"CASE WHEN phone_verified THEN 200 WHEN {_F.format('phone')} THEN 50 ELSE 0 END",
    f"CASE WHEN email_verified THEN 200 WHEN {_F.format('owner_email')} THEN 50 ELSE 0 END",
    "CASE WHEN website_status = 'active' THEN 150 ELSE 0 END", "CASE WHEN website_name_found THEN 80 ELSE 0 END", "CASE WHEN has_google_maps THEN 150 ELSE 0 END",
    f"CASE WHEN {_F.format('owner_name')} THEN 100 ELSE 0 END", f"CASE WHEN {_F.format('owner_phone')} THEN 10 * owner_phone_tenths ELSE 0 END",
    "CASE WHEN coalesce(employee_count, 0) <> 0 THEN 50 ELSE 0 END", "CASE WHEN coalesce(year_founded, 0) <> 0 THEN 50 ELSE 0 END",
    *(f"CASE WHEN {_F.format(n)} THEN {p} ELSE 0 END" for n, p in (("partners", 50), ("services", 50), ("team_members", 80), ("owner_title", 50))),
    f"CASE WHEN {_NS} >= 3 THEN 150 WHEN {_NS} >= 2 THEN 100 ELSE 0 END", "CASE WHEN phone_source_count >= 2 THEN 50 ELSE 0 END", f"CASE WHEN {_B.format('address_valid')} THEN 50 ELSE 0 END",
]) + ")"
SCORE_SQL = f"least(100, {' + '.join(f'({p})' for p in PARTS_SQL.values())})"
_VERIFIED = "(lead_score >= 40 OR (phone_verified AND (has_google_maps OR contains(sources, 'npi'))))"
_ACCURATE = f"(conf_milli >= 600 AND (phone_verified OR email_verified OR (has_google_maps AND {_NS} >= 2)))"
_TIER = f"CASE WHEN phone_verified OR email_verified THEN 'verified' WHEN has_google_maps AND {_NS} >= 2 THEN 'corroborated' ELSE 'unverified' END"
_CATEGORY = "CASE WHEN coalesce(website <> '', false) AND coalesce(website_status = 'active', false) THEN 'has_website' ELSE 'no_website' END"
_CONTACT = f"({_F.format('owner_email')} OR {_F.format('owner_phone')} OR {_F.format('phone')})"
_PITCH = f"CASE WHEN {_CONTACT} AND (website_name_found OR has_google_maps) AND {_F.format('owner_name')} AND lead_score >= 40 THEN 'Ready' WHEN {_CONTACT} AND (website_name_found OR has_google_maps) THEN 'Needs Owner' WHEN {_CONTACT} THEN 'Needs Site' ELSE 'Needs Contact' END"
#: The scored leads as one more common table.
SCORED = f"(SELECT *, CAST({SCORE_SQL} AS INT) AS lead_score, CAST({CONF_SQL} AS INT) AS conf_milli FROM v_leads)"
LABELLED = f"(SELECT *, {_TIER} AS tier, {_CATEGORY} AS category, {_PITCH} AS pitch FROM {SCORED})"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "leads").withColumn("lead_score", S.lead_score()).withColumn("conf_milli", S.confidence_milli())


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumns({"tier": S.verification_tier(), "category": S.category(), "pitch": S.pitch_tier()})


@query("SELECT lead_id, regexp_replace(regexp_replace(lower(name), '\\b(the|inc|llc|ltd|co|company|corp|plc|group)\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS name_norm, trim(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g')) AS spaced, CASE WHEN phone IS NULL THEN NULL ELSE right(regexp_replace(phone, '\\D', '', 'g'), 7) END AS phone7 FROM v_leads")
def f1_f3_identity_keys(spark, sf_dir):
    return view(spark, sf_dir, "leads").select("lead_id", I.normalize_name(F.col("name")).alias("name_norm"), I.spaced_name(F.col("name")).alias("spaced"), I.phone_key(F.col("phone")).alias("phone7"))


@query(f"SELECT lead_id, {', '.join(f'CAST({v} AS INT) AS {k}' for k, v in PARTS_SQL.items())}, CAST({SCORE_SQL} AS INT) AS lead_score FROM v_leads")
def c1_lead_score(spark, sf_dir):
    return view(spark, sf_dir, "leads").select("lead_id", *(v.cast("int").alias(k) for k, v in S.score_parts().items()), S.lead_score().alias("lead_score"))


@query(f"SELECT lead_id, CAST(conf_milli AS INT) AS conf_milli, floor((conf_milli + 5) / 10) / 100 AS data_confidence FROM {SCORED}")
def c2_data_confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("lead_id", "conf_milli", S.confidence().cast("double").alias("data_confidence"))


@query(f"SELECT lead_id, {_VERIFIED} AS verified, (coalesce(phone <> '', false) OR coalesce(owner_email <> '', false) OR coalesce(website <> '', false)) AS contactable, {_ACCURATE} AS accurate FROM {SCORED}")
def p1_p3_gates(spark, sf_dir):
    return scored(spark, sf_dir).select("lead_id", S.is_verified().alias("verified"), S.is_contactable().alias("contactable"), S.is_accurate().alias("accurate"))


@query(f"SELECT lead_id, tier, category, pitch, CASE WHEN lead_score >= 70 THEN 'HIGH' WHEN lead_score >= 40 THEN 'MED' ELSE 'LOW' END AS band FROM {LABELLED}")
def p7_p10_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("lead_id", "tier", "category", "pitch", S.score_band().alias("band"))


@query("SELECT lead_id, trim(split_part(coalesce(address, 'Bend, OR'), ',', 1)) AS city FROM v_leads WHERE NOT has_google_maps AND NOT (phone IS NOT NULL AND contains(sources, 'npi'))")
def p5_needs_maps(spark, sf_dir):
    city = F.trim(F.split_part(F.coalesce("address", F.lit("Bend, OR")), F.lit(","), F.lit(1)))
    return view(spark, sf_dir, "leads").where(S.needs_maps()).select("lead_id", city.alias("city"))


@query(f"SELECT 'no_website' AS tab, lead_id FROM {LABELLED} WHERE category = 'no_website' UNION ALL SELECT 'has_website', lead_id FROM {LABELLED} WHERE category = 'has_website' UNION ALL SELECT 'has_gmaps', lead_id FROM {LABELLED} WHERE has_google_maps UNION ALL SELECT 'owner_found', lead_id FROM {LABELLED} WHERE owner_name IS NOT NULL UNION ALL SELECT 'high_value', lead_id FROM {LABELLED} WHERE lead_score >= 70 UNION ALL SELECT 'all', lead_id FROM {LABELLED}")
def p6_tab_filters(spark, sf_dir):
    leads = labelled(spark, sf_dir)
    out = None
    for name in ("no_website", "has_website", "has_gmaps", "owner_found", "high_value", "all"):
        one = select.tab(leads, name).select(F.lit(name).alias("tab"), "lead_id")
        out = one if out is None else out.unionByName(one)
    return out


_LOCATIONS = "(SELECT lead_id, address, CASE lead_id % 4 WHEN 0 THEN 'Bend, OR' WHEN 1 THEN 'Madison, Wisconsin' WHEN 2 THEN 'Boise' ELSE 'X, Nowhere' END AS location FROM v_leads)"


@query(f"SELECT lead_id, CASE WHEN location IN ('Boise', 'X, Nowhere') OR address IS NULL THEN true WHEN location = 'Bend, OR' THEN regexp_matches(lower(address), '\\bor\\b') OR contains(lower(address), 'oregon') ELSE regexp_matches(lower(address), '\\bwi\\b') OR contains(lower(address), 'wisconsin') END AS plausible FROM {_LOCATIONS}")
def p4_location_matches(spark, sf_dir):
    from bizlink.functions.places import location_matches

    k = F.col("lead_id") % 4
    location = F.when(k == 0, "Bend, OR").when(k == 1, "Madison, Wisconsin").when(k == 2, "Boise").otherwise("X, Nowhere")
    return view(spark, sf_dir, "leads").select("lead_id", location_matches(F.col("address"), location).alias("plausible"))


@query("SELECT lead_id, CASE WHEN lead_id % 3 = 0 THEN CAST(floor(gate_conf_milli * 3 / 10) AS INT) WHEN lead_id % 3 = 1 THEN CAST(least(1000, gate_conf_milli + 100) AS INT) ELSE CAST(gate_conf_milli AS INT) END AS conf_milli, CASE WHEN lead_id % 3 = 0 THEN 'unverified' ELSE 'verified' END AS tier FROM v_leads")
def p17_registry_gate(spark, sf_dir):
    k = F.col("lead_id") % 3
    status = F.when(k == 0, "dissolved").when(k == 1, "active").otherwise("unknown")
    milli, tier = S.registry_gate(F.col("gate_conf_milli"), F.lit("verified"), status)
    return view(spark, sf_dir, "leads").select("lead_id", milli.cast("int").alias("conf_milli"), tier.alias("tier"))


@query(f"""SELECT job_id, lead_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY lead_score DESC, conf_milli DESC, ord, lead_id) AS INT) AS export_rank FROM (
 SELECT *, max(CASE WHEN reach THEN 1 ELSE 0 END) OVER (PARTITION BY job_id) AS anyreach FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY lead_score DESC, conf_milli DESC, ord, lead_id) AS rn FROM (
   SELECT *, (phone IS NOT NULL OR owner_email IS NOT NULL OR website IS NOT NULL) AS reach,
    CASE WHEN max(t) OVER (PARTITION BY job_id) >= 2 THEN max(t) OVER (PARTITION BY job_id) ELSE max(CASE WHEN status = 'validated' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id) END AS best
   FROM (SELECT *, CASE WHEN {_VERIFIED} AND {_ACCURATE} THEN 3 WHEN {_VERIFIED} THEN 2 ELSE 0 END AS t FROM {SCORED}))
  WHERE CASE WHEN best >= 2 THEN t >= best WHEN best = 1 THEN status = 'validated' ELSE true END)
 WHERE best < 2 OR rn <= 20) WHERE anyreach = 0 OR reach""")
def l4_gated_export(spark, sf_dir):
    return select.gated_export(scored(spark, sf_dir), 20).select("job_id", "lead_id", "export_rank")


@query(f"""SELECT job_id, lead_id, CAST(b AS BIGINT) AS batch FROM (SELECT n.*, p.before FROM (
  SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY ord, lead_id) - 1) // 10 AS b, {_VERIFIED} AS ok FROM {SCORED}) n
 JOIN (SELECT job_id, b, sum(had) OVER (PARTITION BY job_id) + coalesce(sum(fresh) OVER (PARTITION BY job_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT job_id, b, sum(CASE WHEN status = 'validated' AND ok THEN 1 ELSE 0 END) AS had, sum(CASE WHEN status <> 'validated' AND ok THEN 1 ELSE 0 END) AS fresh FROM (
   SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY ord, lead_id) - 1) // 10 AS b, {_VERIFIED} AS ok FROM (SELECT * REPLACE (CASE WHEN lead_id % 7 = 0 THEN 'validated' ELSE 'raw' END AS status) FROM {SCORED})) GROUP BY 1, 2)) p
 ON n.job_id = p.job_id AND n.b = p.b WHERE before < 25)""")
def w2_batch_stop_prefix(spark, sf_dir):
    leads = scored(spark, sf_dir).withColumn("status", F.when(F.col("lead_id") % 7 == 0, "validated").otherwise("raw"))
    return select.batch_cut(leads, 25, 10).select("job_id", "lead_id", "batch")


_SIZE = _NS


@query(f"SELECT job_id, lead_id, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_SIZE} DESC, has_google_maps DESC, list_contains(string_split(sources, ','), 'npi') DESC, (phone IS NOT NULL) DESC, (website IS NOT NULL) DESC, ord) AS rn FROM v_leads) WHERE rn <= 30")
def l1_likelihood_rank(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("job_id").orderBy(*select.likelihood_order())
    return view(spark, sf_dir, "leads").withColumn("place", F.row_number().over(w)).where("place <= 30").select("job_id", "lead_id", "place")


@query(f"SELECT job_id, lead_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_SIZE} DESC, has_google_maps DESC, ord) AS rn FROM v_leads) WHERE rn <= 15")
def l2_source_rank_cut(spark, sf_dir):
    return select.first_by(view(spark, sf_dir, "leads"), ["job_id"], select.source_rank_order(), 15).select("job_id", "lead_id")


@query("SELECT job_id, CAST(least(floor(lim * 1.5), 800) AS INT) AS pool, CAST(least(60, least(floor(lim * 1.5), 800)) AS INT) AS per_tile FROM v_jobs")
def l3_pool_size(spark, sf_dir):
    pool = select.pool_size(F.col("lim"))
    return view(spark, sf_dir, "jobs").select("job_id", pool.alias("pool"), F.least(F.lit(60), pool).alias("per_tile"))


@query(f"SELECT lead_id, lead_score FROM {SCORED} WHERE has_google_maps ORDER BY lead_score DESC, lead_id OFFSET 40 LIMIT 20")
def l5_page(spark, sf_dir):
    leads = scored(spark, sf_dir).where("has_google_maps")
    return select.page(leads, 3, 20, [F.col("lead_score").desc(), F.col("lead_id")]).select("lead_id", "lead_score")


@query(f"SELECT count(*) AS total FROM {SCORED} WHERE has_google_maps")
def a10_page_total(spark, sf_dir):
    return scored(spark, sf_dir).where("has_google_maps").agg(F.count("*").alias("total"))


@query("SELECT job_id, created_at FROM v_jobs ORDER BY created_at DESC, job_id DESC LIMIT 50")
def l6_latest_jobs(spark, sf_dir):
    return view(spark, sf_dir, "jobs").orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(50).select("job_id", "created_at")


@query("SELECT job_id, niche, status FROM v_jobs WHERE job_id = 77")
def l8_job_lookup(spark, sf_dir):
    return view(spark, sf_dir, "jobs").where("job_id = 77").select("job_id", "niche", "status")


@query("SELECT job_id FROM v_jobs WHERE status = 'running' AND coalesce(heartbeat_at, created_at) < TIMESTAMP '1998-01-01' - INTERVAL '9000' SECOND")
def w6_stale_jobs(spark, sf_dir):
    return select.stale_jobs(view(spark, sf_dir, "jobs"), F.lit("1998-01-01").cast("timestamp")).select("job_id")


@query(f"SELECT job_id, CAST(count(*) FILTER ({_VERIFIED}) AS BIGINT) AS verified, CAST(min(lead_score) AS INT) AS min_score, CAST(max(lead_score) AS INT) AS max_score, floor((sum(lead_score) * 20 + count(*)) / (count(*) * 2)) / 10 AS avg_score FROM {SCORED} GROUP BY job_id")
def a4_a5_job_scores(spark, sf_dir):
    n, s = F.count("*"), F.sum("lead_score")
    avg = (F.floor((s * 20 + n) / (n * 2)) / 10).cast("double")
    return scored(spark, sf_dir).groupBy("job_id").agg(F.count_if(S.is_verified()).alias("verified"), F.min("lead_score").alias("min_score"), F.max("lead_score").alias("max_score"), avg.alias("avg_score"))


_HAS = lambda x: f"CAST(count(*) FILTER ({x}) AS DOUBLE)"
_SUMMARY = {
    "Total Leads": "CAST(count(*) AS DOUBLE)", "No Website (Hot)": _HAS("category = 'no_website'"), "Has Website": _HAS("category = 'has_website'"), "With Owner Name": _HAS("owner_name IS NOT NULL"),
    "With Owner Phone": _HAS("owner_phone IS NOT NULL"), "With Owner Title": _HAS("owner_title IS NOT NULL"), "With Email": _HAS("owner_email IS NOT NULL"), "Verified Email": _HAS("email_verified"), "Verified Phone": _HAS("phone_verified"),
    "Tier: Verified": _HAS("tier = 'verified'"), "Tier: Corroborated": _HAS("tier = 'corroborated'"), "Tier: Unverified": _HAS("tier = 'unverified'"), "On Google Maps": _HAS("has_google_maps"), "Name On Website": _HAS("website_name_found"),
    "Pitch Ready": _HAS("pitch = 'Ready'"), "With Services": _HAS("services IS NOT NULL"), "With Team Roster": _HAS("team_members IS NOT NULL"), "Count Emp. Count": _HAS("employee_count <> 0"), "Count Year Founded": _HAS("year_founded <> 0"), "Count Partners": _HAS("partners IS NOT NULL"),
    "From Google Maps": _HAS("contains(sources, 'google_maps')"), "From YellowPages": _HAS("contains(sources, 'yellowpages')"), "From Yelp": _HAS("contains(sources, 'yelp')"), "From Hotfrog": _HAS("contains(sources, 'hotfrog')"),
    "Avg Lead Score": "floor((sum(lead_score) * 20 + count(*)) / (count(*) * 2)) / 10", "Avg Confidence": "floor((sum(conf_milli) * 2 + count(*) * 10) / (count(*) * 20)) / 100",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS value FROM {LABELLED}" for k, v in _SUMMARY.items()))
def a7_summary(spark, sf_dir):
    return market.counts(labelled(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (lead_score >= 70) AS high, count(*) FILTER (lead_score >= 40 AND lead_score < 70) AS medium, count(*) FILTER (owner_email IS NOT NULL) AS emails, count(*) FILTER (owner_phone IS NOT NULL) AS owner_phones, count(*) FILTER (phone_verified) AS phones_ok, count(*) FILTER (has_google_maps) AS on_maps, count(*) FILTER (category = 'no_website') AS no_site, count(*) FILTER (pitch = 'Ready') AS ready FROM {LABELLED}")
def a8_report_kpis(spark, sf_dir):
    c, n = F.col, F.count_if
    return labelled(spark, sf_dir).agg(
        F.count("*").alias("total"), n(c("lead_score") >= 70).alias("high"), n((c("lead_score") >= 40) & (c("lead_score") < 70)).alias("medium"), n(I.filled(c("owner_email"))).alias("emails"), n(I.filled(c("owner_phone"))).alias("owner_phones"),
        n(c("phone_verified")).alias("phones_ok"), n(c("has_google_maps")).alias("on_maps"), n(c("category") == "no_website").alias("no_site"), n(c("pitch") == "Ready").alias("ready"),
    )


@query("SELECT owner_email, count(*) AS n FROM v_leads WHERE owner_email IS NOT NULL GROUP BY owner_email HAVING count(*) > 1")
def a11_shared_emails(spark, sf_dir):
    return view(spark, sf_dir, "leads").where(I.filled(F.col("owner_email"))).groupBy("owner_email").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT job_id, lead_id, CAST(place AS INT) AS place, rival_id, rival_name FROM (
 SELECT a.job_id, a.lead_id, b.lead_id AS rival_id, b.name AS rival_name, row_number() OVER (PARTITION BY a.lead_id ORDER BY coalesce(b.google_rating, 0) DESC, coalesce(b.google_review_count, 0) DESC, b.lead_id) AS place
 FROM v_leads a JOIN v_leads b ON a.job_id = b.job_id AND a.lead_id <> b.lead_id) WHERE place <= 6""")
def j12_competitors(spark, sf_dir):
    return market.competitors(view(spark, sf_dir, "leads"))


#: Trade words set behind part names, so that every profile and the fallback occur.
_TRADES = ["roof repair", "AC repair", "plumber", "electrician", "solar", "mold", "tree service", "paving", "house painting", "kitchen remodeling", "bakery", "motel", "pet grooming"]


@query(
    "SELECT p_partkey, CASE p_partkey % 13 WHEN 0 THEN 'Roofing' WHEN 1 THEN 'HVAC' WHEN 2 THEN 'Plumbing' WHEN 3 THEN 'Electrical' WHEN 4 THEN 'Solar' WHEN 5 THEN 'Restoration (water/fire/mold)' WHEN 6 THEN 'Landscaping / Lawn' "
    "WHEN 7 THEN 'Concrete / Masonry / Paving' WHEN 8 THEN 'Painting' WHEN 9 THEN 'Remodeling / General Contractor' WHEN 10 THEN 'Restaurant' WHEN 11 THEN 'Hospitality / Lodging' ELSE 'Local business' END AS profile FROM part"
)
def j13_vertical_profile(spark, sf_dir):
    trade = F.get(F.array(*(F.lit(t) for t in _TRADES)), (F.col("p_partkey") % 13).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", market.profile_of(F.initcap(trade)).alias("profile"))


@query("SELECT lead_id, CASE WHEN google_review_count > 0 AND year_founded > 0 THEN floor((google_review_count * 20 + greatest(1, 2026 - year_founded)) / (greatest(1, 2026 - year_founded) * 2)) / 10 ELSE NULL END AS velocity FROM v_leads")
def c3_review_velocity(spark, sf_dir):
    return view(spark, sf_dir, "leads").select("lead_id", S.review_velocity(F.col("google_review_count"), F.col("year_founded"), 2026).cast("double").alias("velocity"))


@query("SELECT DISTINCT o.job_id AS job_id, o.niche AS niche, count(l.l_orderkey) AS n_leads FROM (SELECT * FROM v_jobs ORDER BY created_at DESC, job_id DESC LIMIT 15) o LEFT JOIN lineitem l ON l.l_orderkey = o.job_id GROUP BY 1, 2")
def j16_recent_job_counts(spark, sf_dir):
    jobs = view(spark, sf_dir, "jobs").orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(15)
    leads = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("job_id"))
    return jobs.join(leads.withColumn("one", F.lit(1)), "job_id", "left").groupBy("job_id", "niche").agg(F.count("one").alias("n_leads"))
