"""Queries over landed documents, reviews, replies, linkage and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlink.functions.identity import slug
from bizlink.operators import linkage, lookups, records
from bizlink.operators.select import first_by
from bizlink.plans.lead_queries import LABELLED, SCORED, labelled, scored
from bizlink.plans.registry import query
from bizlink.plans.views import spread, table, view
from bizlink.sources import sinks


def _npi(spark, sf_dir):
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    basic = F.when(k % 3 == 0, text('{"organization_name":"Clinic ', k.cast("string"), '"}')).when(k % 3 == 1, text('{"first_name":"Ann","last_name":"Lee', k.cast("string"), '"}')).otherwise("{}")
    place = text('[{"address_purpose":"MAILING","address_1":"PO ', k.cast("string"), '","state":"OR"},{"address_purpose":"', F.when(k % 2 == 0, "LOCATION").otherwise("OTHER"), '","address_1":"1 Main","city":"Bend","state":"WI","telephone_number":"541-555-', F.substring((10000 + k % 10000).cast("string"), 2, 4), '"}]')
    kind = text('[{"desc":"Nurse","primary":false},{"desc":"', F.when(k % 4 == 0, "Dentist").otherwise("Clinic"), '","primary":true}]')
    return table(spark, sf_dir, "customer").select(k.alias("ord"), F.col("c_nationkey").alias("job_id"), text('{"number":"', k.cast("string"), '","basic":', basic, ',"addresses":', place, ',"taxonomies":', kind, "}").alias("json"))


_NPI = "SELECT c_custkey AS ord, c_nationkey AS job_id, CASE c_custkey % 3 WHEN 0 THEN concat('Clinic ', c_custkey) ELSE concat('Ann Lee', c_custkey) END AS name, CASE WHEN c_custkey % 2 = 0 THEN '1 Main, Bend, WI' ELSE concat('PO ', c_custkey, ', OR') END AS address, CASE WHEN c_custkey % 2 = 0 THEN concat('541-555-', substring(CAST(10000 + c_custkey % 10000 AS VARCHAR), 2, 4)) END AS phone, CASE WHEN c_custkey % 4 = 0 THEN 'Dentist' ELSE 'Clinic' END AS category FROM customer WHERE c_custkey % 3 <> 2"


@query(f"SELECT ord, name, address, phone, category FROM ({_NPI})")
def s2_npi_projection(spark, sf_dir):
    return records.npi_listing(_npi(spark, sf_dir)).select("ord", "name", "address", "phone", "category")


@query(f"SELECT job_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS n FROM (SELECT *, row_number() OVER (PARTITION BY job_id, lower(name), right(regexp_replace(coalesce(phone, ''), '\\D', '', 'g'), 7) ORDER BY ord) AS rn FROM (SELECT *, contains(lower(category), CASE WHEN job_id % 2 = 0 THEN 'dentist' ELSE 'surgeon' END) AS hit, max(CASE WHEN contains(lower(category), CASE WHEN job_id % 2 = 0 THEN 'dentist' ELSE 'surgeon' END) THEN 1 ELSE 0 END) OVER (PARTITION BY job_id) AS anyhit FROM ({_NPI})) WHERE hit OR anyhit = 0) WHERE rn = 1) WHERE n <= 12")
def s3_npi_selection(spark, sf_dir):
    term = F.when(F.col("job_id") % 2 == 0, "dentist").otherwise("surgeon")
    return records.npi_select(records.npi_listing(_npi(spark, sf_dir)), term, 12).select("job_id", "ord")


@query("SELECT p_partkey, p_name AS name, concat(p_size, ' Main St, Bend') AS address, CASE WHEN p_partkey % 2 = 0 THEN concat('https://p', p_partkey, '.com') ELSE 'https://own.example' END AS website, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 5 AS DOUBLE) END AS google_rating, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS INT) ELSE 0 END AS google_review_count FROM part")
def s4_json_ld_listing(spark, sf_dir):
    k, text = F.col("p_partkey"), F.concat
    rating = F.when(k % 3 == 0, text(F.lit(',"aggregateRating":{"ratingValue":"'), (F.col("p_size") % 5).cast("string"), F.lit('","ratingCount":"'), F.col("p_size").cast("string"), F.lit('"}'))).otherwise("")
    url = F.when(k % 2 == 0, text(F.lit("https://p"), k.cast("string"), F.lit(".com"))).otherwise("https://www.hotfrog.com/x")
    block = text(F.lit('{"name":"'), F.col("p_name"), F.lit('","address":{"streetAddress":"'), F.col("p_size").cast("string"), F.lit(' Main St","addressLocality":"Bend"},"url":"'), url, F.lit('","sameAs":["https://facebook.com/a","https://own.example"]'), rating, F.lit("}"))
    rows = table(spark, sf_dir, "part").select("p_partkey", block.alias("block"))
    return records.ld_listing(rows, "directory").select("p_partkey", "name", "address", "website", "google_rating", "google_review_count")


@query("SELECT s_suppkey AS panel_id, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE concat('Shop ', s_suppkey) END AS name, 3 + CAST(s_suppkey % 20 AS DOUBLE) / 10 AS google_rating, CAST(1000 + s_suppkey AS INT) AS google_review_count, CASE s_suppkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS google_is_open, 40.5 AS latitude, -73.25 AS longitude FROM supplier")
def s7_f18_place_panels(spark, sf_dir):
    k = F.col("s_suppkey")
    n = (1000 + k).cast("string")
    rating = F.concat((3 + F.floor((k % 20) / 10)).cast("string"), F.lit(","), (k % 10).cast("string"), F.lit(" ("), F.substring(n, 1, 1), F.lit(","), F.substring(n, 2, 9), F.lit(")"))
    hours = F.when(k % 3 == 0, "Closed now").when(k % 3 == 1, "Open until 5").otherwise("")
    url = F.when(k % 2 == 0, "https://maps/place/x/@40.5,-73.25,17z").otherwise("https://maps/place/x!3d40.5!4d-73.25")
    panels = table(spark, sf_dir, "supplier").select(k.alias("panel_id"), F.when(k % 5 == 0, "Results").otherwise(F.concat(F.lit("Shop "), k.cast("string"))).alias("name"), F.col("s_name").alias("fallback_name"), rating.alias("rating_text"), hours.alias("hours"), url.alias("url"))
    return records.panel_listing(panels)


@query("SELECT o_orderkey, o_custkey % 7 NOT IN (1, 4) AS medical FROM orders")
def p16_medical_niche(spark, sf_dir):
    niches = ["Dentist", "roof", "Physicians", "Urgent Care", "pub", "Optometrist", "Home Health aide"]
    niche = F.concat_ws(" ", F.lit("local"), F.get(F.array(*(F.lit(n) for n in niches)), (F.col("o_custkey") % 7).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", records.is_medical(niche).alias("medical"))


_LISTS = "(SELECT lead_id, count(*) FILTER (stars <= 2) AS low, count(stars) AS total, list(struct_pack(s := coalesce(stars, 5), p := pos, t := text) ORDER BY coalesce(stars, 5), pos, text) AS l FROM v_reviews GROUP BY lead_id)"


@query(f"SELECT lead_id, nullif(concat_ws(', ', CASE WHEN low > 0 THEN concat(low, ' recent 1-2★ review(s) with complaint text') END, CASE WHEN total > 0 AND low * 5 >= total THEN concat(CAST(floor((low * 200 + total) / (total * 2)) AS INT), '% of reviews are 1-2★') END, CASE WHEN lead_id % 3 = 0 AND low > 0 THEN 'Owner does not reply to negative reviews (reputation-management gap)' END), '') AS weaknesses, least(3, low) + CASE WHEN total > 0 AND low * 5 >= total THEN 2 ELSE 0 END + CASE WHEN lead_id % 3 = 0 AND low > 0 THEN 1 ELSE 0 END AS weakness_count FROM {_LISTS}")
def a13_review_weaknesses(spark, sf_dir):
    lists = records.review_lists(view(spark, sf_dir, "reviews"))
    text, count = records.review_weaknesses(F.col("reviews"), F.col("histogram"), F.when(F.col("lead_id") % 3 == 0, False))
    return lists.select("lead_id", text.alias("weaknesses"), count.alias("weakness_count"))


@query(f"SELECT lead_id, array_to_string(list_transform(l[1:6], lambda x: x.t), '|') AS worst FROM {_LISTS}")
def c6_w4_worst_reviews(spark, sf_dir):
    lists = records.review_lists(view(spark, sf_dir, "reviews"))
    return lists.select("lead_id", F.array_join(records.worst_first(F.col("reviews"), 6), "|").alias("worst"))


@query("SELECT job_id, count(*) FILTER (u) AS degraded, count(*) AS n FROM (SELECT job_id, CASE WHEN job_id % 2 = 0 THEN lead_id % 5 IN (0, 1, 2) ELSE lead_id % 5 = 1 END AS u FROM v_leads) GROUP BY job_id HAVING count(*) FILTER (u) * 2 >= count(*)")
def p15_degraded_reviews(spark, sf_dir):
    k, even = F.col("lead_id") % 5, F.col("job_id") % 2 == 0
    panel = F.when(even & (k == 0), "4.9").when(k == 1, None).when(even & (k == 2), "3.0 ()").otherwise("4.9\n(1,418)")
    return records.degraded_jobs(view(spark, sf_dir, "leads").select("job_id", records.reviews_unavailable(panel).alias("unavailable")))


@query("SELECT lead_id, CASE WHEN lead_id % 3 = 0 THEN 'new' ELSE 'old' END AS weaknesses, CASE WHEN lead_id % 3 = 0 THEN 4 ELSE review_weakness_count END AS weakness_count FROM v_leads")
def j17_apply_reviews(spark, sf_dir):
    leads = view(spark, sf_dir, "leads").select("lead_id", F.lit("old").alias("weaknesses"), F.col("review_weakness_count").alias("weakness_count"))
    found = leads.where("lead_id % 2 = 0 or lead_id % 3 = 0").select("lead_id", F.when(F.col("lead_id") % 3 == 0, "new").otherwise("").alias("weaknesses"), F.lit(4).alias("weakness_count"))
    return records.apply_reviews(leads, found)


_T = "CASE WHEN google_review_count > 0 AND year_founded > 0 THEN floor((google_review_count * 20 + greatest(1, 2026 - year_founded)) / (greatest(1, 2026 - year_founded) * 2)) END"
_RULES = [
    (f"coalesce({_T} < 50 AND 2026 - year_founded >= 3, false)", f"printf('Low review velocity (~%.1f/yr for time in business)', {_T} / 10)", 1), ("coalesce(google_rating < 2, false)", "'Very poor reputation (rating < 2.0)'", 3),
    ("coalesce(google_rating >= 2 AND google_rating < 3, false)", "'Poor reputation (rating < 3.0)'", 2), ("coalesce(google_rating >= 3 AND google_rating < 3.5, false)", "'Mixed reviews (rating < 3.5)'", 1), ("coalesce(google_rating >= 3.5 AND google_rating < 4, false)", "'Below-average rating (< 4.0)'", 1),
    ("coalesce(google_review_count > 50 AND google_rating > 0 AND google_rating < 3.5, false)", "'Systemic complaints (many reviews, low rating)'", 2), ("website IS NULL", "'No website presence'", 1), ("website IS NOT NULL AND coalesce(website_status = 'dead', false)", "'Website offline'", 1),
    ("owner_email IS NULL", "'No email address available'", 1), ("owner_email IS NULL AND phone IS NULL", "'No contact method available'", 1), ("NOT has_google_maps", "'No Google Maps presence'", 1),
]


@query("SELECT lead_id, nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t, _ in _RULES) + "), '') AS weaknesses, " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, _, n in _RULES) + " AS n FROM v_leads")
def c4_rule_weaknesses(spark, sf_dir):
    text, n = records.rule_weaknesses(2026)
    return view(spark, sf_dir, "leads").select("lead_id", text.alias("weaknesses"), n.alias("n"))


@query("SELECT lead_id, CASE WHEN lead_id % 5 = 0 THEN '[NAME OF OWNER] runs it' ELSE concat('A ', lower(business_category), ' firm') END AS clean, lead_id % 5 = 0 AS slot FROM v_leads")
def f20_clean_text(spark, sf_dir):
    raw = F.when(F.col("lead_id") % 5 == 0, "**[NAME OF OWNER]**  runs\nit -").otherwise(F.concat(F.lit("## A `"), F.lower("business_category"), F.lit("`  firm ;")))
    clean = records.clean_text(raw)
    return view(spark, sf_dir, "leads").select("lead_id", clean.alias("clean"), records.has_placeholder(clean).alias("slot"))


def _replies(spark, sf_dir):
    k = F.col("lead_id")
    body = F.concat(F.lit('{"services":"'), F.lower("business_category"), F.lit('","employee_count":"'), (k % 70000).cast("string"), F.lit('","year_founded":'), (1600 + k % 400).cast("string"), F.lit(',"owner_name":"'), F.when(k % 4 == 0, "Our Team").otherwise("Jane Doe"), F.lit('"'))
    raw = F.when(k % 3 == 0, F.concat(body, F.lit("}"))).when(k % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("}\n```"))).otherwise(F.concat(body, F.lit(',"owner_title": "CE')))
    return view(spark, sf_dir, "leads").select("lead_id", raw.alias("raw"))


@query("SELECT lead_id, lower(business_category) AS services, CASE WHEN lead_id % 4 <> 0 THEN 'Jane Doe' END AS owner_name, CASE WHEN lead_id % 3 = 2 THEN 'CE' END AS owner_title, CASE WHEN lead_id % 70000 BETWEEN 1 AND 50000 THEN CAST(lead_id % 70000 AS INT) END AS employee_count, CASE WHEN 1600 + lead_id % 400 BETWEEN 1701 AND 2100 THEN CAST(1600 + lead_id % 400 AS INT) END AS year_founded FROM v_leads")
def f21_f22_model_replies(spark, sf_dir):
    parsed = records.parse_replies(_replies(spark, sf_dir))
    return parsed.select("lead_id", *(v.alias(k) for k, v in records.sane_facts(F.col("json")).items()))


@query("SELECT lead_id, CAST(coalesce(employee_count, CASE WHEN lead_id % 70000 BETWEEN 1 AND 50000 THEN lead_id % 70000 END) AS INT) AS employee_count, coalesce(owner_name, CASE WHEN lead_id % 4 <> 0 THEN 'Jane Doe' END) AS owner_name FROM v_leads")
def f22_fill_gaps(spark, sf_dir):
    facts = records.parse_replies(_replies(spark, sf_dir)).select("lead_id", *(v.alias(k) for k, v in records.sane_facts(F.col("json")).items()))
    leads = view(spark, sf_dir, "leads").select("lead_id", "employee_count", "owner_name")
    return records.fill_gaps(leads, facts, ["employee_count", "owner_name"])


@query("SELECT lead_id, CASE WHEN owner_title IS NOT NULL THEN owner_title WHEN lead_id % 5 = 0 THEN NULL ELSE services END AS merged FROM v_leads")
def f23_partial_merge(spark, sf_dir):
    return view(spark, sf_dir, "leads").select("lead_id", records.merge_partial(F.col("services"), F.col("owner_title"), F.col("lead_id") % 5 == 0).alias("merged"))


_T10 = "CASE WHEN google_review_count > 0 AND year_founded > 0 THEN floor((google_review_count * 20 + greatest(1, 2026 - year_founded)) / (greatest(1, 2026 - year_founded) * 2)) END"
_FACTS = {
    "name": "name", "category": "coalesce(business_category, '(unknown)')", "location": "coalesce(address, '(unknown)')", "website": "coalesce(website, '(none)')", "platform": "coalesce(website_cms, '(unknown)')",
    "ssl": "CASE WHEN has_ssl THEN 'yes' ELSE 'no/unknown' END", "services": "coalesce(services, '(none listed)')", "about": "coalesce(description, '(none)')", "rating": "coalesce(CASE WHEN google_rating IS NOT NULL THEN printf('%.1f', google_rating) END, '(unknown)')",
    "reviews": "google_review_count", "reviews_per_year": f"coalesce(CAST(CAST({_T10} AS BIGINT) AS VARCHAR), 'unknown')", "open_now": "coalesce(CAST(google_is_open AS VARCHAR), '(unknown)')", "platforms": "coalesce(external_platforms, '(none detected)')", "marketing": "coalesce(marketing_stack, '(none detected)')",
    "weaknesses": "CASE WHEN review_weakness_count > 0 THEN CAST(review_weakness_count AS VARCHAR) ELSE '(none found)' END", "review_texts": "coalesce(nullif(texts, ''), '(none)')", "owner": "coalesce(owner_name, '(unknown)')", "owner_title": "coalesce(owner_title, '(unknown)')",
    "team_size": "coalesce(CAST(employee_count AS VARCHAR), '(unknown)')", "founded": "coalesce(CAST(year_founded AS VARCHAR), '(unknown)')",
    "socials": "coalesce(nullif(array_to_string(list_filter([CASE WHEN social_facebook IS NOT NULL THEN 'facebook' END, CASE WHEN social_instagram IS NOT NULL THEN 'instagram' END, CASE WHEN social_twitter IS NOT NULL THEN 'twitter' END], lambda x: x IS NOT NULL), ', '), ''), '(none found)')",
}
_SNIPPETS = "(SELECT lead_id, array_to_string(list(concat(coalesce(CAST(stars AS VARCHAR), '?'), '★: ', substring(text, 1, 160)) ORDER BY s, pos, stars NULLS FIRST, text), ' | ') AS texts FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY s, pos, stars NULLS FIRST, text) AS rn FROM (SELECT *, coalesce(stars, 5) AS s FROM v_reviews)) WHERE rn <= 6 GROUP BY lead_id)"
_TEXT = " || chr(10) || ".join(f"concat('{k}: ', {v})" for k, v in _FACTS.items())


def _prompts(spark, sf_dir):
    lists = records.review_lists(view(spark, sf_dir, "reviews")).select("lead_id", records.review_snippets(F.col("reviews")).alias("texts"))
    leads = view(spark, sf_dir, "leads").withColumn("social_linkedin", F.lit(None).cast("string")).join(lists, "lead_id", "left")
    age = F.greatest(F.lit(1), F.lit(2026) - F.col("year_founded"))
    tenths = F.when((F.col("google_review_count") > 0) & (F.col("year_founded") > 0), F.floor((F.col("google_review_count") * 20 + age) / (age * 2)))
    return sinks.prompt_table(leads, F.col("texts"), tenths.cast("long"))


@query(f"SELECT lead_id, {_TEXT} AS facts FROM v_leads LEFT JOIN {_SNIPPETS} USING (lead_id)")
def f24_prompt_facts(spark, sf_dir):
    return _prompts(spark, sf_dir).select("lead_id", "facts")


@query(f"SELECT lead_id, concat({_TEXT.replace('nullif(texts', 'nullif(NULL').replace(f'CAST(CAST({_T10} AS BIGINT) AS VARCHAR)', 'NULL')}, chr(10), 'page_text: ', CASE WHEN lead_id % 2 = 0 THEN repeat('ab ', 1000) || repeat('cd', 1000) ELSE '(website text unavailable)' END, chr(10), 'competitors: ', CASE WHEN lead_id % 3 = 0 THEN 'Acme' ELSE '(none)' END) AS facts FROM v_leads")
def f24_dossier_facts(spark, sf_dir):
    k = F.col("lead_id")
    leads = view(spark, sf_dir, "leads").withColumn("social_linkedin", F.lit(None).cast("string"))
    text = F.when(k % 2 == 0, F.concat(F.repeat(F.lit("ab "), F.lit(1000)), F.repeat(F.lit("cd"), F.lit(2000))))
    return sinks.dossier_facts(leads, text, F.when(k % 3 == 0, "Acme")).select("lead_id", "facts")


@query("SELECT lead_id, concat('{\"opener\": \"Hello ', name, '\"}') AS reply FROM v_leads")
def g3_model_replies(spark, sf_dir):
    def greet(prompts):
        return ['{"opener": "Hello %s"}' % p.split("\n")[0].removeprefix("name: ") for p in prompts]

    return sinks.ask(_prompts(spark, sf_dir), greet).select("lead_id", "reply")


@query(f"SELECT job_id, CASE category WHEN 'no_website' THEN 1 ELSE 2 END AS section, CAST(row_number() OVER (PARTITION BY job_id, category ORDER BY lead_score DESC, ord) AS INT) AS place, lead_id FROM {LABELLED}")
def s12_report_sections(spark, sf_dir):
    return sinks.report_sections(labelled(spark, sf_dir))


@query(f"SELECT lead_id, job_id, CASE WHEN job_id IN (1, 2) THEN 7 ELSE lead_score END AS lead_score FROM {SCORED} WHERE NOT (job_id = 2 AND lead_id % 2 = 0)")
def s10_replace_jobs(spark, sf_dir):
    path = sinks.scratch(spark, "leads")
    leads = scored(spark, sf_dir).select("lead_id", "lead_score", "job_id")
    sinks.replace_jobs(leads, path)
    again = leads.where("job_id in (1, 2) and not (job_id = 2 and lead_id % 2 = 0)").withColumn("lead_score", F.lit(7).cast(leads.schema["lead_score"].dataType))
    for _ in range(2):
        sinks.replace_jobs(again, path)
    return spark.read.schema(leads.schema).parquet(path)


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand || ' LLC'), '[^a-z0-9 ]', '', 'g')) AS spaced FROM part")
def f2_spaced_names(spark, sf_dir):
    from bizlink.functions.identity import spaced_name

    return table(spark, sf_dir, "part").select("p_partkey", spaced_name(F.concat("p_name", F.lit(" & "), "p_brand", F.lit(" LLC"))).alias("spaced"))


@query()
def f4_f5_name_ratios(spark, sf_dir):
    from bizlink.functions.fuzzy import best_ratio_udf, partial_udf, ratio_udf, sorted_ratio_udf

    a, b = F.col("p_name"), F.concat(F.reverse(F.split("p_name", " "))[0], F.lit(" "), "p_type")
    pairs = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", a.alias("a"), b.alias("b"))
    return pairs.select("p_partkey", *(f()("a", "b").alias(n) for n, f in (("indel", ratio_udf), ("sorted", sorted_ratio_udf), ("partial", partial_udf), ("best", best_ratio_udf))))


@query("SELECT source, count(*) AS n FROM v_listings GROUP BY source")
def g5_observed_sources(spark, sf_dir):
    """Rows by source, read from the metrics that gathering reports about each."""
    from pyspark.sql import Observation

    from bizlink.sources.listings import Registry

    every = view(spark, sf_dir, "listings")
    found = []
    for name in ("google_maps", "hotfrog", "npi"):
        seen = Observation(name)
        Registry({name: lambda name=name: every.where(F.col("source") == name)}, [name]).gather(spark, on_progress=seen).write.format("noop").mode("overwrite").save()
        found.append((name, seen.get["rows"]))
    return spark.createDataFrame(found, "source string, n long")


@query("SELECT lead_id, CASE WHEN planned THEN lead_id % 2 = 0 ELSE has_google_maps END AS has_google_maps, CASE WHEN planned THEN CASE WHEN lead_id % 2 = 0 THEN 4.5 END ELSE google_rating END AS google_rating FROM (SELECT *, NOT has_google_maps AND NOT (phone IS NOT NULL AND contains(sources, 'npi')) AS planned FROM v_leads)")
def j6_apply_enrichment(spark, sf_dir):
    from bizlink.functions.scoring import needs_maps

    leads = view(spark, sf_dir, "leads")
    planned = leads.where(needs_maps()).select("lead_id")
    results = planned.select("lead_id", (F.col("lead_id") % 2 == 0).alias("has_google_maps"), F.when(F.col("lead_id") % 2 == 0, 4.5).alias("google_rating"))
    out = lookups.apply_planned(leads, planned, results, ["has_google_maps", "google_rating"])
    return out.select("lead_id", F.coalesce("has_google_maps", F.lit(False)).alias("has_google_maps"), "google_rating")


@query("SELECT lead_id, CASE WHEN hundredths >= 35 THEN e164 END AS owner_phone FROM (SELECT lead_id, concat('+1213555', CAST(1000 + lead_id AS VARCHAR)) AS e164, CASE WHEN lead_id % 2 = 0 THEN 40 ELSE 0 END + CASE WHEN lead_id % 3 = 0 THEN 30 ELSE 0 END + 20 + CASE WHEN lead_id % 5 = 0 THEN 15 ELSE 0 END - CASE WHEN lead_id % 7 = 0 THEN 10 ELSE 0 END AS hundredths FROM v_leads)")
def f11_a15_owner_phone(spark, sf_dir):
    from bizlink.functions.contact import owner_hundredths

    k = F.col("lead_id")
    phone = F.concat(F.lit("+1213555"), (1000 + k).cast("string"))
    context = F.concat(F.when(k % 5 == 0, "cell ").otherwise(""), F.when(k % 7 == 0, "office").otherwise(""))
    points = owner_hundredths(k % 2 == 0, F.when(k % 3 == 0, "mobile").otherwise("fixed_line"), phone, F.lit("+12125550100"), context, F.lit(""))
    cands = view(spark, sf_dir, "leads").select("lead_id", F.lit(1).alias("ord"), phone.alias("e164"), points.alias("hundredths"), F.lit("+12125550100").alias("business"))
    again = cands.withColumn("ord", F.lit(2)).withColumn("hundredths", F.lit(99))
    return lookups.owner_phone(cands.unionByName(again)).select("lead_id", "owner_phone")


@query("SELECT lead_id, arg_max(d, length(d) * 10 - ord) AS description FROM (SELECT cluster AS lead_id, ord, description AS d FROM v_listings WHERE description IS NOT NULL) GROUP BY lead_id")
def a17_longest_description(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").where("description is not null")
    return rows.groupBy(F.col("cluster").alias("lead_id")).agg(F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"))


@query("SELECT user_id, CAST(max(d) AS VARCHAR) AS last_active, count(DISTINCT d) AS posts FROM (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS d FROM events) GROUP BY user_id")
def a16_x9_recent_activity(spark, sf_dir):
    text = F.concat(F.lit("posted "), F.date_format("ts", "MMMM d, yyyy"), F.lit(" and "), F.date_format("ts", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "events").select("user_id", sinks.dates_in(text).alias("dates"))
    each = rows.select("user_id", F.explode("dates").alias("d"))
    return each.groupBy("user_id").agg(F.max("d").cast("string").alias("last_active"), F.count_distinct("d").alias("posts"))


@query("SELECT page_id, unnest([url, url || '/about']) AS loc FROM pages")
def x12_sitemap(spark, sf_dir):
    from bizlink.functions.pages import sitemap_locations

    xml = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit("</loc></url><url><LOC>"), "url", F.lit("/about</LOC></url></urlset>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(sitemap_locations(xml)).alias("loc"))


def page_structure(spark, sf_dir):
    from bizlink.sources.html import parse_pages

    return parse_pages(table(spark, sf_dir, "pages")).select("page_id", F.size("services").alias("n_services"), F.size("partners").alias("n_partners"), F.size("team").alias("n_team"), F.md5("text").alias("text_md5"), "summary", "owner_title", F.array_join("post_titles", "|").alias("titles"), F.size("cards").alias("n_cards"), F.col("detail.name").alias("detail_name"))


@query()
def x3_x8_s6_page_structure(spark, sf_dir):
    return page_structure(spark, sf_dir)


@query()
def x13_lead_rollup(spark, sf_dir):
    from bizlink.functions.identity import host
    from bizlink.sources.html import parse_pages, roll_up

    return roll_up(parse_pages(table(spark, sf_dir, "pages").withColumn("domain", host(F.col("url")))), "domain", 8)


@query()
def x13_contact_roll_up(spark, sf_dir):
    from bizlink.functions.identity import host
    from bizlink.functions.pages import CONTACT_PATHS
    from bizlink.sources.html import contact_roll_up

    k = F.col("page_id")
    path = F.get(F.array(*(F.lit(p) for p in ("/", *CONTACT_PATHS, "/find/us"))), (F.floor(k / 7) % 21).cast("int"))
    site = F.concat_ws("-", host(F.col("url")), F.floor(k / 150).cast("string"))
    html = F.concat("html", F.when(k % 5 == 0, F.concat(F.lit("<p>jo.doe"), k.cast("string"), F.lit("@acme.com</p>"))).when(k % 5 == 1, "<p>info@acme.com</p>").otherwise(""), F.when(k % 4 == 0, "<p>Founded by Ann Lee.</p>").otherwise(""))
    pages = table(spark, sf_dir, "pages").select(site.alias("lead"), F.concat(F.lit("https://acme.com"), path).alias("url"), html.alias("html"), F.lit("acme.com").alias("domain"))
    return contact_roll_up(pages, "lead", "domain").select("lead", "pages", "owner", "best_email")


#: Which listings of a business meet (g, h, n: full, shorter and third name), and where each ends up.
_MEET = """SELECT ord, c, source, name, phone, address, c % 7 <> 0 AS h, c % 5 <> 1 AS n,
 (c % 4 <> 0 AND c % 3 <> 0) OR c % 5 <> 0 AS gh, c % 4 <> 0 OR c % 2 = 1 AS gn, c % 3 <> 0 OR c % 2 = 1 AS hn FROM v_businesses"""
CLOSURE = f"""SELECT *, CASE source WHEN 'google_maps' THEN 1 WHEN 'hotfrog' THEN CASE WHEN gh OR (n AND gn AND hn) THEN 1 ELSE 2 END
 ELSE CASE WHEN gn OR (h AND gh AND hn) THEN 1 WHEN h AND hn THEN CASE WHEN gh THEN 1 ELSE 2 END ELSE 3 END END * CAST(1000000000 AS BIGINT) + c AS cluster FROM ({_MEET})"""
FIRST = f"""SELECT *, CASE source WHEN 'google_maps' THEN 1 WHEN 'hotfrog' THEN CASE WHEN gh THEN 1 ELSE 2 END
 ELSE CASE WHEN gn OR (h AND gh AND c % 3 <> 0) THEN 1 WHEN h AND NOT gh AND hn THEN 2 ELSE 3 END END * CAST(1000000000 AS BIGINT) + c AS cluster FROM ({_MEET})"""


@query("SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT lower(g.name) AS x, replace(lower(h.name), ' llc', '') AS y FROM v_businesses g JOIN v_businesses h ON g.c = h.c AND g.source = 'google_maps' AND h.source = 'hotfrog')")
def j1_similar_names(spark, sf_dir):
    from bizlink.functions.identity import normalize_name

    return linkage.similar_names(view(spark, sf_dir, "businesses", "c_custkey").select(normalize_name(F.col("name")).alias("name")))


@query(f"SELECT ord AS id, cluster FROM ({CLOSURE})")
def j2_resolve(spark, sf_dir):
    return linkage.resolve(view(spark, sf_dir, "businesses", "c_custkey").withColumnRenamed("ord", "id")).select("id", "cluster")


@query(f"SELECT ord, cluster FROM ({FIRST})")
def j2_first_match(spark, sf_dir):
    from bizlink.operators.greedy import greedy_clusters

    return greedy_clusters(view(spark, sf_dir, "businesses", "c_custkey")).select("ord", "cluster")


@query()
def j5_best_place(spark, sf_dir):
    leads = view(spark, sf_dir, "leads")
    tries = leads.select("lead_id", F.col("name").alias("target_name"), F.explode(F.array(*(F.struct(F.lit(i).alias("cand_ord"), F.concat(F.lit(f"https://g/maps/place/{i}-"), F.col("lead_id").cast("string")).alias("href"), n.alias("cand_name")) for i, n in enumerate((F.reverse("name"), F.concat("name", F.lit(" Shop")), F.lit("Other Place")))))).alias("c"), "google_rating", "google_review_count")
    return linkage.best_place(leads, tries.select("lead_id", "target_name", "c.*", F.col("google_rating").alias("rating"), F.col("google_review_count").alias("reviews")))


_SHOWN = "lead_id job_id category name lead_score phone_verified owner_name owner_phone owner_email website website_cms has_ssl website_name_found google_rating google_review_count address social_facebook social_instagram sources description employee_count year_founded partners services owner_title review_weakness_count external_platforms marketing_stack".split()


@query(f"SELECT {', '.join(_SHOWN)} FROM {LABELLED}")
def s10_s11_export_views(spark, sf_dir):
    path = sinks.scratch(spark, "export")
    sinks.write_partitioned(sinks.export_view(labelled(spark, sf_dir)), path, ["category"])
    return spark.read.parquet(path).select(*_SHOWN)


@query("SELECT p_partkey, CAST(greatest(1, least(5, round_even((p_partkey % 11) / 2.0, 0))) AS INT) AS stars FROM part UNION ALL SELECT -p_partkey, NULL FROM part")
def f18_stars(spark, sf_dir):
    k = F.col("p_partkey")
    half = F.concat(F.floor(k % 11 / 2).cast("string"), F.when(k % 11 % 2 == 1, ".5").otherwise(""))
    label = F.when(k % 2 == 0, F.concat(half, F.lit(" stars"))).otherwise(F.concat(F.lit("Rated "), half, F.lit(" out of 5")))
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", records.stars_of(label).alias("stars")).unionByName(part.select((-k).alias("p_partkey"), records.stars_of(F.lit("no rating")).alias("stars")))


def _business_page():
    k, seg = F.col("lead_id"), F.col("business_category")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    json_ld = text('<script type="application/ld+json">{"@graph":[{"@type":"Service","name":"', seg, ' repair"},{"x":{"@type":"Product","name":"', seg, ' parts"}}]}</script>')
    listed = text("<section><h2>Our Services</h2><ul><li>", seg, " repair<li>", seg, " cleaning</ul></section>")
    told = text("<p>We offer ", seg, " repair, ", seg, " cleaning and ", seg, " care. We are good.</p>")
    image = text('<div>Our partners <img alt="Acme ', k.cast("string"), ' Gold"></div>')
    item = text("<ul><li>Certified by Globex ", k.cast("string"), " Systems</ul>")
    cards = '<div class="team-card"><h3>Ann Smith</h3><p>Co-Founder</div><div class="team-card"><h3>Bob Stone</h3><p>Roofer</div>'
    return F.concat(
        F.when(k % 3 == 0, json_ld).when(k % 3 == 1, listed).otherwise(told), F.when(k % 4 == 0, image).when(k % 4 == 1, item).otherwise(""),
        F.when(k % 5 == 0, cards).when(k % 5 == 1, "<p>Eve Hill — General Manager, here</p>").otherwise(""),
    )


@query("""SELECT lead_id, concat(business_category, ' repair|', business_category, CASE lead_id % 3 WHEN 0 THEN ' parts' WHEN 1 THEN ' cleaning' ELSE concat(' cleaning|', business_category, ' care') END) AS services,
 CASE lead_id % 4 WHEN 0 THEN concat('Acme ', lead_id, ' Gold') WHEN 1 THEN concat('Certified by Globex ', lead_id, ' Systems') ELSE '' END AS partners,
 CASE lead_id % 5 WHEN 0 THEN 'Ann Smith:Co-Founder|Bob Stone:Roofer' WHEN 1 THEN 'Eve Hill:General Manager' ELSE '' END AS team, CASE lead_id % 5 WHEN 0 THEN 'Co-Founder' WHEN 1 THEN 'General Manager' END AS owner_title FROM v_leads""")
def x6_x8_business_pages(spark, sf_dir):
    from bizlink.sources.html import parse_pages

    people = F.transform("team", lambda p: F.concat_ws(":", p["name"], p["title"]))
    parsed = parse_pages(spread(view(spark, sf_dir, "leads"), "lead_id").select("lead_id", _business_page().alias("html")))
    return parsed.select("lead_id", F.array_join("services", "|").alias("services"), F.array_join("partners", "|").alias("partners"), F.array_join(people, "|").alias("team"), "owner_title")


@query("SELECT lead_id, CAST(1 + lead_id % 3 AS INT) AS n_cards, name, concat('555-', lead_id) AS phone, concat(lead_id, ' Main St') AS address, concat('/company/', lead_id, '/x') AS url FROM v_leads")
def s6_listing_cards(spark, sf_dir):
    from bizlink.sources.html import parse_pages

    k = F.col("lead_id").cast("string")
    card = F.concat(F.lit('<div class="hf-box"><h3><a href="/company/'), k, F.lit('/x">'), F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit('</a></h3><a href="tel:1">555-'), k, F.lit('</a><span class="small">Claim this</span><span class="small">'), k, F.lit(" Main St</span></div>"))
    pages = spread(view(spark, sf_dir, "leads"), "lead_id").select("lead_id", F.repeat(card, (1 + F.col("lead_id") % 3).cast("int")).alias("html"))
    first = F.col("cards")[0]
    return parse_pages(pages).select("lead_id", F.size("cards").alias("n_cards"), *(first[c].alias(c) for c in ("name", "phone", "address", "url")))


@query(f"SELECT job_id, count(*) AS exported, CAST(min(lead_score) AS INT) AS lo, CAST(max(lead_score) AS INT) AS hi, job_id * 3 AS scraped, job_id * 2 AS verified, 'leads.csv' AS file FROM {SCORED} GROUP BY job_id")
def s13_manifest(spark, sf_dir):
    jobs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("job_id"), F.col("n_name").alias("niche"), F.lit("Bend, OR").alias("location"), (F.col("n_nationkey") * 3).cast("long").alias("total_scraped"), (F.col("n_nationkey") * 2).cast("long").alias("total_verified"))
    made = sinks.manifests(scored(spark, sf_dir), jobs, {"csv": "leads.csv"})
    j = F.col("manifest")
    return made.select("job_id", F.get_json_object(j, "$.exported").cast("long").alias("exported"), F.get_json_object(j, "$.lead_score.min").cast("int").alias("lo"), F.get_json_object(j, "$.lead_score.max").cast("int").alias("hi"), F.get_json_object(j, "$.counts.total_scraped").cast("long").alias("scraped"), F.get_json_object(j, "$.counts.total_verified").cast("long").alias("verified"), F.get_json_object(j, "$.files.csv").alias("file"))


@query("SELECT name, phone, source FROM (SELECT *, row_number() OVER (PARTITION BY name, phone ORDER BY ord, cluster) AS rn FROM v_listings) WHERE rn = 1")
def s14_batch_csv(spark, sf_dir):
    rows = first_by(view(spark, sf_dir, "listings"), ["name", "phone"], [F.col("ord"), F.col("cluster")]).select("name", "phone", "source")
    path = sinks.scratch(spark, "csv")
    rows.write.option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)
    return spark.read.schema("name string, phone string, source string").option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path).fillna("", ["phone"])


@query("SELECT job_id, concat(niche, '_', CASE location WHEN 'Bend, OR' THEN 'Bend_OR' WHEN 'Madison, Wisconsin' THEN 'Madison_Wisconsin' ELSE 'Boise' END, '_leads') AS base FROM v_jobs")
def s17_file_names(spark, sf_dir):
    return view(spark, sf_dir, "jobs").select("job_id", F.concat_ws("_", slug(F.col("niche")), slug(F.col("location")), F.lit("leads")).alias("base"))


@query(f"SELECT lead_id, job_id FROM {SCORED} WHERE job_id NOT IN (3, 7)")
def s19_delete_jobs(spark, sf_dir):
    from bizlink.plans.views import table as _table

    gone = _table(spark, sf_dir, "nation").where("n_nationkey in (3, 7)").select(F.col("n_nationkey").alias("job_id"))
    return sinks.without_jobs(scored(spark, sf_dir), gone).select("lead_id", "job_id")


@query("SELECT l_orderkey % 50 AS stratum, count(*) AS checked, floor((count(*) FILTER (l_returnflag = 'A') * 2000 + count(*)) / (count(*) * 2)) / 10 AS correct_pct FROM lineitem WHERE substring(md5(concat(l_orderkey, '-', l_linenumber)), 1, 1) IN ('0', '1') GROUP BY 1")
def a18_accuracy_sample(spark, sf_dir):
    sample = table(spark, sf_dir, "lineitem").where(F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")), 1, 1).isin("0", "1"))
    n, ok = F.count("*"), F.count_if(F.col("l_returnflag") == "A")
    return sample.groupBy((F.col("l_orderkey") % 50).alias("stratum")).agg(n.alias("checked"), (F.floor((ok * 2000 + n) / (n * 2)) / 10).cast("double").alias("correct_pct"))
