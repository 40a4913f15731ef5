"""Queries over contact channels, pages and verdict tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlink.functions import contact as C
from bizlink.functions import identity as I
from bizlink.functions import pages as P
from bizlink.functions.places import parse_location, taxonomy_term
from bizlink.operators import lookups
from bizlink.operators.select import first_by
from bizlink.plans.registry import query
from bizlink.plans.views import table, view

_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_LOC = lambda e: f"split_part({e}, '@', 1)"
_DOM = lambda e: f"split_part({e}, '@', 2)"
_NORM = lambda e: f"regexp_replace(regexp_replace(lower(trim({e})), '^\\.+|\\.+$', '', 'g'), '^([^@]*)@www\\.([^@]*)$', '\\1@\\2')"
_END = lambda e: f"split_part({_DOM(e)}, '.', -1)"
_JUNK = lambda e: (
    f"({_LOC(e)} = '' OR NOT regexp_full_match({_DOM(e)}, '[^.]+(\\.[^.]+)+') OR {_DOM(e)} IN {_IN(C.PLACEHOLDER_DOMAINS)} OR {_LOC(e)} IN {_IN(C.PLACEHOLDER_LOCALS)} OR regexp_matches({_LOC(e)}, '^[a-f0-9]{{16,}}$') OR regexp_matches({e}, '@[0-9]x$') "
    f"OR contains({_DOM(e)}, 'sentry') OR contains({_DOM(e)}, 'ingest') OR (contains({_LOC(e)}, '.') AND split_part({_LOC(e)}, '.', 1) IN {_IN(C.ASSET_HOSTS)}) OR {_END(e)} IN {_IN(C.ASSET_ENDINGS)} OR {_END(e)} IN {_IN(C.SCRIPT_WORDS)} OR (length({_END(e)}) <> 2 AND {_END(e)} NOT IN {_IN(C.LONG_ENDINGS)}))"
)
_SCORE = lambda e, d: (
    f"CASE WHEN lower({_DOM(e)}) IN {_IN(C.GENERIC_DOMAINS)} THEN 10 ELSE CASE WHEN regexp_matches(lower({_LOC(e)}), '^[a-z][a-z.]+[a-z]$') AND length({_LOC(e)}) >= 4 THEN CASE WHEN contains({_LOC(e)}, '.') THEN 80 ELSE 60 END "
    f"WHEN lower({_LOC(e)}) IN {_IN(C.ROLE_PARTS)} THEN 30 WHEN length({_LOC(e)}) <= 3 THEN 20 ELSE 40 END + CASE WHEN {d} <> '' AND contains(lower({_DOM(e)}), {d}) THEN 20 ELSE 0 END END"
)


#: The spelled form without look-behind and possessive parts, which the SQL's engine lacks.
_SPELLED = r"(?i)([a-zA-Z0-9._%+\-]+\s*\[?\s*(?:at|@)\s*\]?\s*[a-zA-Z0-9.\-]+\s*\[?\s*(?:dot|\.)\s*\]?\s*[a-zA-Z]{2,})"


#: Documents with addresses that end as real ones do, some spelled in words.
_MAILS = "concat(replace(text, '.example.com', '.biz.com'), CASE doc_id % 3 WHEN 0 THEN concat(' write to joe', CAST(doc_id AS STRING), ' [at] acme [dot] plumbing') ELSE '' END)"
_RAW = f"regexp_extract(t, '{_SPELLED}', 1)"
_PLAIN = f"trim(trim(regexp_replace(regexp_replace({_RAW}, '\\s*\\[?\\s*(?:at|@)\\s*\\]?\\s*', '@'), '\\s*\\[?\\s*(?:dot|\\.)\\s*\\]?\\s*', '.', 'g')), '[]()')"


@query(f"SELECT DISTINCT doc_id, email FROM (SELECT doc_id, unnest(list_append(list_transform(regexp_extract_all(t, '{C.EMAIL}'), lambda e: {_NORM('e')}), CASE WHEN regexp_matches({_PLAIN}, '^{C.EMAIL}') THEN {_NORM(_PLAIN)} END)) AS email FROM (SELECT doc_id, {_MAILS} AS t FROM documents)) WHERE email IS NOT NULL AND NOT {_JUNK('email')}")
def f13_email_harvest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.replace(F.col("text"), F.lit(".example.com"), F.lit(".biz.com")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" write to joe"), F.col("doc_id").cast("string"), F.lit(" [at] acme [dot] plumbing"))).otherwise(""))
    return docs.select("doc_id", F.explode(C.harvest_emails(text)).alias("email"))


@query(f"SELECT lead_id, ord, regexp_matches(email, '^{C.EMAIL}$') AS ok, {_SCORE('email', 'domain')} AS score FROM v_emails")
def f12_f14_email_scores(spark, sf_dir):
    return view(spark, sf_dir, "emails").select("lead_id", "ord", C.email_ok(F.col("email")).alias("ok"), C.email_score(F.col("email"), F.col("domain")).alias("score"))


@query(f"SELECT lead_id, email, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'fallback' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY score DESC, email) AS rn FROM (SELECT lead_id, email, {_SCORE('email', 'domain')} AS score FROM v_emails)) WHERE rn = 1")
def a14_best_email(spark, sf_dir):
    return lookups.best_email(view(spark, sf_dir, "emails"))


_PH = "(SELECT lead_id, ord, phone || CASE lead_id % 3 WHEN 0 THEN ' ext 12' WHEN 1 THEN '' ELSE ' x9' END AS raw FROM v_leads UNION ALL SELECT lead_id, -1, concat('+1 (', CAST(100 + lead_id % 800 AS STRING), ') 234-5678') FROM v_leads)"
_DIG = "regexp_replace(regexp_replace(raw, '(?i)\\s*(?:ext|x|#).*$', ''), '\\D', '', 'g')"
_TEN0 = f"CASE WHEN length({_DIG}) = 11 AND {_DIG} LIKE '1%' THEN right({_DIG}, 10) WHEN length({_DIG}) = 10 THEN {_DIG} END"
_TEN = f"CASE WHEN regexp_matches({_TEN0}, '^[2-9]\\d{{2}}[2-9]\\d{{6}}$') THEN {_TEN0} END"
_STATE = "CASE substring(ten, 1, 3) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookups.AREA_CODES.items()) + " END"


@query(f"SELECT lead_id, ord, ten IS NOT NULL AS valid, CASE WHEN ten IS NULL THEN 'unknown' WHEN substring(ten, 1, 3) IN {_IN(C.TOLL_FREE)} THEN 'toll_free' ELSE 'fixed_line_or_mobile' END AS kind, concat('(' || substring(ten, 1, 3), ') ' || substring(ten, 4, 3), '-' || substring(ten, 7, 4)) AS national, {_STATE} AS area_code, CASE WHEN ten IS NULL THEN 0 ELSE 5 + CASE WHEN substring(ten, 1, 3) IN {_IN(C.TOLL_FREE)} THEN 3 ELSE 0 END + CASE WHEN {_STATE} IS NOT NULL THEN 2 ELSE 0 END END AS score FROM (SELECT *, {_TEN} AS ten FROM {_PH} WHERE raw IS NOT NULL) ".replace("concat('(' || substring(ten, 1, 3), ') ' || substring(ten, 4, 3), '-' || substring(ten, 7, 4))", "'(' || substring(ten, 1, 3) || ') ' || substring(ten, 4, 3) || '-' || substring(ten, 7, 4)"))
def f8_f9_j7_phone_verdict(spark, sf_dir):
    leads = view(spark, sf_dir, "leads")
    k = F.col("lead_id") % 3
    a = leads.select("lead_id", "ord", F.concat("phone", F.when(k == 0, " ext 12").when(k == 1, "").otherwise(" x9")).alias("raw"))
    b = leads.select("lead_id", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("+1 ("), (100 + F.col("lead_id") % 800).cast("string"), F.lit(") 234-5678")).alias("raw"))
    rows = lookups.with_state(a.unionByName(b).where("raw is not null").withColumn("ten", C.nanp(F.col("raw"))))
    return rows.select("lead_id", "ord", *(v.alias(n) for n, v in C.phone_verdict(F.col("raw"), F.col("state")).items()))


@query("SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND k = 0) AS mobile, CASE WHEN count(*) > 0 THEN floor((count(*) FILTER (ok) * 2000 + count(*)) / (count(*) * 2)) / 10 ELSE 0 END AS rate_pct FROM (SELECT phone_verified AS ok, lead_id % 4 AS k FROM v_leads)")
def a9_verify_stats(spark, sf_dir):
    return lookups.verify_stats(view(spark, sf_dir, "leads").select(F.col("phone_verified").alias("valid"), F.col("phone_type").alias("kind")))


_PHONE_DOC = r"(\+1 \(\d{3}\) \d{3}-\d{4})"


@query(f"SELECT doc_id, e164 FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{_PHONE_DOC}'), lambda p: concat('+', regexp_replace(p, '\\D', '', 'g'))))) AS e164 FROM documents) WHERE regexp_matches(e164, '^\\+1[2-9]\\d\\d[2-9]\\d{{6}}$')")
def f10_phone_harvest(spark, sf_dir):
    return lookups.harvest_phones(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "e164")


_VERDICT = "(SELECT lead_id, email, regexp_matches(email, '^" + C.EMAIL + "$') AS ok, lead_id % 4 <> 0 AS mx, CASE lead_id % 5 WHEN 0 THEN 250 WHEN 1 THEN 550 WHEN 2 THEN -1 WHEN 3 THEN NULL ELSE 450 END AS code, lead_id % 15 = 0 AS ca, lower(split_part(email, '@', 1)) AS l, lower(split_part(email, '@', 2)) AS d FROM v_emails)"


@query(f"SELECT lead_id, email, tier, tier IN ('verified', 'mx_only') AS verified, CASE WHEN NOT ok THEN 0 ELSE 2 + CASE WHEN mx THEN 3 ELSE 0 END + CASE WHEN tier = 'verified' THEN 3 WHEN asked THEN 1 ELSE 0 END + CASE WHEN d IN {_IN(C.GENERIC_DOMAINS)} THEN 0 ELSE 1 END + CASE WHEN l IN {_IN(C.ROLE_PARTS)} THEN 0 ELSE 1 END END AS score FROM (SELECT *, CASE WHEN asked AND code = 250 AND NOT ca THEN 'verified' WHEN asked AND code BETWEEN 500 AND 599 THEN 'undeliverable' WHEN asked AND code = 250 THEN 'catch_all' WHEN ok AND mx THEN 'mx_only' ELSE 'invalid' END AS tier FROM (SELECT *, ok AND mx AND coalesce(code <> -1, false) AS asked FROM {_VERDICT}))")
def j8_email_verdict(spark, sf_dir):
    emails = view(spark, sf_dir, "emails")
    k = F.col("lead_id")
    code = F.when(k % 5 == 0, 250).when(k % 5 == 1, 550).when(k % 5 == 2, -1).when(k % 5 == 4, 450)
    facts = emails.select("lead_id", "ord", (k % 4 != 0).alias("mx"), code.alias("code"), (k % 15 == 0).alias("catch_all"))
    joined = emails.join(facts, ["lead_id", "ord"], "left")
    v = C.email_verdict(F.col("email"), F.col("mx"), F.col("code"), F.col("catch_all"))
    return joined.select("lead_id", "email", v["tier"].alias("tier"), v["verified"].alias("verified"), v["score"].alias("score"))


@query("SELECT lead_id, CASE WHEN a IS NULL THEN NULL ELSE a = '12 main st, bend, or 97701' END AS address_valid FROM (SELECT lead_id, lower(trim(address)) AS a FROM v_leads)")
def j9_address_verdict(spark, sf_dir):
    leads = view(spark, sf_dir, "leads")
    geocoded = leads.select(lookups.address_key(F.col("address")).alias("address_key")).distinct().withColumn("matched", F.col("address_key").startswith("12 "))
    return lookups.address_verdict(leads.drop("address_valid"), geocoded).select("lead_id", "address_valid")


@query("SELECT lead_id, CAST(1990 + lead_id % 30 AS INT) AS registered, CASE WHEN lead_id % 2 = 0 THEN concat('+1.213555', CAST(1000 + lead_id AS STRING)) END AS registrant_tel FROM v_leads WHERE website IS NOT NULL")
def j10_domain_registration(spark, sf_dir):
    leads = view(spark, sf_dir, "leads").where("website is not null").withColumn("domain", I.host(F.col("website")))
    k = F.col("lead_id")
    role = F.when(k % 2 == 0, "registrant").otherwise("abuse")
    doc = F.concat(F.lit('{"events":[{"eventAction":"last changed","eventDate":"2024-01-01T00:00:00Z"},{"eventAction":"registration","eventDate":"'), (1990 + k % 30).cast("string"), F.lit('-05-01T00:00:00Z"}],"entities":[{"roles":["'), role, F.lit('"],"tel":"+1.213555'), (1000 + k).cast("string"), F.lit('"}]}'))
    return lookups.domain_registration(leads, leads.select("domain", doc.alias("json"))).select("lead_id", "registered", "registrant_tel")


@query("SELECT lead_id, CASE WHEN lead_id % 2 = 0 THEN concat('SOS ', name) WHEN lead_id % 3 = 0 THEN concat('SAM ', name) END AS legal_name, CASE WHEN lead_id % 2 = 0 THEN CASE lead_id % 4 WHEN 0 THEN 'active' ELSE 'dissolved' END WHEN lead_id % 3 = 0 THEN 'active' END AS entity_status, CASE WHEN lead_id % 2 = 0 THEN 'sos' WHEN lead_id % 3 = 0 THEN 'sam' END AS registry_source FROM v_leads")
def j11_registry_lookup(spark, sf_dir):
    leads = view(spark, sf_dir, "leads")
    k = F.col("lead_id")
    entry = lambda src, cond, status: leads.where(cond).select(F.lit(src).alias("source"), "name", F.concat(F.lit(src.upper() + " "), "name").alias("legal_name"), status.alias("status_raw"))
    registry = entry("sos", k % 2 == 0, F.when(k % 4 == 0, "Active/Compliance").otherwise("Forfeited")).unionByName(entry("sam", k % 3 == 0, F.lit("Inactive")))
    return lookups.registry_lookup(leads, registry, ["sos", "sam"]).select("lead_id", "legal_name", "entity_status", "registry_source")


@query("SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '') AS domain FROM pages")
def f7_domain_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", I.host(F.col("url")).alias("domain"))


@query("SELECT page_id, concat(regexp_extract(url, '^([^?#]*)', 1), CASE WHEN k <> '' THEN concat('?', k) ELSE '' END, regexp_extract(url, '(#.*)$', 1)) AS website FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^utm_|^gclid(=|$)')), '&') AS k FROM pages)")
def f6_canonical_website(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.canonical_website(F.col("url")).alias("website"))


_BARE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|iframe)[^>]*>.*?</(script|style|noscript|iframe)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_BARE}) AS text_md5 FROM pages")
def x1_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(P.visible_text(F.col("html"))).alias("text_md5"))


#: Pages with the marks the given ones lack, added by arithmetic; the same text in both engines.
MARKED = """(SELECT page_id, url, concat(html, CASE page_id % 6 WHEN 0 THEN '<script src="https://cdn.shopify.com/x.js"></script>' WHEN 1 THEN '<link href="/wp-content/a.css">' WHEN 2 THEN '<p>This domain is parked</p>' ELSE '' END,
 CASE page_id % 4 WHEN 0 THEN '<a href="https://www.facebook.com/Acme.Co/">f</a><script>fbq("init")</script>' WHEN 1 THEN '<a href="https://instagram.com/acme_1">i</a> <a href="https://www.doordash.com/store">d</a>' WHEN 2 THEN '<iframe src="https://toasttab.com/x"></iframe>' ELSE '' END,
 CASE page_id % 5 WHEN 0 THEN '<p>Founded in 1987, serving since 1991. Established in 2001.</p>' WHEN 1 THEN '<p>Team of 42 people</p>' WHEN 2 THEN '<script type="application/ld+json">{{"name":"Acme","numberOfEmployees":17,"foundingDate":"1979-01-01"}}</script>' WHEN 3 THEN concat('<script type="application/ld+json">[{{"a":1}},{{"description":"A shop with a long history, number ', CAST(page_id AS STRING), '"}}]</script>') ELSE '<footer>Copyright © 1999-2024 Acme. We employ about 300.</footer>' END,
 CASE page_id % 7 WHEN 0 THEN '<meta name="description" content="A family business for all kinds of roofs">' WHEN 1 THEN '<p>Founded by John Smith.</p>' WHEN 2 THEN '<p>Posted March 15, 2024 and 2024-06-01</p>' ELSE '' END) AS html,
 CAST(CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 429 ELSE 200 END AS INT) AS code FROM {pages})"""
_MARKED = MARKED.format(pages="pages").replace("{{", "{").replace("}}", "}")


def marked(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {MARKED}", pages=table(spark, sf_dir, "pages"))


_ANY = lambda words, text: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(f"SELECT page_id, {_ANY(P.PARKED, 'lower(html)')} AS parked, CASE WHEN code < 400 THEN CASE WHEN {_ANY(P.PARKED, 'lower(html)')} THEN 'dead' ELSE 'active' END WHEN code = 429 THEN 'active' ELSE 'dead' END AS status, CASE WHEN coalesce(html, '') = '' OR {_ANY(P.CHALLENGES, 'lower(substring(html, 1, 4000))')} OR code IN (401, 403, 429) THEN 'blocked' WHEN code >= 500 THEN 'target_down' WHEN code >= 400 THEN 'reject' ELSE 'ok' END AS outcome FROM (SELECT page_id, url, code, CASE page_id % 50 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE html END AS html FROM {_MARKED})")
def p11_p13_page_status(spark, sf_dir):
    html, code = F.col("html"), F.col("code")
    some = F.when(F.col("page_id") % 50 == 0, "").when(F.col("page_id") % 50 != 1, html)
    return marked(spark, sf_dir).withColumn("html", some).select("page_id", P.is_parked(html).alias("parked"), P.site_status(code, html, F.col("url")).alias("status"), P.fetch_outcome(code, html).alias("outcome"))


_PATH = "lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1))"


@query(f"SELECT page_id, CASE WHEN {_PATH} IN ('', '/') THEN 'home' " + " ".join(f"WHEN {_ANY(P.PAGE_WORDS[k], _PATH)} THEN '{k}'" for k in P.PATHS) + f" WHEN rtrim({_PATH}, '/') IN {_IN(P.CONTACT_PATHS)} THEN 'contact' ELSE 'other' END AS kind, {_ANY(P.SITEMAP_WORDS, _PATH)} AS relevant, CASE WHEN rtrim({_PATH}, '/') = '' THEN 0 ELSE list_position({_LIST(P.CONTACT_PATHS)}, rtrim({_PATH}, '/')) END AS contact_order FROM pages")
def p14_page_kind(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", P.page_kind(url).alias("kind"), P.sitemap_relevant(url).alias("relevant"), P.path_order(url, P.CONTACT_PATHS).alias("contact_order"))


_LAB = lambda marks: "list_filter([" + ", ".join(f"CASE WHEN contains(lower(html), '{m}') THEN '{n}' END" for m, n in marks.items()) + "], lambda x: x IS NOT NULL)"
_CMSQ = "CASE " + " ".join(f"WHEN {_ANY([x.lower() for x in m], 'lower(html)')} THEN '{n}'" for n, m in P.CMS.items()) + " END"
_DED = lambda marks: f"array_to_string(list_filter({_LAB(marks)}, lambda x, i: list_position({_LAB(marks)}, x) = i), ',')"


@query(f"SELECT page_id, {_CMSQ} AS cms, {_DED(P.PLATFORMS)} AS platforms, {_ANY(P.DIRECT, 'lower(html)')} AS has_direct, {_DED(P.AD_TAGS)} AS ad_stack, list_has_any({_LAB(P.AD_TAGS)}, {_LIST(P.PAID)}) AS paid_ads FROM {_MARKED}")
def j15_x11_signatures(spark, sf_dir):
    html = F.col("html")
    ads = P.labels_in(html, P.AD_TAGS)
    return marked(spark, sf_dir).select("page_id", P.cms_of(html).alias("cms"), F.array_join(P.labels_in(html, P.PLATFORMS), ",").alias("platforms"), P.contains_any(F.lower(html), P.DIRECT).alias("has_direct"), F.array_join(ads, ",").alias("ad_stack"), F.arrays_overlap(ads, F.array(*(F.lit(x) for x in P.PAID))).alias("paid_ads"))


@query(f"SELECT page_id, " + ", ".join(f"nullif(regexp_replace(regexp_extract(html, '(?i)({p})', 1), '/+$', ''), '') AS {s}" for s, p in P.SOCIAL.items()) + f" FROM {_MARKED}")
def x10_social_links(spark, sf_dir):
    return marked(spark, sf_dir).select("page_id", *(P.social_link(F.col("html"), s).alias(s) for s in P.SOCIAL))


_SQ = lambda p: p.replace("'", "''")
_INT = lambda p: f"TRY_CAST(regexp_extract(html, '{_SQ(p)}', 1) AS INT)"
_YEARS = "list_sort(list_filter(list_transform(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(html, '{p}', 1)" for p in P.FOUNDED[:2]) + "), list_concat(" + ", ".join(f"regexp_extract_all(html, '{p}', 1)" for p in P.FOUNDED[2:]) + ")), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 1700 AND 2025))"


@query(f"SELECT page_id, CASE WHEN f BETWEEN 1700 AND 2026 THEN f END AS founded FROM (SELECT page_id, coalesce({_INT(P.FOUNDED_SCHEMA)}, y[len(y) // 2 + 1], {_INT(P.COPYRIGHT_RANGE)}, CASE WHEN page_id % 3 = 0 THEN 2011 END) AS f FROM (SELECT page_id, html, {_YEARS} AS y FROM {_MARKED}))")
def a12_x5_year_founded(spark, sf_dir):
    domain = F.when(F.col("page_id") % 3 == 0, 2011)
    return marked(spark, sf_dir).select("page_id", P.year_founded(F.col("html"), 2026, domain).alias("founded"))


_EMP = "coalesce(" + ", ".join([_INT(p) for p in (P.STAFF_SCHEMA, *P.STAFF_ITEM)] + [f"CASE WHEN {_INT(p)} BETWEEN 1 AND 50000 THEN {_INT(p)} END" for p in P.STAFF]) + ")"
_DESC = "trim(regexp_extract(html, '(?i)<meta\\s+(?:name|property)=\"description\"\\s+content=\"([^\"]*)\"', 1))"


@query(f"SELECT page_id, CASE WHEN e BETWEEN 1 AND 50000 THEN e END AS staff, CASE WHEN length(d) > 20 THEN d END AS description, CASE WHEN page_id % 5 = 3 THEN concat('A shop with a long history, number ', page_id) END AS schema_description FROM (SELECT page_id, {_EMP} AS e, {_DESC} AS d FROM {_MARKED})")
def x2_x4_page_facts(spark, sf_dir):
    html = F.col("html")
    return marked(spark, sf_dir).select("page_id", P.employee_count(html).alias("staff"), P.meta_description(html).alias("description"), P.schema_description(html).alias("schema_description"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size + 2 WHEN 1 THEN 3 + p_size % 4 ELSE NULL END AS people FROM part")
def x4_team_count(spark, sf_dir):
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    cards = F.concat(F.lit("<li class='x'>a</li>"), F.repeat(F.lit("<div id=1 class='our-Team-card'><b>A</b></div>"), size + 2))
    names = F.concat_ws(" | ", F.transform(F.sequence(F.lit(1), 3 + size % 4), lambda i: F.concat(F.lit("<p>Ann "), F.get(F.array(*(F.lit(n) for n in ("Lee", "Ray", "Fox", "Day", "Roe", "Poe", "Low"))), i - 1), F.lit("</p>"))))
    return table(spark, sf_dir, "part").select("p_partkey", P.team_count(F.when(k == 0, cards).when(k == 1, names).otherwise("<p>Ann Lee, Privacy Policy</p>")).alias("people"))


@query("SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [p_name] WHEN 1 THEN [p_name, 'two'] WHEN 2 THEN [p_name, 'in graph'] ELSE ['item', p_name] END) AS name FROM part")
def s5_json_ld_items(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.concat(F.lit('{"name":"'), F.col("p_name"), F.lit('"}'))
    text = F.when(k == 0, name).when(k == 1, F.concat(F.lit("["), name, F.lit(',{"name":"two"}]'))).when(k == 2, F.concat(F.lit('{"@context":"x","@graph":['), name, F.lit(',{"name":"in graph"}]}')))
    text = text.otherwise(F.concat(F.lit('{"itemListElement":[{"position":1,"item":{"name":"item"}},'), name, F.lit("]}")))
    html = F.concat(F.lit('<script type="application/ld+json">'), text, F.lit("</script>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(P.json_ld_items(html)).alias("o")).select("p_partkey", F.get_json_object("o", "$.name").alias("name"))


@query("SELECT p_partkey, coalesce(list_filter(regexp_extract_all(lower(p_name || ' services'), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'of', 'in', 'a', 'best', 'top', 'local', 'affordable', 'near', 'medical', 'business', 'businesses', 'services', 'service', 'company', 'good', 'cheap'))[-1], '') AS term FROM part")
def f17_taxonomy_term(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", taxonomy_term(F.concat("p_name", F.lit(" services"))).alias("term"))


@query(f"SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*type=\"application/ld\\+json\"[^>]*>(.*?)</script>', 1)) AS block FROM {_MARKED}")
def s5_json_ld_blocks(spark, sf_dir):
    k, quoted = F.col("page_id"), F.lit('type="application/ld+json"')
    other = F.when(k % 3 == 1, F.replace("html", quoted, F.lit("type='application/ld+json'"))).when(k % 3 == 2, F.replace("html", quoted, F.lit("id=x type=application/ld+json")))
    return marked(spark, sf_dir).select("page_id", F.explode(P.json_ld(F.coalesce(other, F.col("html")))).alias("block"))


_OWNER = "concat(CASE c_custkey % 7 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Robert' WHEN 2 THEN 'Maria' WHEN 3 THEN 'Chen' WHEN 4 THEN 'Priya' WHEN 5 THEN 'Olaf' ELSE 'Grace' END, ' ', CASE c_custkey % 5 WHEN 0 THEN 'Leeman' WHEN 1 THEN 'Stone' WHEN 2 THEN 'Okafor' WHEN 3 THEN 'Raman' ELSE 'Hopper' END)"
#: Sentences around a name, in the order of the patterns, and two that tell none.
_SAID = [("Since 1990. Founded by ", "."), ("Our owner: ", "."), ("by ", ", Owner, since then"), ("here ", ", CEO of Acme"), ("and ", " is the founder of it"), ("Meet ", "! "), ("Hello, I'm ", " and we fix roofs"), ("With owner ", "."), ("Propietario: ", "."), ("Inhaber: ", "."), ("Contact person: ", "."), ("We like ", " a lot"), ("Managed by Read More. ", " too")]


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 13 < 11 THEN {_OWNER} END AS owner FROM customer")
def f16_owner_sentences(spark, sf_dir):
    said = F.get(F.array(*(F.concat(F.lit(a), F.expr(_OWNER), F.lit(b)) for a, b in _SAID)), (F.col("c_custkey") % len(_SAID)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.owner_name(said).alias("owner"))


@query()
def f16_owner_name(spark, sf_dir):
    return marked(spark, sf_dir).select("page_id", C.owner_name(P.visible_text(F.col("html"))).alias("owner"))


@query(f"SELECT DISTINCT w AS word_pair, regexp_matches(w, '^[A-Z][a-zA-Z''-]* [A-Z][a-zA-Z''-]*$') AND lower(split_part(w, ' ', 1)) NOT IN {_IN(C.NOT_NAMES)} AND lower(split_part(w, ' ', 2)) NOT IN {_IN(C.NOT_NAMES)} AND length(split_part(w, ' ', 1)) >= 3 AND length(split_part(w, ' ', 2)) >= 3 AS ok FROM (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+ [A-Za-z][a-z]+)')) AS w FROM documents)")
def f15_person_names(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+ [A-Za-z][a-z]+)"), F.lit(1))).alias("word_pair"))
    return pairs.distinct().select("word_pair", C.plausible_person(F.col("word_pair")).alias("ok"))


@query("SELECT job_id, CASE o WHEN 0 THEN 'Bend' WHEN 1 THEN 'Madison' ELSE 'Boise' END AS city, CASE o WHEN 0 THEN 'OR' WHEN 1 THEN 'WI' END AS state FROM (SELECT job_id, CASE location WHEN 'Bend, OR' THEN 0 WHEN 'Madison, Wisconsin' THEN 1 ELSE 2 END AS o FROM v_jobs)")
def f17_parse_location(spark, sf_dir):
    city, state = parse_location(F.concat(F.when(F.col("job_id") % 2 == 0, "South ").otherwise(""), "location"))
    return view(spark, sf_dir, "jobs").select("job_id", city.alias("city"), state.alias("state"))


@query("SELECT job_id, CAST(tile AS INT) AS tile, query, place FROM (SELECT job_id, unnest(range(10)) AS tile, unnest([niche, niche, niche, niche, niche, niche, niche, 'best ' || niche, niche || ' services', 'top ' || niche]) AS query, unnest([location, 'Downtown ' || location, 'North ' || location, 'South ' || location, 'East ' || location, 'West ' || location, 'Central ' || location, location, location, location]) AS place FROM v_jobs)")
def s9_query_tiles(spark, sf_dir):
    from bizlink.functions.places import query_tiles

    return query_tiles(view(spark, sf_dir, "jobs").select("job_id", "niche", "location")).select("job_id", "tile", "query", "place")


@query("SELECT lead_id, contains(html, 'business') AND contains(html, k) AS found FROM (SELECT lead_id, CAST(lead_id AS STRING) AS k, concat('<h1>business ', CAST(lead_id % 1000 AS STRING), '</h1>') AS html FROM v_leads)")
def f25_name_on_site(spark, sf_dir):
    html = F.concat(F.lit("<h1>Business "), (F.col("lead_id") % 1000).cast("string"), F.lit("</h1>"))
    name = F.concat(F.lit("Business "), F.col("lead_id").cast("string"))
    return view(spark, sf_dir, "leads").select("lead_id", P.name_on_site(name, html).alias("found"))


@query("SELECT lead_id, email FROM (SELECT lead_id, email, row_number() OVER (PARTITION BY lead_id, lower(email) ORDER BY ord) AS rn FROM v_emails) WHERE rn = 1")
def w3_keep_first(spark, sf_dir):
    return first_by(view(spark, sf_dir, "emails").withColumn("k", F.lower("email")), ["lead_id", "k"], [F.col("ord")]).select("lead_id", "email")
