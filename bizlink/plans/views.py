"""Business tables derived from the given ones by arithmetic that Spark and DuckDB share.

Each view is one SELECT in SQL that both engines run, so the registered queries and their
SQL start from equal rows. The operators themselves take any DataFrame of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "c_custkey"

LEADS = f"""
SELECT {_K} AS lead_id, c_nationkey AS job_id, {_K} AS ord,
  CASE {_K} % 4 WHEN 0 THEN concat('The Business ', CAST({_K} AS STRING), ' LLC') WHEN 1 THEN concat('Business-', CAST({_K} AS STRING), ' Group')
    WHEN 2 THEN concat('Smith & Sons ', CAST({_K} AS STRING)) ELSE concat('Acme Company ', CAST({_K} AS STRING), ' Inc') END AS name,
  CASE WHEN {_K} % 10 = 0 THEN NULL ELSE concat('(', CAST(201 + {_K} % 700 AS STRING), ') 555-', substring(CAST(10000 + {_K} % 10000 AS STRING), 2, 4)) END AS phone,
  CASE {_K} % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('john.smith@biz', CAST({_K} AS STRING), '.com') WHEN 2 THEN concat('x1@biz', CAST({_K} AS STRING), '.com')
    WHEN 3 THEN 'joe@gmail.com' ELSE concat('hr@biz', CAST({_K} AS STRING), '.com') END AS owner_email,
  CASE WHEN {_K} % 3 = 0 THEN NULL ELSE concat('https://www.biz', CAST({_K} AS STRING), '.com/') END AS website,
  CASE {_K} % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'dead' WHEN 2 THEN 'none' ELSE NULL END AS website_status,
  CASE WHEN {_K} % 9 = 0 THEN 'wordpress' ELSE NULL END AS website_cms,
  {_K} % 2 = 0 AS has_ssl, {_K} % 6 = 0 AS website_name_found, {_K} % 3 <> 1 AS has_google_maps,
  CASE WHEN {_K} % 13 = 0 THEN NULL ELSE 2 + CAST({_K} % 31 AS DOUBLE) / 10 END AS google_rating,
  CAST({_K} % 120 AS INT) AS google_review_count,
  CASE {_K} % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS google_is_open,
  CASE {_K} % 4 WHEN 0 THEN 'google_maps' WHEN 1 THEN 'google_maps,npi' WHEN 2 THEN 'hotfrog' ELSE 'google_maps,hotfrog,yelp' END AS sources,
  {_K} % 10 <> 0 AND {_K} % 7 <> 0 AS phone_verified, {_K} % 6 = 1 AS email_verified,
  CASE WHEN {_K} % 3 = 2 THEN 'Mary O''Brien' WHEN {_K} % 3 = 1 THEN 'Lee' ELSE NULL END AS owner_name,
  CASE WHEN {_K} % 8 = 0 THEN concat('(', CAST(201 + {_K} % 700 AS STRING), ') 555-0199') ELSE NULL END AS owner_phone,
  CAST({_K} * 7 % 11 AS INT) AS owner_phone_tenths,
  CASE WHEN {_K} % 6 = 5 THEN 'Owner' ELSE NULL END AS owner_title,
  CASE {_K} % 5 WHEN 0 THEN 'Acme,Globex,Initech' WHEN 1 THEN 'Acme' ELSE NULL END AS partners,
  CASE WHEN {_K} % 4 = 3 THEN 'roofing,siding' ELSE NULL END AS services,
  CASE WHEN {_K} % 11 = 0 THEN 'Ann,Bob' ELSE NULL END AS team_members,
  CASE WHEN {_K} % 2 = 1 THEN concat('https://facebook.com/b', CAST({_K} AS STRING)) ELSE NULL END AS social_facebook,
  CASE WHEN {_K} % 5 = 2 THEN concat('https://instagram.com/b', CAST({_K} AS STRING)) ELSE NULL END AS social_instagram,
  CASE WHEN {_K} % 7 = 3 THEN concat('https://twitter.com/b', CAST({_K} AS STRING)) ELSE NULL END AS social_twitter,
  CASE WHEN {_K} % 4 = 0 THEN NULL ELSE CAST({_K} * 3 % 90 AS INT) END AS employee_count,
  CASE WHEN {_K} % 3 = 0 THEN NULL ELSE CAST(1890 + {_K} % 130 AS INT) END AS year_founded,
  CAST({_K} % 4 AS INT) AS phone_source_count, CAST({_K} % 8 AS INT) AS review_weakness_count,
  CASE {_K} % 4 WHEN 0 THEN '12 Main St, Bend, OR 97701' WHEN 1 THEN '9 Oak Ave, South Bend, IN 46601' WHEN 2 THEN 'Elm Rd, Portland, Oregon' ELSE NULL END AS address,
  CASE {_K} % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS address_valid,
  CASE WHEN {_K} % 17 = 0 THEN 'raw' ELSE 'validated' END AS status,
  c_mktsegment AS business_category,
  CASE WHEN {_K} % 5 = 0 THEN NULL ELSE concat('We do ', lower(c_mktsegment), ' work since ', CAST(1950 + {_K} % 70 AS STRING)) END AS description,
  CASE WHEN {_K} % 6 = 2 THEN 'doordash,grubhub' ELSE NULL END AS external_platforms,
  CASE WHEN {_K} % 4 = 1 THEN 'ga4' ELSE NULL END AS marketing_stack,
  {_K} % 4 <> 0 AS mx_valid, CASE {_K} % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS deliverable, {_K} % 2 = 0 AS smtp_valid, {_K} % 5 = 4 AS is_role,
  CASE {_K} % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'voip' WHEN 2 THEN 'fixed_line' ELSE 'fixed_line_or_mobile' END AS phone_type,
  {_K} * 37 % 101 AS gate_score, {_K} * 53 % 1001 AS gate_conf_milli
FROM {{customer}}"""

JOBS = """
SELECT o_orderkey AS job_id, concat('niche', CAST(o_custkey % 7 AS STRING)) AS niche,
  CASE o_custkey % 3 WHEN 0 THEN 'Bend, OR' WHEN 1 THEN 'Madison, Wisconsin' ELSE 'Boise' END AS location,
  'US' AS country, CAST(5 + o_orderkey % 496 AS INT) AS lim,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR END AS heartbeat_at
FROM {orders}"""

OUTREACH = """
SELECT event_id AS attempt_id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE substring(CAST(10000000 + user_id AS STRING), 2, 7) END AS phone7,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('business', CAST(user_id AS STRING)) END AS name_norm,
  CASE event_type WHEN 'view' THEN 'no_answer' WHEN 'click' THEN 'gatekeeper' WHEN 'signup' THEN 'interested' WHEN 'purchase' THEN 'booked' ELSE 'bad_number' END AS disposition,
  CAST(ts AS TIMESTAMP) AS attempted_at
FROM {events}"""

LISTINGS = """
SELECT c_custkey AS cluster, 'google_maps' AS source, 1 AS ord, concat('Biz ', CAST(c_custkey AS STRING)) AS name,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('(213) 555-', substring(CAST(10000 + c_custkey % 10000 AS STRING), 2, 4)) END AS phone,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'short text' END AS description, CAST(c_custkey % 6 AS DOUBLE) AS google_rating,
  CAST(NULL AS STRING) AS website, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat(CAST(c_custkey AS STRING), ' Main St') END AS address FROM {customer}
UNION ALL
SELECT c_custkey, 'hotfrog', 2, concat('Biz ', CAST(c_custkey AS STRING), ' LLC'),
  concat('213-555-', substring(CAST(10000 + (c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) % 10000 AS STRING), 2, 4)),
  CASE WHEN c_custkey % 2 = 0 THEN 'a rather longer description' ELSE 'tiny' END, CAST(NULL AS DOUBLE),
  concat('https://biz', CAST(c_custkey AS STRING), '.com'), concat(CAST(c_custkey AS STRING), ' Main Street') FROM {customer} WHERE c_custkey % 7 <> 0
UNION ALL
SELECT c_custkey, 'npi', 3, concat('BIZ ', CAST(c_custkey AS STRING)),
  concat('+1 213 555 ', substring(CAST(10000 + c_custkey % 10000 AS STRING), 2, 4)),
  CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CASE WHEN c_custkey % 2 = 0 THEN concat('http://npi', CAST(c_custkey AS STRING), '.org') ELSE '' END,
  concat('Suite ', CAST(c_custkey AS STRING)) FROM {customer} WHERE c_custkey % 5 <> 1"""

LEDGER = """
SELECT DISTINCT substring(CAST(10000 + o_custkey % 10000 AS STRING), 2, 4) AS tail, concat('555', substring(CAST(10000 + o_custkey % 10000 AS STRING), 2, 4)) AS phone7,
  concat('smithsons', CAST(o_custkey AS STRING)) AS name_norm FROM {orders} WHERE o_orderstatus = 'F'"""

PROGRESS = """
SELECT user_id AS job_id, event_id AS seq, CAST(event_id % 101 AS INT) AS pct, event_type AS stage, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_id % 97 = 0 THEN 'done' ELSE 'progress' END AS type FROM {events}"""

REVIEWS = """
SELECT l_orderkey AS lead_id, l_linenumber AS pos, CASE WHEN l_quantity < 3 THEN NULL ELSE CAST(1 + l_partkey % 5 AS INT) END AS stars,
  concat('review ', CAST(l_partkey AS STRING)) AS text, l_suppkey % 10 = 0 AS unavailable FROM {lineitem}"""

EMAILS = """
SELECT c_custkey AS lead_id, 1 AS ord, concat('info@biz', CAST(c_custkey AS STRING), '.com') AS email, concat('biz', CAST(c_custkey AS STRING), '.com') AS domain FROM {customer}
UNION ALL SELECT c_custkey, 2, concat('Jane.Doe@biz', CAST(c_custkey AS STRING), '.com'), concat('biz', CAST(c_custkey AS STRING), '.com') FROM {customer} WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 3, concat('x', CAST(c_custkey % 10 AS STRING), '@gmail.com'), concat('biz', CAST(c_custkey AS STRING), '.com') FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 4, 'noreply@sentry.io', concat('biz', CAST(c_custkey AS STRING), '.com') FROM {customer} WHERE c_custkey % 5 = 0"""

_LETTERS = "translate(md5(concat('{0}', CAST(c_custkey AS STRING))), '0123456789abcdef', 'bcdfghjklmnpqrst')"
_NAME, _WORD, _OTHER = (f"substring({_LETTERS.format(mark)}, 1, {n})" for mark, n in (("", 14), ("w", 8), ("n", 16)))
_TEL = "concat('(213) ', substring(CAST(10000000 + c_custkey AS STRING), 2, 3), '-', substring(CAST(10000000 + c_custkey AS STRING), 5, 4))"

#: Up to three listings of a business under names that read like words: spelled in full, with a
#: letter less, and in capitals or under another name; phones and addresses come and go.
BUSINESSES = f"""
SELECT 1000000000 + c_custkey AS ord, c_custkey AS c, 'google_maps' AS source, {_NAME} AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {_TEL} END AS phone,
  concat(CAST(c_custkey AS STRING), ' ', {_WORD}, ' Street') AS address FROM {{customer}}
UNION ALL
SELECT 2000000000 + c_custkey, c_custkey, 'hotfrog', concat(substring({_NAME}, 1, 6), substring({_NAME}, 8, 7), ' LLC'), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE {_TEL} END,
  CASE WHEN c_custkey % 5 = 0 THEN 'Zzz Xxx Www' ELSE concat(CAST(c_custkey AS STRING), ' ', {_WORD}, ' St') END FROM {{customer}} WHERE c_custkey % 7 <> 0
UNION ALL
SELECT 3000000000 + c_custkey, c_custkey, 'npi', CASE WHEN c_custkey % 2 = 0 THEN concat('Dr. ', {_OTHER}) ELSE upper({_NAME}) END, {_TEL}, NULL FROM {{customer}} WHERE c_custkey % 5 <> 1"""

VIEWS = {"businesses": BUSINESSES, "leads": LEADS, "jobs": JOBS, "outreach": OUTREACH, "listings": LISTINGS, "ledger": LEDGER, "progress": PROGRESS, "reviews": REVIEWS, "emails": EMAILS}
TABLES = ("customer", "orders", "events", "lineitem", "pages", "documents")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: str | None = None) -> DataFrame:
    """A derived view over the tables in ``sf_dir``, which are first dealt by column ``dealt``."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    if dealt:
        used = {t: spread(rows, dealt) for t, rows in used.items()}
    return spark.sql(sql, **used)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table of few bytes dealt over the session's tasks, for work in Python that grows
    with the rows: files are split by bytes, which gives millions of small rows to a task or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """``sql`` with a common table expression for each view it names as ``v_<name>``."""
    used = [n for n in VIEWS if f"v_{n}" in sql]
    ctes = [f"v_{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in used]
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql
