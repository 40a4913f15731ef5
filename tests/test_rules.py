"""Literal cases of single rules."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from bizlink.functions import contact as C
from bizlink.functions import identity as I
from bizlink.functions.fuzzy import lcs, partial, ratio, token_set
from bizlink.functions.places import location_matches
from bizlink.functions import pages as P
from bizlink.operators import golden, linkage, lookups, market, outreach, records, select
from bizlink.operators.components import components
from bizlink.sources.html import contact_roll_up, parse_page
from bizlink.sources.listings import Registry, canonical
from bizlink.sources.sinks import ask, dates_in, replace_jobs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("email", "junk"), [("n.d@a.length", True), ("fonts.gst@ic.com", True), ("b@.bing.com", True), ("insul@ion.installed", True), ("a@x.io", False), ("s@acme.co.uk", False), ("hi@studio.design", False), (None, True)])
def test_junk_email(spark, email, junk):
    assert one(spark, C.is_junk_email(F.col("e")), e=email) is junk


@pytest.mark.parametrize(("name", "ok"), [("Mary O'Brien", True), ("Anne-Marie Smith", True), ("Form Whether", False), ("A B", False), ("Smith", False), (None, False)])
def test_person_name(spark, name, ok):
    assert one(spark, C.plausible_person(F.col("n")), n=name) is ok


def test_email_on_own_domain_scores_80(spark):
    assert one(spark, C.email_score(F.col("e"), F.lit("company.com")), e="info@company.com") == 80


@pytest.mark.parametrize(("address", "ok"), [("1 A St, South Bend, IN 46601", False), ("1 A St, Bend, OR 97701", True), (None, True), ("", True), ("Salem, Oregon", True)])
def test_location(spark, address, ok):
    assert one(spark, location_matches(F.col("a"), F.lit("Bend, OR")), a=address) is ok


def test_name_and_phone_keys(spark):
    assert one(spark, I.normalize_name(F.col("n")), n="The Acme Group, LLC") == "acme"
    assert one(spark, I.phone_key(F.col("p")), p="(213) 555-0142") == "5550142"
    assert one(spark, I.phone_key(F.col("p")), p="12345") is None
    assert one(spark, I.slug(F.col("s")), s="  !!  ") == "leads"


def test_fixed_lists_are_whole():
    assert len(lookups.AREA_CODES) == 337
    assert len(set(lookups.AREA_CODES.values())) == 51
    assert len(market.PROFILES) == 12 and len(records.MEDICAL) == 44 and len(C.OWNER_PATTERNS) == 17
    assert len(C.ASSET_HOSTS) == 22 and len(C.LONG_ENDINGS) == 113 and len(C.NOT_NAMES) == 225
    assert len(P.CMS) == 12 and len(P.AD_TAGS) == 11 and len(P.DIRECT) == 19 and len(P.CHALLENGES) == 6
    assert len(P.FOUNDED) == 4 and len(P.STAFF) == 6


@pytest.mark.parametrize(("category", "profile"), [("Roofing Contractor", "Roofing"), ("Joe's HVAC & Heating", "HVAC"), ("Italian Restaurant", "Restaurant"), ("Seaside Motel", "Hospitality / Lodging"), ("Acme Kitchen Remodeling", "Remodeling / General Contractor"), (None, "Local business"), ("Pet Grooming", "Local business")])
def test_profiles(spark, category, profile):
    assert one(spark, market.profile_of(F.col("c")), c=category) == profile


@pytest.mark.parametrize(("text", "email"), [("write joe [at] acme [dot] plumbing today", "joe@acme.plumbing"), ("mail: ann @ site . co", "ann@site.co"), ("what is . that", None), ("", None)])
def test_spelled_addresses(spark, text, email):
    assert one(spark, F.get(C.harvest_emails(F.col("t")), F.lit(0)), t=text) == email


def test_owner_names_as_python_finds_them(spark):
    from bizlink.functions.pages import visible_text

    texts = ["Founded by John Smith. Call", "Owner: Mary Jones, here", "Jane Doe, CEO of Acme", "Bob Stone - Founder", "Ann Lee is the owner", "I'm Bob Jones and", "Smith Brown & Sons Plumbing", "Our founder, Mark Twain!", "with owner Zed Young.", "Owner is Pat Gray.",
             "Propietario: Juan García.", "Propriétaire: Jean Dupont.", "Inhaber: Hans Müller.", "Contact us Our Team", "contact person Max Frost.", "Meet Our Team. Founded by Eve Hill.", "nothing here", ""]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(visible_text(F.col("html")).alias("t")).limit(40)
    texts += [r["t"] for r in pages.collect()]
    got = [r["o"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.owner_name(F.col("t")).alias("o")).orderBy("i").collect()]

    def plausible(name):
        parts = name.split()
        return 2 <= len(parts) <= 4 and all(re.match(r"^[A-Z][a-zA-ZÀ-ÿ'’\-]*$", p) and p.lower().strip(".,'’-") not in C.NOT_NAMES for p in parts) and sum(len(p) >= 3 for p in parts) >= 2

    for text, owner in zip(texts, got, strict=True):
        hits = (m.group(1).strip() for m in (re.search(p, text) for p in C.OWNER_PATTERNS) if m)
        assert owner == next((h for h in hits if plausible(h)), None), text[:80]
    assert sum(o is not None for o in got) >= 13


def test_page_structure_rules():
    page = parse_page("""<script type="application/ld+json">{"@graph":[{"@type":"Service","name":"Roof repair"},{"x":{"@type":"Product","name":"Tiles"}}]}</script><h1>All about our roofs here</h1>
      <ul class="menu"><li>Never listed</li></ul><div class="team-card"><h3>Ann Smith</h3><p>Co-Founder</p></div><div class="team-card"><h3>Bob Stone</h3><p>Roofer</p></div>
      <div>Our partners <img alt="Acme Gold"><li>Certified by Globex Systems</li></div>""")
    assert page["services"] == ["Roof repair", "Tiles"] and page["owner_title"] == "Co-Founder" and page["post_titles"] == ["All about our roofs here"]
    assert page["team"] == [{"name": "Ann Smith", "title": "Co-Founder"}, {"name": "Bob Stone", "title": "Roofer"}]
    assert "Acme Gold" in page["partners"] and any("Globex Systems" in p for p in page["partners"])
    told = parse_page("<p>We offer roof repair, gutter cleaning and siding. We are good.</p><section><h2>Our Services</h2><ul><li>Inspection</li></ul></section>")
    assert told["services"] == ["roof repair", "gutter cleaning", "siding", "Inspection"]
    assert parse_page("<p>Eve Hill — General Manager, here</p>")["owner_title"] == "General Manager"


def test_listing_cards_and_detail():
    cards = parse_page("""<div class="hf-box"><h3><a href="/company/1/acme">Acme Roofs</a></h3><a href="tel:1">555-1234</a><span class="small">Claim this</span><span class="small">1 Main St</span></div>
      <div class="hf-box"><p>no link</p></div>""")["cards"]
    assert [(c["name"], c["phone"], c["address"], c["url"]) for c in cards] == [("Acme Roofs", "555-1234", "1 Main St", "/company/1/acme")]
    yp = parse_page("""<div class="result"><a class="business-name" href="/b/2">Bolt Co</a><div class="phones phone primary">555-9</div><div class="street-address">2 Elm</div><div class="locality">Bend, OR</div><a class="track-visit-website" href="https://bolt.co">w</a></div>""")["cards"]
    assert [(c["name"], c["phone"], c["address"], c["website"]) for c in yp] == [("Bolt Co", "555-9", "2 Elm, Bend, OR", "https://bolt.co")]
    one_ = parse_page("""<h1>Acme Roofs</h1><p class="description">Good roofs</p><dl class="row"><dt>Website</dt><dd><a href="https://acme.com">w</a></dd><dt>Phone no.</dt><dd>555</dd><dt>Social media</dt><dd><a href="https://facebook.com/a">f</a><a href="https://x.com/a">x</a></dd><dt>Address</dt><dd>1 Main</dd></dl>""")["detail"]
    assert one_ == {"name": "Acme Roofs", "description": "Good roofs", "website": "https://acme.com", "phone": "555", "address": "1 Main", "social_facebook": "https://facebook.com/a", "social_twitter": "https://x.com/a"}
    assert parse_page("")["detail"] is None and parse_page(None)["cards"] == []


def test_contact_roll_up_stops_early(spark):
    page = lambda path, html: ("a", "acme.com", f"https://acme.com{path}", html)
    rows = [page("/", "info@acme.com"), page("/contact", "Founded by Ann Lee."), page("/about", "<b>joe.doe@acme.com</b>"), page("/team", "zoe@acme.com"), page("/shop", "never@acme.com")]
    rows += [("b", "b.com", "https://b.com/team", "x@b.com"), ("b", "b.com", "https://b.com/contact", "y.z@b.com")]
    got = {r["lead"]: r for r in contact_roll_up(spark.createDataFrame(rows, "lead string, domain string, url string, html string"), "lead", "domain").collect()}
    assert (got["a"]["pages"], got["a"]["owner"], got["a"]["best_email"], got["a"]["emails"]) == (2, "Ann Lee", "info@acme.com", ["info@acme.com"])
    assert (got["b"]["pages"], got["b"]["best_email"]) == (1, "y.z@b.com")


def test_founding_and_staff(spark):
    html = lambda c, t: one(spark, c, t=t)
    year = P.year_founded(F.col("t"), 2026, F.lit(2011))
    assert html(year, 'since 1990, "foundingDate": "1979-02-01"') == 1979 and html(year, "Founded in 1987. since 1991. Established 2001") == 1991
    assert html(year, "Copyright © 1999-2024") == 1999 and html(year, "nothing") == 2011 and html(year, '"foundingDate":"1200"') is None
    staff = P.employee_count(F.col("t"))
    assert html(staff, 'numberOfEmployees: 50') == 50 and html(staff, '<meta content="12" itemprop="numberOfEmployees">') == 12
    assert html(staff, "We're a team of 50 people") == 50 and html(staff, "a 200-person company") == 200 and html(staff, "our 30 - person team") == 30 and html(staff, "We employ over 80") == 80


def test_model_hook_goes_on_after_a_failure(spark):
    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("bad",)], "facts string").unionByName(spark.createDataFrame([("ok",)], "facts string"))
    assert {r["facts"]: r["reply"] for r in ask(rows, model).collect()}["ok"] == "OK"
    assert ask(rows, None).where("reply is null").count() == 2


def test_ratios_against_plain_definitions():
    rng = random.Random(5)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lcs(a, b) == slow(a, b)
        assert not a or partial(a, b + a) == 100.0
    assert token_set("acme roofing", "acme roofing portland") == 100.0


def test_similar_names_finds_every_pair(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 22))) for _ in range(40)]
    names = set(base)
    for b in base:
        for _ in range(3):
            w = list(b)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice("abcde")], [w[i], rng.choice("abcde")]])
                w = w or ["a"]
            names.add("".join(w))
    names = sorted(names)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if ratio(a, b) >= 88}
    got = {tuple(r) for r in linkage.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == want


def test_resolve_is_the_closure_of_matches(spark):
    from bizlink.functions.identity import match_digits, name_key

    rng = random.Random(7)
    names = ["Acme Roofing", "Acme Roofingg", "Acme Roof", "Bolt Electric", "Bolt Electrics", "Bold Electric", "Zen Spa", ""]
    rows = [(i, rng.choice(names), rng.choice([None, "", "213-555-0101", "(213) 555-0102", "541 555 0103"]), rng.choice([None, "1 Main St", "1 Main Street", "99 Oak Avenue"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string, phone string, address string").repartition(3)
    keyed = {r["id"]: r for r in df.withColumn("p", match_digits(F.col("phone"))).withColumn("n", name_key(F.col("name"))).collect()}

    def same(a, b):
        if a["p"] and a["p"] == b["p"]:
            return True
        if not a["n"] or not b["n"] or ratio(a["n"], b["n"]) < 88:
            return False
        x, y = (a["address"] or "").lower(), (b["address"] or "").lower()
        return not x or not y or partial(x, y) >= 60

    root = {i: i for i in keyed}
    changed = True
    while changed:
        changed = False
        for i in keyed:
            low = min(root[k] for k in keyed if k == i or same(keyed[i], keyed[k]) or same(keyed[k], keyed[i]))
            changed |= low < root[i]
            root[i] = min(root[i], low)
    assert {r["id"]: r["cluster"] for r in linkage.resolve(df).collect()} == root


def test_resolve_has_one_rule_for_all_sizes(spark):
    rows = spark.range(5300).select("id", F.when(F.col("id") < 5200, "").otherwise(F.md5(F.col("id").cast("string"))).alias("name"), F.when(F.col("id") < 5200, "213-555-0101").alias("phone"), F.lit("1 Main St").alias("address"))
    got = linkage.resolve(rows).groupBy("cluster").count().collect()
    assert max(r["count"] for r in got) == 5200 and len(got) == 101


def test_best_place(spark):
    leads = spark.createDataFrame([(1,), (2,), (3,)], "lead_id long")
    rows = [(1, "Acme Roofing", 0, "https://g/maps/place/a", "Zzz", 4.0, 9), (1, "Acme Roofing", 1, "https://g/maps/place/b", "Roofing Acme", 4.5, 7), (2, "Bolt", 0, "https://g/maps/place/c", "Qqqq", 3.0, 1), (3, "Bolt", 0, "https://g/search", "Bolt", 3.0, 1)]
    tries = spark.createDataFrame(rows, "lead_id long, target_name string, cand_ord int, href string, cand_name string, rating double, reviews int")
    got = {r["lead_id"]: r for r in linkage.best_place(leads, tries).collect()}
    assert got[1]["google_maps_url"] == "https://g/maps/place/b" and got[1]["google_rating"] == 4.5
    assert not got[2]["has_google_maps"] and got[2]["google_maps_url"] is None and not got[3]["has_google_maps"]


def test_partial_and_set_ratios_by_plain_windows():
    from bizlink.functions.fuzzy import sorted_ratio

    rng = random.Random(9)
    for _ in range(150):
        a, b = (" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(2))
        x, y = sorted((a, b), key=len)
        cuts = {y[max(0, s) : s + len(x)] for s in range(1 - len(x), len(y))}
        assert partial(a, b) == pytest.approx(max(ratio(x, c) for c in cuts))
        assert sorted_ratio(a, b) == pytest.approx(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
        assert token_set(a, b) == pytest.approx(token_set(b, a)) and (set(a.split()) <= set(b.split())) <= (token_set(a, b) == 100)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100


def test_golden_counts_agreeing_phones(spark):
    rows = [(1, "google_maps", 1, "Acme", "(213) 555-0142", "short"), (1, "yelp", 2, "Acme", "213-555-0142", "a longer text"), (1, "npi", 3, "ACME", None, None)]
    df = spark.createDataFrame(rows, "cluster long, source string, ord int, name string, phone string, description string")
    r = golden.golden_record(df, ["name", "phone", "description"]).first()
    assert (r["phone_source_count"], r["description"], r["sources_str"]) == (2, "a longer text", "google_maps,yelp,npi")


def test_gate_falls_back(spark):
    cols = "lead_id long, job_id long, ord long, phone string, owner_email string, website string, sources string, status string, lead_score int, conf_milli int, phone_verified boolean, email_verified boolean, has_google_maps boolean"
    low = [(i, 1, i, None if i == 1 else "1", None, None, "yelp", "validated" if i < 3 else "raw", 5 * i, 100, False, False, False) for i in range(5)]
    got = [r["lead_id"] for r in select.gated_export(spark.createDataFrame(low, cols), 3).orderBy("export_rank").collect()]
    assert got == [2, 0]
    assert select.gated_export(spark.createDataFrame([], cols), 3).count() == 0


def test_funnel(spark):
    rows = [("1", "a", 1, "booked", "2024-01-01"), ("2", "b", 2, "no_answer", "2024-01-02")]
    df = spark.createDataFrame(rows, "phone7 string, name_norm string, attempt_id long, disposition string, t string").withColumn("attempted_at", F.to_timestamp("t")).drop("t")
    r = outreach.funnel(df).first()
    assert (r["attempts"], r["contacted"], float(r["conversion_pct"])) == (2, 2, 50.0)
    assert outreach.funnel(df.where("false")).first()["conversion_pct"] == 0


@pytest.mark.parametrize(("raw", "want"), [('{"a": 1}', '{"a": 1}'), ("x ```json\n{\"a\": 1}\n``` y", '{"a": 1}'), ('{"a": 1, "b": "cut', '{"a": 1, "b": "cut"}'), ('{"a": 1, "b":', '{"a": 1}'), ("none", None), (None, None)])
def test_repair_json(raw, want):
    assert records.repair_json(raw) == want


def test_page_structure():
    page = parse_page("<h2>Our services</h2><ul><li>Roofing</li><li>Siding</li></ul><script>no</script><div class='team-card'>Jane Doe, Owner</div><img alt='Certified partner'>")
    assert page["services"] == ["Roofing", "Siding"] and page["team"] == [{"name": "Jane Doe", "title": "Owner"}] and page["partners"] == ["Certified partner"] and "no" not in page["text"].split()


def test_dates(spark):
    assert [str(d) for d in one(spark, dates_in(F.col("t")), t="March 15, 2024 and 2024-06-01, not 2024-13-01")] == ["2024-06-01", "2024-03-15"]


def test_registry_and_replace(spark, tmp_path):
    some = spark.createDataFrame([("Acme", "1")], "name string, phone string")
    reg = Registry({"a": lambda: some, "gone": lambda: spark.read.parquet(str(tmp_path / "none"))})
    assert reg.gather(spark).count() == 1 and reg.gather(spark, only=[]).count() == 0
    assert len(canonical(some).columns) == 22
    path = str(tmp_path / "leads")
    for _ in range(2):
        replace_jobs(spark.createDataFrame([(1, 1), (2, 2)], "lead_id long, job_id long"), path)
    replace_jobs(spark.createDataFrame([(3, 1)], "lead_id long, job_id long"), path)
    assert sorted(r["lead_id"] for r in spark.read.parquet(path).collect()) == [2, 3]


def test_addresses_and_numbers_in_long_texts(spark):
    """A text without a break is read once: a megabyte of it takes no more than seconds."""
    import time

    from bizlink.functions import contact
    from bizlink.operators import lookups

    texts = ["a" * 1_000_000, "ab@" * 300_000, "x" + " " * 1_000_000, "0123456789abcdef" * 60_000 + " bob at acme dot com", "213-555-0142 " * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(5)
    one(spark, contact.harvest_emails(F.col("t")), t="a@b.com")
    began = time.perf_counter()
    got = {r["id"]: r["e"] for r in df.select("id", contact.harvest_emails(F.col("t")).alias("e")).collect()}
    assert got[3] == ["bob@acme.com"] and not got[0]
    assert lookups.harvest_phones(df, "id", "t").count() == 1
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("text", ["a@b.com.c@d.com", "x a.b@c.org,d@e.net", "..a@b.co", "a@b@c.com", "a@b", "no-reply@x.y.zz1", "%a@b-c.dd e@f.g.hh"])
def test_addresses_as_the_plain_pattern_finds_them(spark, text):
    from bizlink.functions import contact

    assert one(spark, F.regexp_extract_all(F.col("t"), F.lit(contact._FOUND), F.lit(1)), t=text) == re.findall(contact.EMAIL, text)


def test_unclosed_elements_and_large_pages():
    import time

    assert parse_page("<div><h2>Services</h2><ul><li>Roof repair<li>Gutter cleaning<li>Siding work</ul></div>")["services"] == ["Roof repair", "Gutter cleaning", "Siding work"]
    assert parse_page("<dl><dt>Phone<dd>1<dt>Address<dd>2 Elm</dl><h1>Acme</h1>")["detail"] == {"name": "Acme", "description": None, "phone": "1", "address": "2 Elm"}
    assert parse_page("<table><tr><td>a<td>b<tr><td>c</table><p>x<p>y<div>z")["text"] == "a b c x y z"
    for html in ("".join(f"<div><img alt='Logo {i} Corp'>our partner" for i in range(4000)), "<h2>Our services</h2><ul>" + "".join(f"<li>item number {i}" for i in range(4000)), "<div>" * 4000 + "</x></b>" * 4000, "<dl>" + "<dt>Phone" * 4000):
        began = time.perf_counter()
        parse_page(html)
        assert time.perf_counter() - began < 2


def test_summary_by_lines():
    long = "We are dedicated to roofs of every kind and to those who live under them"
    assert parse_page(f"<p>{long}\nshort\n{long} too</p>")["summary"] == f"{long} too {long}"
    assert parse_page("<p>short\nlines\nonly</p>")["summary"] is None and parse_page(f"<p>{'x' * 600}</p>")["summary"] is None


def test_json_ld_in_any_quotes_and_empty_pages(spark):
    from bizlink.functions import pages

    for kind in ('"application/ld+json"', "'application/ld+json'", "application/ld+json", 'application/ld+json id="x"'):
        assert one(spark, pages.json_ld(F.col("t")), t=f'<script id=1 type={kind}>{{"a": 1}}</script>') == ['{"a": 1}']
    assert one(spark, pages.json_ld(F.col("t")), t="<script type=application/ld+jsonx>1</script>") == []
    assert [one(spark, pages.fetch_outcome(F.lit(200), F.col("t")), t=t) for t in ("", None, "<p>fine</p>")] == ["blocked", "blocked", "ok"]


def test_parsed_pages_go_out_by_few():
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from bizlink.sources.html import HELD_PAGES, parse_pages

    class Pages:
        schema = StructType.fromDDL("page_id long, html string")
        mapInArrow = lambda self, run, schema: run

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(300)), "html": [None, "<p class='x'>text</p>", ""] * 100})
    out = list(parse_pages(Pages())(iter([batch])))
    assert max(b.num_rows for b in out) <= HELD_PAGES
    assert [i for b in out for i in b.column("page_id").to_pylist()] == list(range(300)) and out[0].column("text").to_pylist()[:3] == ["", "text", ""]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["s6_listing_cards", "x6_x8_business_pages", "f4_f5_name_ratios"])
def test_python_work_is_spread_by_rows(spark, name):
    """Tables of one small file give more than one task of parsing or comparing."""
    from bizlink.plans import record_queries

    assert getattr(record_queries, name)(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
