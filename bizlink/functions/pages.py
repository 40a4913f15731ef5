"""What a landed page says about a business, as column functions over its HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of parked sites; marks of site builders in order; platforms; ad tags.
PARKED = ["this domain is parked", "domain is for sale", "buy this domain", "parked free", "godaddy parking", "sedoparking", "domainname.com is available", "this website is under construction", "coming soon", "website coming soon", "hugedomains.com", "afternic.com", "sedo.com"]
CMS = {
    "WordPress": ["wp-content", "wp-includes", 'name="generator" content="WordPress', "/wp-json/", "/wp-admin/", "wp-emoji-release"],
    "Shopify": ["cdn.shopify.com", "shopify.com/s/files", "Shopify.theme", "Shopify.shop", "powered_by_shopify", "window.Shopify"],
    "Wix": ["wix.com", "X-Wix-Published-Version", "static.parastorage.com", "wix-renderer", "wix-image", "wix-site"],
    "Squarespace": ["squarespace.com", "squarespace-cdn.com", "squarespace.net", "static1.squarespace.com", "sqs-block", "sqs-layout"],
    "Webflow": ["webflow.com", "webflow.io", "assets.website-files.com", "w-webflow", "wf-"],
    "Weebly": ["weebly.com", "editmysite.com", "sites.google.com/site/", "wsite-content"],
    "GoDaddy": ["godaddysites.com", "secureserver.net", "website-builder.godaddy.com"],
    "Joomla": ["joomla", "com_content", "com_modules", "/components/com_", 'name="generator" content="Joomla'],
    "Drupal": ["drupal", "Drupal.settings", "/sites/default/files", 'name="Generator" content="Drupal'],
    "Magento": ["magento", "Magento_", "mage/", "Mage.Cookies", "var/theme/"],
    "PrestaShop": ["prestashop", "PrestaShop", "/themes/default-bootstrap/", "ps_shoppingcart"],
    "WixStudio": ["wixstudio.com", "editor.wix.com", "wix-layout"],
}
PLATFORMS = {"doordash": "DoorDash", "ubereats": "Uber Eats", "grubhub": "Grubhub", "seamless": "Seamless", "postmates": "Postmates", "slicelife": "Slice", "ezcater": "ezCater", "booking.com": "Booking.com", "expedia": "Expedia", "hotels.com": "Hotels.com", "airbnb": "Airbnb", "vrbo": "Vrbo", "agoda": "Agoda", "priceline": "Priceline"}
DIRECT = ["toasttab", "olo.com", "chownow", "popmenu", "bentobox", "menufy", "owner.com", "square.site", "squareup", "clover.com", "synxis", "cloudbeds", "littlehotelier", "webrezpro", "thinkreservations", "mews", "innroad", "freetobook", "bookingbutton"]
AD_TAGS = {"connect.facebook.net": "Facebook Pixel", "fbq(": "Facebook Pixel", "facebook.com/tr": "Facebook Pixel", "googletagmanager.com": "Google Tag Manager", "google-analytics.com": "Google Analytics", "googleadservices.com": "Google Ads", "googleads.g.doubleclick.net": "Google Ads", "analytics.tiktok.com": "TikTok Pixel", "ttq.load": "TikTok Pixel", "snap.licdn.com": "LinkedIn Insight", "static.ads-twitter.com": "Twitter Pixel"}
PAID = ["Facebook Pixel", "Google Ads", "TikTok Pixel", "LinkedIn Insight", "Twitter Pixel"]
SOCIAL = {
    "facebook": r"https?://(?:www\.)?(?:facebook|fb)\.com/[a-zA-Z0-9.\-/_]+",
    "instagram": r"https?://(?:www\.)?instagram\.com/[a-zA-Z0-9._\-/]+",
    "twitter": r"https?://(?:www\.)?(?:twitter|x)\.com/[a-zA-Z0-9_\-/]+",
    "linkedin": r"https?://(?:www\.)?linkedin\.com/(?:company|in|school)/[a-zA-Z0-9\-_./]+",
}
#: Marks of challenge pages; paths that are worth a look, by kind; path words of a sitemap.
CHALLENGES = ["just a moment", "challenges.cloudflare.com", "cf-challenge", "cf_chl_opt", "attention required", "enable javascript and cookies to continue"]
PATHS = {
    "about": ["/about", "/about-us", "/aboutus", "/our-story", "/company", "/who-we-are", "/about-company"],
    "team": ["/team", "/our-team", "/staff", "/leadership", "/management", "/people", "/our-people", "/board", "/executives"],
    "services": ["/services", "/our-services", "/service", "/menu", "/our-menu", "/what-we-do", "/solutions", "/products", "/capabilities", "/offerings"],
    "partners": ["/partners", "/our-partners", "/clients", "/our-clients", "/certifications", "/affiliations", "/memberships", "/customers", "/our-customers", "/case-studies"],
    "blog": ["/blog", "/news", "/updates", "/latest", "/press", "/insights", "/articles"],
}
CONTACT_PATHS = ["/contact", "/contact-us", "/contactus", "/about", "/about-us", "/team", "/our-team", "/staff", "/leadership", "/locations", "/location", "/find-us", "/hours", "/menu", "/our-menu", "/book-now", "/reservations", "/support", "/help"]
#: Words of a path that say what its page is read for; a path may serve several.
PAGE_WORDS = {
    "about": ["about", "company", "story", "who"],
    "team": ["team", "staff", "people", "leadership", "management"],
    "members": ["team", "staff", "people", "leadership", "management", "board"],
    "services": ["service", "menu", "product", "solution", "what-we-do", "capability", "expertise"],
    "partners": ["partner", "client", "certif", "affiliat", "membership"],
    "blog": ["blog", "news", "update", "press", "insight", "article"],
}
SITEMAP_WORDS = ["contact", "about", "team", "staff", "management", "leadership", "company", "owner", "founder", "board", "executive", "personnel", "location", "find", "directory", "people"]


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def visible_text(html: Column) -> Column:
    """Tags and hidden blocks as spaces, white space joined: the native form."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe)[^>]*>.*?</(script|style|noscript|iframe)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def is_parked(html: Column) -> Column:
    return contains_any(F.lower(html), PARKED)


def site_status(code: Column, html: Column, url: Column) -> Column:
    """none, active or dead, from the answer's code; null code stands for no answer."""
    up = F.when(code < 400, F.when(is_parked(html), "dead").otherwise("active")).when(code == 429, "active").otherwise("dead")
    return F.when(F.coalesce(url == "", F.lit(True)), "none").otherwise(F.coalesce(up, F.lit("dead")))


def fetch_outcome(code: Column, html: Column) -> Column:
    """An empty page is taken for a challenge that wasn't met."""
    head = F.lower(F.substring(html, 1, 4000))
    return F.when(F.coalesce(html == "", F.lit(True)) | contains_any(head, CHALLENGES) | code.isin(401, 403, 429), "blocked").when(code >= 500, "target_down").when(code >= 400, "reject").otherwise("ok")


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))


def page_kind(url: Column) -> Column:
    """home, the first kind of which a word is in the path, contact for contact paths, else other."""
    path = path_of(url)
    out = F.when(path.isin("", "/"), "home")
    for kind in PATHS:
        out = out.when(contains_any(path, PAGE_WORDS[kind]), kind)
    return out.when(F.rtrim(path, F.lit("/")).isin(CONTACT_PATHS), "contact").otherwise("other")


def serves(url: Column, kind: str) -> Column:
    """Whether the page is read for this kind of fact."""
    return contains_any(path_of(url), PAGE_WORDS[kind])


def path_order(url: Column, paths: list[str]) -> Column:
    """Place of the page in a list of paths, from 1; 0 for the home page, null where it has none."""
    path = F.rtrim(path_of(url), F.lit("/"))
    at = F.array_position(F.array(*(F.lit(p) for p in paths)), path)
    return F.when(path == "", 0).otherwise(F.when(at > 0, at.cast("int")))


def sitemap_relevant(url: Column) -> Column:
    return contains_any(path_of(url), SITEMAP_WORDS)


def cms_of(html: Column) -> Column:
    """The first site builder in order with a mark in the page."""
    low = F.lower(html)
    return F.coalesce(*(F.when(contains_any(low, [m.lower() for m in marks]), name) for name, marks in CMS.items()))


def labels_in(html: Column, marks: dict[str, str]) -> Column:
    """Labels whose mark occurs, in order, once each."""
    low = F.lower(html)
    pairs = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(n).alias("n")) for m, n in marks.items()))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: F.contains(low, p["m"])), lambda p: p["n"]))


def social_link(html: Column, site: str) -> Column:
    hit = F.regexp_extract(html, f"(?i)({SOCIAL[site]})", 1)
    return F.when(hit != "", F.regexp_replace(hit, "/+$", ""))


def name_on_site(name: Column, html: Column) -> Column:
    """All words of the name occur in the page."""
    low = F.lower(html)
    return F.coalesce((F.trim(name) != "") & F.forall(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: F.contains(low, w)), F.lit(False))


#: How pages tell a founding year, and how many people work there.
FOUNDED = [
    r"(?i:(?:founded|established|incorporated|started|opened|launched|since)\s+(?:in\s+)?)(\d{4})",
    r"(?i:copyright\s+(?:©\s*)?(\d{4})(?:\s*[-–]\s*\d{4})?)",
    r"(?i:(?:serving|operating|in\s+business)\s+(?:since|for\s+over)\s+)(\d{4})",
    r"(?i:(?:year\s+(?:established|founded)|est\.)\s*[:.]?\s*)(\d{4})",
]
FOUNDED_SCHEMA = r"""(?i)(?:"foundingDate"\s*:\s*|foundingDate["']?\s*[:=]\s*)"?(\d{4})"""
COPYRIGHT_RANGE = r"(?i)copyright\s+(?:©\s*)?(\d{4})\s*[-–]\s*\d{4}"
#: Phrases of staff; in the first and the last, groups but the number's don't capture here.
STAFF = [
    r"(?i:(?:we(?:'re| are)?\s+(?:a\s+)?)?team\s+of\s+)(\d{1,5})\s*(?:people|members|employees|professionals|staff)?",
    r"(?i:(\d{1,5})\s*\+\s*(?:employees|staff|people|team\s+members))",
    r"(?i:(?:over|more\s+than|about|approximately)\s+)(\d{1,5})\s*(?:employees|staff|people|team)",
    r"(?i:(\d{1,5})\s*(?:employees|staff\s+members|people\s+on\s+(?:staff|team)))",
    r"(?i:(?:our|a)\s+)(\d{1,5})\s*-\s*(?:person|member)\s+(?:team|company)",
    r"(?i:employ(?:s|ees)?\s+(?:over|about|approximately|more\s+than)?\s*)(\d{1,5})",
]
STAFF_SCHEMA = r"""(?i)(?:"numberOfEmployees"\s*:\s*|"numberOfEmployees"\s*}\s*:\s*|numberOfEmployees["']?\s*[:=]\s*)(\d{1,7})"""
STAFF_ITEM = [r"""(?i)<[^>]*itemprop=["']numberOfEmployees["'][^>]*content=["'](\d+)["']""", r"""(?i)<[^>]*content=["'](\d+)["'][^>]*itemprop=["']numberOfEmployees["']"""]
TEAM_CARDS = [("div", "team"), ("div", "member"), ("div", "profile"), ("div", "person"), ("div", "employee"), ("div", "staff"), ("li", "team"), ("li", "member"), ("article", "team"), ("article", "member")]
NOT_PEOPLE = ["Terms", "Service", "Privacy", "Policy", "Cookie", "Contact", "Search", "Submit", "Cancel", "Copyright", "All Rights", "Privacy Policy", "Terms Service"]


def founding_years(text: Column, year: int) -> Column:
    """Upper median of the plausible founding years that a text names."""
    years = F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in FOUNDED)), lambda y: y.cast("int"))
    ok = F.array_sort(F.filter(years, lambda y: y.between(1700, year - 1)))
    return F.get(ok, F.floor(F.size(ok) / 2).cast("int"))


def year_founded(html: Column, year: int, domain_year: Column | None = None) -> Column:
    """Founding year: structured data, else the median of what the page says, else the start of a
    copyright range, else the domain's year; what isn't from 1700 to ``year`` is none."""
    first = lambda p: F.regexp_extract(html, p, 1).try_cast("int")
    found = F.coalesce(first(FOUNDED_SCHEMA), founding_years(html, year), first(COPYRIGHT_RANGE), *([] if domain_year is None else [domain_year]))
    return F.when(found.between(1700, year), found)


def employee_count(html: Column) -> Column:
    """Staff from 1 to 50000: structured data, which decides where it is there, else the first
    pattern in order whose first match is in range."""
    first = lambda p: F.regexp_extract(html, p, 1).try_cast("int")
    schema = F.coalesce(*(first(p) for p in (STAFF_SCHEMA, *STAFF_ITEM)))
    said = F.coalesce(*(F.when(first(p).between(1, 50000), first(p)) for p in STAFF))
    found = F.coalesce(schema, said)
    return F.when(found.between(1, 50000), found)


def team_count(html: Column) -> Column:
    """People on a team page: the cards of the first kind of which there are two, else three or
    more distinct names of two words."""
    cards = [F.size(F.regexp_extract_all(html, F.lit(rf"""(?i)(<{tag}\b[^>]*\bclass\s*=\s*["'][^"']*{word})"""), F.lit(1))) for tag, word in TEAM_CARDS]
    names = F.array_distinct(F.regexp_extract_all(visible_text(html), F.lit(r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b"), F.lit(1)))
    people = F.size(F.array_except(names, F.array(*(F.lit(n) for n in NOT_PEOPLE))))
    return F.coalesce(*(F.when(n >= 2, n) for n in cards), F.when(people >= 3, people))


def meta_description(html: Column) -> Column:
    """og:description, then description, then twitter:description, over 20 characters; the
    attributes may come in any order."""
    def one(prop: str, attr: str) -> Column:
        name, content = rf"""\b{attr}\s*=\s*["']{prop}["']""", r"""\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
        tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1))
        own = F.transform(F.filter(tags, lambda t: t.rlike("(?i)" + name)), lambda t: F.trim(F.concat(F.regexp_extract(t, "(?i)" + content, 1), F.regexp_extract(t, "(?i)" + content, 2))))
        return F.get(F.filter(own, lambda d: F.length(d) > 20), F.lit(0))

    return F.coalesce(*(one(p, a) for p in ("og:description", "description", "twitter:description") for a in ("name", "property")))


def schema_description(html: Column) -> Column:
    """Description over 20 characters of the first JSON-LD object that has one."""
    items = F.flatten(F.transform(json_ld(html), _objects))
    found = F.filter(F.transform(items, lambda i: F.get_json_object(i, "$.description")), lambda d: F.length(d) > 20)
    return F.trim(F.get(found, F.lit(0)))


def _objects(block: Column) -> Column:
    """The objects of a JSON text that is an object or an array of them."""
    text = F.trim(block)
    listed = F.from_json(text, "array<string>")
    out = F.when(F.startswith(text, F.lit("[")), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(text))
    return F.filter(out, lambda o: F.startswith(F.trim(o), F.lit("{")))


def json_ld_items(html: Column) -> Column:
    """The objects in a page's JSON-LD: blocks and arrays of them, with what their ``data``,
    ``@graph`` or ``itemListElement`` (its ``item``, if any) holds in place of a mere wrapper."""
    def parts(o: Column) -> Column:
        inner = lambda path: F.get_json_object(o, path)
        data = F.when(F.startswith(inner("$.data"), F.lit("{")), F.array(inner("$.data"))).otherwise(F.array().cast("array<string>"))
        element = F.transform(_objects(inner("$.itemListElement")), lambda e: F.coalesce(F.get_json_object(e, "$.item"), e))
        held = F.when(inner("$.@graph").isNotNull(), _objects(inner("$.@graph"))).when(inner("$.itemListElement").isNotNull(), element).otherwise(F.array(o))
        return F.concat(data, held)

    return F.flatten(F.transform(F.flatten(F.transform(json_ld(html), _objects)), parts))


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks of a page as strings, the type in double, single or no quotes."""
    kind = r"""type\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?=[\s/>]))"""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script\b[^>]*?\b{kind}[^>]*>(.*?)</script>"), F.lit(1))


def sitemap_locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.trim(u))


def canonical_website(url: Column) -> Column:
    """The target of a search redirect (two levels), without tracking parameters; what is left
    keeps its order, and the fragment stays."""
    def unwrap(u: Column) -> Column:
        inner = F.regexp_extract(u, r"^https?://(?:[^/?#]*\.)?google\.com/(?:maps/)?url\?(?:[^#]*&)?(?:q|url)=([^&#]+)", 1)
        return F.when(inner != "", F.coalesce(F.try_url_decode(inner), u)).otherwise(u)

    u = unwrap(unwrap(url))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^utm_|^gclid(=|$)")), "&")
    head, tail = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, "(#.*)$", 1)
    return F.concat(head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), tail)
