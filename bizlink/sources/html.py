"""Structure of landed pages: one pass of the standard parser per page, many columns out."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bizlink.functions import contact as C
from bizlink.functions import pages as P

HIDDEN = {"script", "style", "noscript", "iframe"}
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Words of partnership.
PARTNER_WORDS = ["partner", "client", "certified", "affiliate", "member", "sponsor", "accredited", "authorized", "distributor", "reseller"]
#: Fixed value: what reads like a company's name.
COMPANY = re.compile(r"\b[A-Z][A-Za-z0-9\s&.]+(?:Inc|LLC|Ltd|Corp|Group|Solutions|Technologies|Systems|Services)\b")
#: Fixed value: headings of services.
SERVICE_HEADING = re.compile(r"(?i)(?:our\s+)?(?:services?|products?|solution|what\s+we\s+do|speciali(?:ze|se)s?|offer(?:ings)?|capabilities?|expertise)")
#: Sentences of services.
SERVICE_SENTENCES = [
    r"(?i:(?:we\s+)?(?:offer|provide|specializ(?:e|se)\s+in|deliver)\s+)(.+?)(?:\.\s*(?:We|Our|Call|Contact|Learn|Get))",
    r"(?i:(?:our\s+)?(?:services|products|solutions)\s+(?:include|are|cover|range\s+from)\s+)(.+?)(?:\.\s*(?:We|Our|Call|Contact))",
]
#: Where lists of services stand.
SERVICE_LISTS = [
    ("div", "class", "service"), ("ul", "class", "service"), ("div", "class", "product"), ("ul", "class", "product"), ("div", "id", "service"), ("ul", "id", "service"), ("div", "class", "solution"),
    ("div", "class", "offering"), ("div", "class", "capability"), ("div", "class", "menu"), ("ul", "class", "menu"), ("div", "id", "menu"), ("ul", "id", "menu"), ("div", "class", "food"),
    ("div", "class", "drink"), ("section", "class", "menu"), ("section", "id", "menu"), ("div", "class", "specialty"), ("div", "class", "category"), ("div", "class", "feature"), ("div", "class", "offer"),
]
#: Where people stand, and the parts of their boxes.
TEAM_BOXES = [("div", "class", w) for w in ("team", "member", "profile", "person", "employee", "staff")] + [("li", "class", w) for w in ("team", "member", "person")] + [("article", "class", w) for w in ("team", "member")]
TEAM_PARTS = [("h3", "p"), ("h4", "p"), ("h3", "span"), ("h4", "span"), ("strong", "span")]
#: Fixed value: a sentence that names a person and a title.
TEAM_SENTENCE = re.compile(r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\s*[—–,-]\s*([A-Za-z\s/]+?)(?=[,.\n]|$)")
#: Titles of owners; headings that are none of posts; words that make a line weigh more.
OWNER_TITLES = ["owner", "founder", "co-founder", "ceo", "president", "proprietor", "managing director", "principal", "managing partner", "executive director", "general manager"]
NOT_TITLES = ["recent post", "latest news", "archive", "category", "tag", "search"]
SUMMARY_WORDS = ["specializ", "mission", "vision", "dedicated", "expert", "service", "solution", "provide", "offer", "client", "partner", "deliver"]
#: Cards of a results page, and where a card and a page of one business have their facts.
CARDS = [("div", "class=", "hf-box"), ("div", "class=", "company-card"), ("li", "class=", "search-result"), ("div", "class", "business"), ("article", None, None), ("div", "class=", "search-result-item"), ("div", "class=", "result")]
CARD_PHONES = [("a", "href^", "tel:"), ("*", "class", "phone"), ("*", "class", "tel")]
CARD_ADDRESSES = [("span", "class=", "small"), ("*", "class", "address"), ("*", "class", "location")]
DETAIL_NAMES = [("h1", None, None), ("*", "class", "business-name"), ("*", "class", "company-name"), ("h2", None, None)]
DETAIL_TEXTS = [("*", "class=", "description"), ("*", "class=", "company-description"), ("*", "class", "about"), ("*", "class", "description")]
NOT_ADDRESSES = ["Is this your", "Claim this", "Sponsored", "Ad"]
SOCIAL_SITES = {"facebook": ["facebook.com"], "instagram": ["instagram.com"], "twitter": ["twitter.com", "x.com"], "linkedin": ["linkedin.com"]}
LISTING = "struct<name: string, address: string, phone: string, website: string, description: string, url: string, social_facebook: string, social_instagram: string, social_twitter: string, social_linkedin: string>"
SCHEMA = f"text string, summary string, services array<string>, partners array<string>, team array<struct<name: string, title: string>>, owner_title string, post_titles array<string>, cards array<{LISTING}>, detail {LISTING}"


#: An open element that the start of another ends, and where that stops.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    """An element: tag, attributes, parent, and its place among its parent's children. Its
    subtree is a slice of the page's elements, and its text a slice of the page's text."""

    __slots__ = ("tag", "attrs", "kids", "up", "place", "page", "at", "end", "low", "high")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.kids, self.up, self.place = tag, attrs, [], up, 0

    def walk(self) -> list[Node]:
        return self.page.nodes[self.at : self.end]

    @property
    def size(self) -> int:
        """Length of the text."""
        return max(0, self.page.stops[self.high] - self.page.stops[self.low] - 1) if self.high > self.low else 0

    def words(self) -> str:
        """Visible text, white space joined."""
        return self.page.text[self.page.stops[self.low] : self.page.stops[self.low] + self.size]

    def fits(self, rule: tuple[str, str | None, str | None]) -> bool:
        tag, where, value = rule
        if tag not in ("*", self.tag):
            return False
        if where is None:
            return True
        found = self.attrs.get(where.rstrip("=^"), "")
        return value in found.split() if where.endswith("=") else found.startswith(value) if where.endswith("^") else value in found

    def each(self, rule: tuple[str, str | None, str | None]) -> Iterator[Node]:
        nodes = self.page.nodes
        if rule[1] is not None and rule[2] not in self.page.values.get(rule[1].rstrip("=^"), ""):
            return iter(())
        if rule[0] == "*":
            found = range(self.at + 1, self.end)
        else:
            places = self.page.by_tag.get(rule[0], [])
            found = places[bisect_left(places, self.at + 1) : bisect_left(places, self.end)]
        return (nodes[i] for i in found if nodes[i].fits(rule))

    def all(self, rule: tuple[str, str | None, str | None]) -> list[Node]:
        return list(self.each(rule))

    def first_text(self, rules: list, ok: Callable[[str], bool] = bool) -> str | None:
        return next((t for r in rules for t in (n.words() for n in self.each(r)) if ok(t)), None)


class Page:
    """The elements of a page in order with the slices of each, from one pass over the tree."""

    def __init__(self, top: Node) -> None:
        self.nodes: list[Node] = []
        self.by_tag: dict[str, list[int]] = {}
        found: dict[str, list[str]] = {}
        words: list[str] = []
        pieces: list[str] = []
        stack: list[tuple[Node | str, bool, bool]] = [(top, False, False)]
        while stack:
            k, hidden, done = stack.pop()
            if isinstance(k, str):
                words += [] if hidden else k.split()
                pieces += [] if hidden else [k.strip()]
            elif done:
                k.end, k.high = len(self.nodes), len(words)
            else:
                k.page, k.at, k.low = self, len(self.nodes), len(words)
                self.by_tag.setdefault(k.tag, []).append(k.at)
                self.nodes.append(k)
                for where, value in k.attrs.items():
                    found.setdefault(where, []).append(value)
                hidden = hidden or k.tag in HIDDEN
                stack.append((k, hidden, True))
                stack += [(c, hidden, False) for c in reversed(k.kids)]
        #: All values of an attribute in one text: what isn't in it fits no element.
        self.values = {where: "\n".join(each) for where, each in found.items()}
        self.text, self.raw = " ".join(words), " ".join(pieces)
        self.stops = [0, *accumulate(len(w) + 1 for w in words)]


class _Tree(HTMLParser):
    """Elements may be left unclosed: what ends them in a browser ends them here."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def _close(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.up
        self.open[node.tag] -= 1
        self.at = node.up

    def _end_before(self, tag: str) -> None:
        if tag in _HEADINGS and self.at.tag in _HEADINGS or tag in _BLOCKS and self.at.tag == "p":
            self._close(self.at)
        ended, within = _ENDS.get(tag, ((), ()))
        if any(self.open[t] for t in ended):
            node = last = self.at
            found = None
            while node.up is not None and node.tag not in within:
                if node.tag in ended:
                    found = node
                node = node.up
            if found is not None and last is not None:
                self._close(found)

    def handle_starttag(self, tag, attrs):
        self._end_before(tag)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        node.place = len(self.at.kids)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(self.at)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            node = node.up
        self._close(node)

    def handle_data(self, data):
        if data.strip():
            self.at.kids.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    Page(parser.top)
    return parser.top


def _schema_services(top: Node) -> list[str]:
    """Names of services and products in JSON-LD, down to five levels."""
    out: list[str] = []

    def look(value: object, depth: int) -> None:
        if depth > 5:
            return
        if isinstance(value, dict):
            name = value.get("name", "")
            if value.get("@type") in ("Service", "Product") and isinstance(name, str) and len(name) > 2:
                out.append(name)
            value = list(value.values())
        if isinstance(value, list):
            for v in value:
                look(v, depth + 1)

    for script in top.all(("script", "type=", "application/ld+json")):
        try:
            look(json.loads("".join(k for k in script.kids if isinstance(k, str))), 0)
        except ValueError:
            continue
    return list(dict.fromkeys(out))[:15]


def _told_services(top: Node, text: str) -> list[str]:
    """Services from sentences, from lists under telling headings, and from lists in telling boxes."""
    out = []
    for pattern in SERVICE_SENTENCES:
        m = re.search(pattern, text)
        for part in re.split(r"\s*(?:,|\s+and\s+|\s+or\s+)\s*", m.group(1)[:300]) if m else []:
            out += [s for s in [part.strip().strip(".,;:!?").strip()] if 3 < len(s) < 80]
    heads = (n for n in top.walk() if n.tag in ("h2", "h3", "h4") and SERVICE_HEADING.search(n.words()))
    boxes = {}
    for box in (h.up for h in heads):
        while box.up is not None and box.up.up is not None and box.tag not in ("section", "div", "article"):
            box = box.up
        boxes[box.at] = box
    told = dict.fromkeys(out)
    for box in [*boxes.values(), *(b for rule in SERVICE_LISTS for b in top.each(rule))]:
        for li in box.each(("li", None, None)):
            if 3 < li.size < 100:
                told.setdefault(li.words())
            if len(told) >= 20:
                break
    return list(told)[:20]


def _partners(top: Node) -> list[str]:
    """Alternative texts of images in a context of partnership, and company names in short texts of one."""
    told = lambda t: any(w in t.lower() for w in PARTNER_WORDS)
    out = []
    # Some box around an image tells of partnership if the page does: the outermost holds all.
    anywhere = told(top.words())
    for img in top.each(("img", "alt", "")):
        alt = img.attrs.get("alt", "").strip()
        if len(alt) > 2 and not re.match(r"^[a-z][a-z0-9.-]+\.[a-z]{2,}$", alt):
            out += [alt] if anywhere or told(alt) else []
    for n in top.walk():
        text = n.words() if n.tag in ("li", "div", "span") and 0 < n.size <= 100 else ""
        if text and told(text):
            out += [c.strip() for c in COMPANY.findall(text) if len(c.strip()) > 3]
    return list({p.lower(): p for p in reversed(out)}.values())[::-1][:20]


def _team(top: Node, text: str) -> tuple[list[tuple[str, str]], str | None]:
    """People with titles, and the first title that is an owner's."""
    people: list[tuple[str, str]] = []
    for rule in TEAM_BOXES:
        boxes = top.all(rule)
        for box in boxes if len(boxes) >= 2 else []:
            for a, b in TEAM_PARTS:
                name, title = (next(box.each((tag, None, None)), None) for tag in (a, b))
                if name and title:
                    name, title = name.words(), title.words()
                    people += [(name, title)] if 4 < len(name) < 60 and 2 < len(title) < 80 else []
                    break
        if people:
            break
    if not people:
        pairs = ((m.group(1).strip(), m.group(2).strip()) for m in TEAM_SENTENCE.finditer(text))
        people = [(n, t) for n, t in pairs if 4 < len(n) < 60 and 2 < len(t) < 60]
    people = list(dict.fromkeys(people))
    owner = next((t for _, t in people if any(w in t.lower() for w in OWNER_TITLES)), None)
    return people[:20], owner


def _socials(links: list[Node]) -> dict[str, str]:
    found: dict[str, str] = {}
    for a in links:
        href = a.attrs.get("href", "")
        site = next((s for s, hosts in SOCIAL_SITES.items() if any(h in href.lower() for h in hosts)), None)
        if site:
            found.setdefault(f"social_{site}", href)
    return found


def _cards(top: Node) -> list[dict]:
    """Listings of a results page: the first kind of card that there is."""
    boxes = next((b for b in (top.all(r) for r in CARDS) if b), [])
    out = []
    for box in boxes:
        links = [a for a in box.all(("a", None, None)) if a.words()]
        profile = [a for a in links if "/company/" in a.attrs.get("href", "")]
        named = [a for a in links if a.up.tag in ("h2", "h3") or "business-name" in a.attrs.get("class", "")]
        link = next((a for a in [x for x in profile if x in named] + profile + named), None)
        if link is None:
            continue
        address = box.first_text(CARD_ADDRESSES, lambda t: bool(t) and not any(w in t for w in NOT_ADDRESSES))
        street = [box.first_text([("*", "class", c)]) for c in ("street-address", "locality")]
        site = next((a.attrs.get("href") for a in links if "website" in a.attrs.get("class", "")), None)
        out.append({"name": link.words(), "address": ", ".join(filter(None, street)) or address, "phone": box.first_text(CARD_PHONES), "website": site, "url": link.attrs.get("href")})
    return out


def _detail(top: Node) -> dict | None:
    """One business from a page of its own: heading, text, labelled facts, social links."""
    out: dict[str, str | None] = {"name": top.first_text(DETAIL_NAMES), "description": top.first_text(DETAIL_TEXTS)}
    links: list[Node] = []
    following: dict[int, dict[int, Node]] = {}
    for dt in top.each(("dt", None, None)):
        if dt.up.at not in following:
            dd, own = None, following.setdefault(dt.up.at, {})
            for k in reversed([k for k in dt.up.kids if isinstance(k, Node) and k.tag in ("dt", "dd")]):
                dd = k if k.tag == "dd" else dd
                own[k.at] = dd
        dd = following[dt.up.at][dt.at]
        if dd is None:
            continue
        label, own = dt.words().lower(), dd.all(("a", None, None))
        if "website" in label:
            site = own[0].attrs.get("href", "") if own else ""
            if site and not _socials(own[:1]):
                out["website"] = site
        elif "social" in label or "media" in label:
            links += own
        elif "phone" in label:
            out.setdefault("phone", dd.words())
        elif "address" in label:
            out.setdefault("address", dd.words())
    out |= _socials(links) or _socials(top.all(("a", None, None)))
    return out if out["name"] else None


def _summary(page: Page, most: int = 500) -> str | None:
    """The weightiest lines of over 40 characters that fit into ``most`` together; lines end
    where the text itself has line ends, not at tags. Nothing up to 40 characters."""
    lines = [t for t in (line.strip() for line in page.raw.split("\n")) if len(t) > 40]
    weight = lambda s: len(s) * (1.5 if any(w in s.lower() for w in SUMMARY_WORDS) else 1)
    taken: list[str] = []
    for line in sorted(lines, key=weight, reverse=True):
        if sum(map(len, taken)) + len(line) > most:
            break
        taken.append(line)
    text = " ".join(taken)
    return text if len(text) > 40 else None


def parse_page(html: str | None) -> dict:
    top = tree(html)
    text = top.words()
    summary = _summary(top.page)
    people, owner = _team(top, text)
    titles = [t for t in (n.words() for n in top.walk() if n.tag in ("h1", "h2", "h3", "h4") and 10 < n.size < 150) if not any(w in t.lower() for w in NOT_TITLES)]
    return {
        "text": text, "summary": summary, "services": _schema_services(top) or _told_services(top, text), "partners": _partners(top),
        "team": [{"name": n, "title": t} for n, t in people], "owner_title": owner, "post_titles": titles[:10], "cards": _cards(top), "detail": _detail(top),
    }


#: Pages whose parsed parts a task holds at a time.
HELD_PAGES = 64


def parse_pages(pages: DataFrame) -> DataFrame:
    """Add the columns of ``SCHEMA``; one Arrow pass, other columns unchanged. What is parsed goes
    out after every few pages, so a task holds no more of it whatever the size of a batch."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    made = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, HELD_PAGES):
                part = batch.slice(lo, HELD_PAGES)
                parsed = [parse_page(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([p[f.name] for p in parsed], f.type) for f in made)], names=[*part.schema.names, *made.names])

    return pages.mapInArrow(run, f"{fields}, {SCHEMA}")


def roll_up(parsed: DataFrame, lead: str, most: int) -> DataFrame:
    """Facts of a lead from its first ``most`` pages, home page first, then by kind and address:
    the first found summary, services and team, partners of all these pages once each."""
    kind = P.page_kind(F.col("url"))
    w = Window.partitionBy(lead).orderBy((kind != "home").cast("int"), (kind == "other").cast("int"), "url", "page_id")
    few = parsed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    first = lambda c: F.min_by(c, F.when(F.size(c) > 0, F.col("_n")))
    return few.groupBy(lead).agg(F.count("*").alias("pages"), F.min_by("summary", F.when(F.col("summary").isNotNull(), F.col("_n"))).alias("summary"), first("services").alias("services"), first("team").alias("team"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("partners")))).alias("partners"))


#: Paths that are tried though the home page isn't there.
HIGH_VALUE = ["/contact", "/contact-us", "/about", "/about-us", "/locations"]


def contact_roll_up(pages: DataFrame, lead: str, domain: str, most: int = 10, most_emails: int = 20) -> DataFrame:
    """Contacts of a lead from its pages in order: home, contact paths, then pages that a sitemap
    would tell, each by address. Reading ends after the page by which an owner and an address
    of medium rank or better are known, or ``most_emails`` addresses, or ``most`` pages.

    Columns only; per lead the pages are few, and running counts say where reading ended.
    """
    place = P.path_order(F.col("url"), P.CONTACT_PATHS)
    order = F.coalesce(place, F.when(P.sitemap_relevant(F.col("url")), len(P.CONTACT_PATHS) + 1))
    path = F.rtrim(P.path_of(F.col("url")), F.lit("/"))
    facts = pages.select(F.col(lead), F.col(domain).alias("_d"), "url", order.alias("_o"), path.isin(HIGH_VALUE).alias("_high"), C.harvest_emails(F.col("html")).alias("emails"), C.owner_name(P.visible_text(F.col("html"))).alias("owner")).where("_o is not null")
    facts = facts.withColumn("best", F.array_max(F.transform("emails", lambda e: C.email_score(e, F.col("_d")))))
    home = F.min("_o").over(Window.partitionBy(lead)) == 0
    facts = facts.withColumn("_home", home).where("_home or _high")
    w = Window.partitionBy(lead).orderBy("_o", "url")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.coalesce(F.max("owner").over(upto).isNotNull() & (F.max("best").over(upto) >= 40), F.lit(False))
    ends = (F.col("_o") > 0) & (known | (F.sum(F.size("emails")).over(upto) >= most_emails) | (F.row_number().over(w) >= most))
    read = facts.withColumn("_n", F.row_number().over(w)).withColumn("_end", ends)
    read = read.withColumn("_over", F.coalesce(F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("not _over")
    emails = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", "emails"))), lambda x: x["emails"])))
    out = read.groupBy(lead).agg(F.count("*").alias("pages"), emails.alias("emails"), F.min_by("owner", F.when(F.col("owner").isNotNull(), F.col("_n"))).alias("owner"), F.first("_d").alias("_d"))
    best = F.get(F.array_sort(F.transform("emails", lambda e: F.struct((-C.email_score(e, F.col("_d"))).alias("s"), e.alias("e")))), F.lit(0))["e"]
    return out.select(lead, "pages", "emails", "owner", best.alias("best_email"))
