"""Surrogates for personal data (operator 5).

Entities are found by pattern: e-mail addresses, in any script, phone numbers, IPv4 and IPv6
addresses, payment card, social security and bank account numbers, secret tokens, keys and
private-key blocks, and the parts of personal names after a form of address, a doctor's title or
words that introduce a name, or with a known given name. Particles of a name (``von``, ``de``)
stay as they are. Each distinct entity of the corpus gets one replacement of its own type,
made from a keyed hash (HMAC-SHA256) of its canonical form: names keep gender and script,
numbers keep layout, card numbers keep their check digit valid or not, account numbers country
and a valid check, keys their prefix, tokens their alphabet. Family names, and given names once
the known ones are taken, are put together from syllables of their script.
Replacements are checked against each other and against all real values of the type; the
loser of a collision tries its next hash, until none is left, so distinct entities stay
distinct and equal ones equal in all documents. Given and family names are replaced one by
one, and names found in a document are replaced wherever they stand alone in it, so a mention
by family name alone still points to the same person.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlink.llm.common import fresh, materialize, spread_join

#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Anna Barbara Clara Elena Elizabeth Emily Emma Eva Greta Helen Ines Jennifer Jessica Julia Karen Karin Laura Linda Lucia Maria Marta Mary Nancy Nora Olga Patricia Paula Rosa Sarah Sofia Susan Vera".split(),
    ("m", "latin"): "Adam Bruno Carl Charles Daniel David Erik Felix Georg George Hugo Ivan Jakob James John Joseph Karl Leon Martin Michael Niels Oscar Paul Peter Richard Robert Simon Thomas Viktor William".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Нина Ольга Софья".split(),
    ("m", "cyrillic"): "Борис Виктор Иван Лев Максим Олег Павел Сергей".split(),
    ("f", "greek"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος".split(),
}
#: First letters, vowels and last letters of syllables by script; endings of names by script and kind.
SYLLABLES = {
    "latin": (["b", "br", "d", "dr", "f", "g", "gr", "h", "k", "kl", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v", "w", "z"], ["a", "e", "i", "o", "u", "ei"], ["", "l", "n", "r", "s", "m"]),
    "cyrillic": (["б", "в", "г", "гр", "д", "з", "к", "кр", "л", "м", "н", "п", "р", "с", "ст", "т", "тр"], ["а", "е", "и", "о", "у"], ["", "л", "н", "р", "с", "м"]),
    "greek": (["β", "γ", "δ", "κ", "κρ", "λ", "μ", "ν", "π", "ρ", "σ", "στ", "τ", "φ"], ["α", "ε", "ι", "ο"], ["", "λ", "ν", "ρ"]),
}
ENDINGS = {
    ("family", "latin"): ["berg", "son", "mann", "ini", "ez", "eau", "sen", "er", "ard", "oli"], ("family", "cyrillic"): ["ов", "ев", "ин", "ский"], ("family", "greek"): ["ίδης", "όπουλος", "άκης", "ίου"],
    ("f", "latin"): ["a", "ina", "ella", "ine"], ("m", "latin"): ["o", "us", "an", "ert"], ("f", "cyrillic"): ["а", "ина", "ия"], ("m", "cyrillic"): ["ан", "ий", "ор"], ("f", "greek"): ["ία", "ούλα"], ("m", "greek"): ["ος", "άς"],
}
#: Forms of address by gender.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κυρία"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Κύριος"], "u": ["Dr", "Prof", "Doctor", "Professor"]}
#: Words before a name that tell no gender; particles inside one.
INTRODUCTIONS = ["My name is", "my name is", "Sincerely,", "sincerely,", "Kind regards,", "kind regards,", "Best regards,", "best regards,", "Contact person:", "contact person:"]
PARTICLES = ["von", "van", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "al", "bin", "ibn", "zu"]

_CAPITAL = r"[^\W\d_a-zà-ÿа-яά-ώ]"
_NAME = rf"{_CAPITAL}(?:[^\W\d_]+|(?=['’]{_CAPITAL}))(?:['’]{_CAPITAL}[^\W\d_]+)?"
_FAMILY = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME}"
_GENDER_OF = {t: g for g, ts in TITLES.items() for t in ts} | {n: g for (g, _), ns in GIVEN.items() for n in ns}
_EMAIL = re.compile(r"(?P<email>(?<![\w.%+-])[\w.%+-]+@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)+)")
_IPV6 = re.compile(r"(?<![\w:.])(?P<ipv6>[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:])")
#: A stretch that may hold a number, and the kinds of numbers inside it.
_DIGITS = re.compile(r"[+\d][\d .()-]{5,}")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d+])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<phone>(?<![\w+])\+?\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w))"
)
_HEX = re.compile(r"[0-9A-Fa-f]{32}")
_TOKEN = re.compile(r"(?<![0-9A-Za-z])(?P<token>[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])")
#: Prefixes of cloud, code host, chat and model service keys, with what follows.
_KEY = re.compile(r"(?<![0-9A-Za-z])(?P<key>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abp]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z_-]{20,})(?![0-9A-Za-z])")
_BLOCK = re.compile(r"-----(BEGIN|END) [A-Z ]{0,20}PRIVATE KEY-----")
KINDS = ("email", "ip", "ipv6", "block", "ssn", "card", "phone", "iban", "key", "token", "person")
_GIVEN_ALL = {n for ns in GIVEN.values() for n in ns}
_TITLE_ALL = sorted({t for ts in TITLES.values() for t in ts}, key=len, reverse=True)
_WORD = re.compile(r"\w+")
#: The first run of word characters of all that a person can begin with.
_TRIGGERS = {_WORD.match(t).group() for t in (*_GIVEN_ALL, *_TITLE_ALL, *(w.rpartition(" ")[0] or w for w in INTRODUCTIONS))}
_PERSON = re.compile(
    rf"(?<!\w)(?P<person>(?:{'|'.join(map(re.escape, _TITLE_ALL))})\.? (?:{_NAME} )?{_FAMILY}(?: {_NAME})?"
    rf"|(?:{'|'.join(map(re.escape, INTRODUCTIONS))})\s{_NAME} {_FAMILY}|(?:{'|'.join(sorted(_GIVEN_ALL))}) {_FAMILY})(?!\w)"
)
_BARE = re.compile(rf"(?<!\w){_NAME}(?!\w)")


def _is_ipv6(m: re.Match) -> bool:
    """Whether the string is an address and not a time or a name with colons."""
    try:
        ipaddress.IPv6Address(m.group())
    except ValueError:
        return False
    return any(c.isdigit() for c in m.group()) and len(m.group()) > 5


def _blocks(text: str) -> Iterator[re.Match]:
    """Private-key blocks, from each first line to the next last line."""
    start = None
    for m in _BLOCK.finditer(text):
        if m.group(1) == "BEGIN":
            start = m if start is None else start
        elif start is not None:
            yield re.compile(r"(?s)(?P<block>.*)").fullmatch(text, start.start(), m.end())
            start = None


def _matches(text: str) -> Iterator[re.Match]:
    """Matches of all kinds; each pattern runs only where a cheap sign of it is seen."""
    if "@" in text:
        yield from _EMAIL.finditer(text)
    for m in _DIGITS.finditer(text):
        yield from _NUMBER.finditer(text, m.start(), m.end() + 1)
    yield from (m for m in _IBAN.finditer(text) if iban_check(m.group().replace(" ", "")) == 1)
    yield from _KEY.finditer(text)
    if "::" in text or text.count(":") > 6:
        yield from filter(_is_ipv6, _IPV6.finditer(text))
    if "PRIVATE KEY-----" in text:
        yield from _blocks(text)
    if _HEX.search(text):
        yield from _TOKEN.finditer(text)
    if not _TRIGGERS.isdisjoint(_WORD.findall(text)):
        yield from _PERSON.finditer(text)


def script_of(name: str) -> str:
    c = ord(name[0])
    return "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "cyrillic" if 0x400 <= c < 0x530 else "latin"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_check(value: str) -> int:
    """Remainder of an account number by 97; 1 is valid."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) in text order, not overlapping."""
    out, end = [], 0
    for m in sorted(_matches(text), key=lambda m: (m.start(), -m.end())):
        if m.start() < end:
            continue
        end = m.end()
        kind = next(k for k in KINDS if m.groupdict().get(k))
        found = m.group(kind)
        if kind == "person":
            intro = next((w for w in INTRODUCTIONS if found.startswith(w)), "")
            words = [p for p in re.finditer(r"\S+", found) if p.start() >= len(intro) and p.group() not in PARTICLES]
            title = "" if intro else words[0].group().rstrip(".")
            parts = words if intro or title in _GIVEN_ALL else words[1:]
            gender = _GENDER_OF.get(title, "u")
            gender = _GENDER_OF.get(parts[0].group(), "u") if gender == "u" else gender
            for k, p in enumerate(parts):
                last = k == len(parts) - 1
                name = p.group()
                own = f"family_{script_of(name)}" if last else f"given_{gender}_{script_of(name)}"
                out.append((m.start() + p.start(), m.start() + p.end(), own, name.casefold()))
        elif kind == "iban":
            out.append((m.start(), m.end(), kind, found.replace(" ", "")))
        elif kind in ("card", "phone", "ssn"):
            digits = re.sub(r"\D", "", found)
            out.append((m.start(), m.end(), kind if kind != "card" else "card_valid" if luhn(digits) else "card_other", digits))
        else:
            out.append((m.start(), m.end(), kind, found if kind in ("token", "key", "block") else found.lower()))
    return _with_bare_names(text, out)


def _with_bare_names(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` and the capitalised words outside it that are names in it; one that is both a
    given and a family name counts as the family name."""
    names: dict[str, str] = {}
    for _, _, kind, value in found:
        if kind.startswith("family"):
            names[value] = kind
        elif kind.startswith("given"):
            names.setdefault(value, kind)
    if not names:
        return found
    out, k = [], 0
    for m in _BARE.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            out.append(found[k])
            k += 1
        value = m.group().casefold()
        if value in names and (k == len(found) or m.end() <= found[k][0]):
            out.append((m.start(), m.end(), names[value], value))
    return out + found[k:]


def _draw(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.new(key, f"{kind}\0{value}\0{attempt}\0{block}".encode(), hashlib.sha256).digest()
        block += 1


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The canonical replacement that the ``attempt``-th hash gives."""
    draw = _draw(key, kind, value, attempt)
    number = lambda n: (next(draw) << 16 | next(draw) << 8 | next(draw)) % n
    if kind == "ip":
        return ".".join(str(1 + number(254)) for _ in range(4))
    like = lambda s: "".join(str(number(10)) if c.isdigit() else chr((65 if c.isupper() else 97) + number(26)) if c.isalpha() else c for c in s)
    if kind == "ipv6":
        return "".join("0123456789abcdef"[number(15) + 1] if c in "0123456789abcdef" else c for c in value)
    if kind == "block":
        lines = value.split("-----")
        return "-----".join([*lines[:2], like(lines[2]), *lines[3:]])
    if kind == "ssn":
        return "9" + like(value[1:])
    if kind == "iban":
        body = like(value[4:])
        return f"{value[:2]}{98 - iban_check(value[:2] + '00' + body):02d}{body}"
    if kind == "key":
        keep = re.match(r"AKIA|ASIA|gh._|xox.-|sk-", value).end()
        return value[:keep] + like(value[keep:])
    if kind == "phone":
        keep = max(0, len(value) - 10)
        own = [str(number(10)) for _ in value[keep:]]
        own[0] = str(2 + number(8))
        if attempt < 4 and value[keep + 3 : keep + 6] == "555":
            own[3:6] = "555"
        return value[:keep] + "".join(own)
    if kind.startswith("card"):
        own = value[0] + "".join(str(number(10)) for _ in value[2:])
        check = next(d for d in "0123456789" if luhn(own + d))
        return own + (check if kind == "card_valid" else str((int(check) + 1 + number(9)) % 10))
    if kind == "token":
        letters = "0123456789ABCDEF" if value.upper() == value else "0123456789abcdef"
        return "".join(letters[number(16)] for _ in value)
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, _ = domain.partition(".")
        return f"{like(local)}{'x' * (attempt // 8)}@{like(host)}.example"
    script = kind.rsplit("_", 1)[1]
    pick = lambda xs: xs[number(len(xs))]
    gender = kind.split("_")[1] if kind.startswith("given") else None
    if gender == "u":
        gender = pick("fm")
    if gender and attempt < 2:
        return pick(GIVEN[gender, script]).casefold()
    syllable = lambda: "".join(pick(part) for part in SYLLABLES[script])
    return ("".join(syllable() for _ in range(1 + min(3, attempt // 4) + number(2))) + pick(ENDINGS[gender or "family", script])).casefold()


def _shaped(kind: str, found: str, new: str) -> str:
    """The canonical replacement in the layout of the found string."""
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in found)
    if kind in ("phone", "ssn", "card_valid", "card_other"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in found)
    if kind.startswith(("given", "family")):
        return new.upper() if found.isupper() else new.title()
    return new.upper() if kind in ("email", "ipv6") and found.isupper() else new


def assign(values: DataFrame, key: bytes) -> DataFrame:
    """``(kind, value, new)``: one replacement for each distinct value, none taken twice within
    its kind and none equal to a real value of the kind."""

    def try_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(key, k, v, n) for k, v, n in rows], pa.string())], names=["kind", "value", "attempt", "new"])

    real = values.select("kind", F.col("value").alias("new"))
    left, taken, done = values.withColumn("attempt", F.lit(0)), real, None
    while True:
        tried = materialize(left.mapInArrow(try_next, "kind string, value string, attempt int, new string"), "pii-tried")
        winners = tried.groupBy("kind", "new").agg(F.min("value").alias("value")).join(taken, ["kind", "new"], "left_anti")
        won = materialize(winners.select("kind", "value", "new"), "pii-won")
        done = won if done is None else done.unionByName(won)
        taken = taken.unionByName(won.select("kind", "new"))
        left = tried.join(won, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        left = materialize(left, "pii-left")
        if left.isEmpty():
            return done


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the column ``n_entities`` added.

    Null texts stay null with no entities; empty tables, texts without entities and rows with
    null or repeated ids pass unchanged; equal texts get equal replacements; other columns pass
    through, except that one named ``n_entities`` gives way.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    th, known_ = fresh(docs, "__th"), fresh(docs, "__map")
    keyed = docs.select(*(F.col(f"`{c}`") for c in columns), F.xxhash64("text").alias(th))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({e[2:] for e in entities(t)}) if t else [] for t in b.column(1).to_pylist()]
            hashes = [h for h, f in zip(b.column(0).to_pylist(), found, strict=True) for _ in f]
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string())], names=[th, "kind", "value"])

    # A text's entities depend on the text alone, so its hash is key enough, and copies meet here.
    mentions = keyed.select(th, "text").mapInArrow(detect, f"`{th}` bigint, kind string, value string")
    mentions = materialize(mentions.distinct(), "pii-mentions")
    values = materialize(mentions.groupBy("kind", "value").agg(F.count("*").alias("n")), "pii-values")
    mapping = assign(values.select("kind", "value"), key)
    by_text = spread_join(mentions, mapping, ["kind", "value"], values, [th]).groupBy(th).agg(F.collect_list(F.struct("kind", "value", "new")).alias(known_))
    # Texts without entities travel too, so copies are counted over all rows.
    copies = materialize(keyed.groupBy(th).agg(F.count("*").alias("n")).where("n > 1"), "pii-copies")
    both = spread_join(keyed, by_text, [th], copies, [c for c in columns if c == "doc_id"] or [th], "left").drop(th)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_entities bigint"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, count = [], []
            for text, known in zip(b.column("text").to_pylist(), b.column(known_).to_pylist(), strict=True):
                if not known:
                    out.append(text)
                    count.append(0)
                    continue
                new = {(m["kind"], m["value"]): m["new"] for m in known}
                parts, at, found = [], 0, entities(text)
                for start, end, kind, value in found:
                    parts += [text[at:start], _shaped(kind, text[start:end], new[kind, value])]
                    at = end
                out.append("".join([*parts, text[at:]]))
                count.append(len(found))
            yield pa.RecordBatch.from_arrays([*(pa.array(out, pa.string()) if c == "text" else b.column(c) for c in columns), pa.array(count, pa.int64())], names=[*columns, "n_entities"])

    return both.mapInArrow(apply, schema)
