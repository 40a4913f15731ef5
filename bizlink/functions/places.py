"""Places: states, the location gate, location parsing, query tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of US states by abbreviation (fixed values).
STATES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut", "DE": "delaware", "FL": "florida", "GA": "georgia",
    "HI": "hawaii", "ID": "idaho", "IL": "illinois", "IN": "indiana", "IA": "iowa", "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland",
    "MA": "massachusetts", "MI": "michigan", "MN": "minnesota", "MS": "mississippi", "MO": "missouri", "MT": "montana", "NE": "nebraska", "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey",
    "NM": "new mexico", "NY": "new york", "NC": "north carolina", "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania", "RI": "rhode island", "SC": "south carolina",
    "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah", "VT": "vermont", "VA": "virginia", "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming", "DC": "district of columbia",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def region_of(location: Column) -> Column:
    """Second comma part of a location, trimmed, null without one."""
    parts = F.filter(F.transform(F.split(location, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(1)))


def state_of(region: Column) -> Column:
    """Abbreviation of a region given as abbreviation or name; null if it is neither."""
    named = F.try_element_at(_map({v: k for k, v in STATES.items()}), F.lower(region))
    return F.when(F.length(region) == 2, F.upper(region)).otherwise(named)


def location_matches(address: Column, location: Column) -> Column:
    """Whether an address may lie in the location's state; true where nothing can be judged."""
    abbr = state_of(region_of(location))
    full = F.try_element_at(_map(STATES), abbr)
    text = F.lower(address)
    word = F.regexp(text, F.concat(F.lit(r"(?U)\b"), F.lower(abbr), F.lit(r"\b")))
    hit = word | F.coalesce(F.contains(text, full), F.lit(False))
    return F.when(abbr.isNull() | ~F.coalesce(address != "", F.lit(False)), True).otherwise(hit)


def parse_location(location: Column) -> tuple[Column, Column]:
    """City without a leading direction, and state abbreviation."""
    city = F.trim(F.split_part(location, F.lit(","), F.lit(1)))
    city = F.regexp_replace(city, r"(?i)^(downtown|north|south|east|west|central)\s+", "")
    return city, state_of(region_of(location))


#: Words that say nothing about a niche.
NICHE_STOPWORDS = ["the", "and", "of", "in", "a", "best", "top", "local", "affordable", "near", "medical", "business", "businesses", "services", "service", "company", "near me", "good", "cheap"]


def taxonomy_term(niche: Column) -> Column:
    """The last telling word of a niche, to look a speciality up by; empty if there is none."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(niche, F.lit(""))), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) >= 3) & ~w.isin(NICHE_STOPWORDS))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


#: Query variants as (niche pattern, prefix of the city) (fixed values).
TILES = [("{}", None), *(("{}", p) for p in ("Downtown ", "North ", "South ", "East ", "West ", "Central ")), ("best {}", None), ("{} services", None), ("top {}", None)]


def query_tiles(jobs: DataFrame) -> DataFrame:
    """Ten (query, place) variants per job in order, equal ones once. The templates are ten
    literals, exploded; duplicates can only meet inside a job, so no shuffle is needed."""
    niche, loc = F.trim("niche"), F.col("location")
    city, region = F.trim(F.split_part(loc, F.lit(","), F.lit(1))), region_of(loc)
    variants = []
    for pattern, prefix in TILES:
        a, b = pattern.split("{}")
        place = loc if prefix is None else F.concat(F.lit(prefix), city, F.when(region.isNotNull(), F.concat(F.lit(", "), region)).otherwise(""))
        variants.append(F.struct(F.concat(F.lit(a), niche, F.lit(b)).alias("q"), place.alias("place")))
    each = jobs.withColumn("_v", F.array(*variants))
    keys = F.transform("_v", lambda v: F.lower(F.concat(v["q"], F.lit("\n"), v["place"])))
    each = each.withColumn("_k", keys).select(*jobs.columns, "_k", F.posexplode("_v").alias("tile", "_t"))
    fresh = F.array_position("_k", F.get("_k", F.col("tile"))) == F.col("tile") + 1
    return each.where(fresh).select(*jobs.columns, "tile", F.col("_t.q").alias("query"), F.col("_t.place").alias("place"))
