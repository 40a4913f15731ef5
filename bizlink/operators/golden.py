"""One golden record per cluster: per-field source priority, provenance, corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlink.functions.identity import is_blank, match_digits

#: Source order per field, best first (fixed values); a source not listed ranks last.
PRIORITY = {
    "default": ["google_maps", "npi", "hotfrog", "yellowpages", "yelp"],
    "phone": ["npi", "google_maps", "hotfrog", "yellowpages", "yelp"],
    "google_rating": ["google_maps", "yelp", "yellowpages"],
    "google_review_count": ["google_maps", "yelp", "yellowpages"],
    "description": ["google_maps", "hotfrog", "yelp", "yellowpages"],
}


def rank_of(source: Column, order: list[str]) -> Column:
    """Place of a source in an order, from 0; the length of the order if it isn't in it."""
    at = F.array_position(F.array(*(F.lit(s) for s in order)), source).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(order))


def _longest_first(ord_: Column, rank: Column, text: Column) -> Column:
    """Description rule folded in arrival order: a better source wins, then a longer text."""
    rows = F.array_sort(F.collect_list(F.when(~is_blank(text, "string"), F.struct(ord_.alias("o"), rank.alias("r"), text.alias("v")))))
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(None).cast("int").alias("r"))

    def step(acc: Column, x: Column) -> Column:
        better = (x["r"] < acc["r"]) | (F.length(x["v"]) > F.length(acc["v"]))
        take = acc["v"].isNull() | better
        return F.struct(F.when(take, x["v"]).otherwise(acc["v"]).alias("v"), F.when(take, x["r"]).otherwise(acc["r"]).cast("int").alias("r"))

    return F.aggregate(rows, start, step)["v"]


def golden_record(listings: DataFrame, fields: list[str], key: str = "cluster") -> DataFrame:
    """Merge the listings of each ``key``; rows need ``source`` and an arrival order ``ord``.

    A field takes its first non-blank value by (source rank, arrival); ``description`` may be
    displaced by a longer one; ``sources`` keeps first arrival, and ``phone_source_count`` says
    how many sources' last phones agree with the chosen one. One shuffle on ``key``; all
    aggregates but the two ordered lists combine before it.
    """
    types = dict(listings.dtypes)
    aggs = []
    for f in fields:
        rank = rank_of(F.col("source"), PRIORITY.get(f, PRIORITY["default"]))
        if f == "description":
            aggs.append(_longest_first(F.col("ord"), rank, F.col(f)).alias(f))
        else:
            value = F.when(~is_blank(F.col(f), types[f]), F.struct(rank.alias("r"), F.col("ord").alias("o"), F.col(f).alias("v")))
            aggs.append(F.min(value)["v"].alias(f))
    first = F.array_sort(F.collect_list(F.struct("ord", "source")))
    phones = F.array_sort(F.collect_list(F.struct("source", "ord", match_digits(F.col("phone")).alias("d"))))
    merged = listings.groupBy(key).agg(*aggs, first.alias("_order"), phones.alias("_phones"))
    sources = F.array_distinct(F.transform("_order", lambda x: x["source"]))
    # The last listing of a source is the one whose next neighbour has another source.
    last = F.filter("_phones", lambda x: ~F.exists("_phones", lambda y: (y["source"] == x["source"]) & (y["ord"] > x["ord"])))
    agree = F.size(F.filter(last, lambda x: x["d"] == match_digits(F.col("phone"))))
    return merged.select(key, *fields, F.array_join(sources, ",").alias("sources_str"), F.when(match_digits(F.col("phone")).isNull(), 0).otherwise(agree).alias("phone_source_count"))


def merge_pool(listings: DataFrame, fields: list[str], key: str = "cluster") -> DataFrame:
    """Merge already merged records across tiles: union of sources (sorted), largest
    corroboration, first non-blank value, longest description."""
    types = dict(listings.dtypes)
    aggs = []
    for f in fields:
        full = ~is_blank(F.col(f), types[f])
        order = F.struct((-F.length(f)).alias("n"), "ord") if f == "description" else F.col("ord")
        aggs.append(F.min_by(F.when(full, F.col(f)), F.when(full, order)).alias(f))
    union = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("sources", ","))))), ",")
    return listings.groupBy(key).agg(*aggs, union.alias("sources_str"), F.max("phone_source_count").alias("phone_source_count"))
