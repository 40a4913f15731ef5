"""The sequential first-match rule over listings, run in parallel.

Listings are taken in order; each joins the first cluster it matches, else it opens one. A
cluster is matched by the name of its first listing, by its phone and by its address, and the
last two are filled, or the phone replaced by a better source's, as listings join. What a
listing does thus depends on what earlier ones did.

Listings that can't meet are independent: components of equal phones and similar names are
walked one by one, many to a task. A component too large for that is settled in rounds: all its
listings decide at once by the clusters of the round before, until nothing changes. A listing
whose forerunners are settled is settled too, so each round settles more, and the only state
that reproduces itself is that of the sequential walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlink.functions.fuzzy import partial, partial_udf
from bizlink.functions.identity import filled, match_digits, name_key
from bizlink.operators.components import components
from bizlink.operators.linkage import ADDRESS_THRESHOLD, similar_names
from bizlink.scratch import materialize

#: A component with more listings is settled in rounds.
WALK = 5_000


class Walk:
    """The walk over one component: ``take`` its listings in order."""

    def __init__(self, alike: list[tuple[str, str]]) -> None:
        self.alike: dict[str, set[str]] = {}
        for a, b in alike:
            self.alike.setdefault(a, set()).add(b)
            self.alike.setdefault(b, set()).add(a)
        self.by_name: dict[str, list[int]] = {}
        self.by_phone: dict[str, set[int]] = {}
        self.phone: dict[int, tuple[int, str]] = {}
        self.address: dict[int, str] = {}
        self.agreed: dict[tuple[str, str], bool] = {}

    def _agree(self, a: str, b: str) -> bool:
        key = (a, b) if a <= b else (b, a)
        if key not in self.agreed:
            self.agreed[key] = partial(*key) >= ADDRESS_THRESHOLD
        return self.agreed[key]

    def take(self, at: int, name: str | None, phone: str | None, address: str, rank: int) -> int:
        """The number of the cluster that the listing numbered ``at`` joins or opens."""
        found = min(self.by_phone.get(phone, ()), default=None) if phone else None
        for other in {name, *self.alike.get(name, ())} if name else ():
            for lead in self.by_name.get(other, ()):
                if found is not None and lead >= found:
                    break
                own = self.address.get(lead, "")
                if not own or not address or self._agree(own, address):
                    found = lead
                    break
        lead = at if found is None else found
        if lead == at and name:
            self.by_name.setdefault(name, []).append(at)
        if phone and (lead not in self.phone or rank < self.phone[lead][0]):
            if lead in self.phone:
                self.by_phone[self.phone[lead][1]].discard(lead)
            self.phone[lead] = (rank, phone)
            self.by_phone.setdefault(phone, set()).add(lead)
        if address and lead not in self.address:
            self.address[lead] = address
        return lead


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by component: first pairs of similar names, then listings in order."""
    comp, walk, alike = None, None, []
    for batch in batches:
        out = []
        for c, kind, ord_, a, b, address, rank in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != comp:
                comp, walk, alike = c, None, []
            if kind == 0:
                alike.append((a, b))
                continue
            walk = walk or Walk(alike)
            out.append((ord_, walk.take(ord_, a, b, address, rank)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["ord", "lead"])


def _timelines(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What clusters show when: ``(lead, phone, since, until)`` and ``(lead, lname, address, since)``.

    A value of a listing counts for those after it. A phone gives way to a better source's."""
    first = state.where("phone is not null").groupBy("lead", "rank").agg(F.min(F.struct("ord", "phone")).alias("p"))
    in_order = Window.partitionBy("lead").orderBy("p.ord")
    steps = first.withColumn("best", F.min("rank").over(in_order.rowsBetween(Window.unboundedPreceding, -1))).where("best is null or rank < best")
    phones = steps.select("lead", F.col("p.phone").alias("phone"), F.col("p.ord").alias("since"), F.lead("p.ord").over(in_order).alias("until"))
    names = state.where("ord = lead").select("lead", F.col("name").alias("lname"))
    places = state.where("address <> ''").groupBy("lead").agg(F.min(F.struct("ord", "address")).alias("x"))
    return phones, names.join(places, "lead", "left").select("lead", "lname", F.col("x.address").alias("laddress"), F.col("x.ord").alias("since"))


def _round(state: DataFrame, alike: DataFrame) -> DataFrame:
    """Every listing's first match among the clusters of ``state``."""
    phones, shown = _timelines(state)
    own = state.select("ord", "name", "phone", "address")
    by_phone = own.join(phones, "phone").where((F.col("since") < F.col("ord")) & (F.col("until").isNull() | (F.col("ord") <= F.col("until"))) & (F.col("lead") < F.col("ord"))).select("ord", "lead")
    # Names: clusters without an address yet match by name alone, and so do listings without one.
    near = shown.where("lname is not null").join(alike, "lname")
    least = near.groupBy("name").agg(F.min("lead").alias("lead"))
    blank = own.where("address = ''").join(least, "name").where("lead < ord").select("ord", "lead")
    late = near.where("since is null or since > lead").select("name", "lead", "since")
    open_ = own.where("address <> ''").join(late, "name").where((F.col("lead") < F.col("ord")) & (F.col("since").isNull() | (F.col("since") >= F.col("ord")))).select("ord", "lead")
    # Addresses are compared once for each distinct pair, and only with those that clusters show.
    kinds = own.where("address <> '' and name is not null").select("name", "address").distinct()
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = kinds.join(near.where("laddress is not null").groupBy("name", "laddress").agg(F.collect_list(F.struct("lead", "since")).alias("leads")), "name").repartition(tasks, "name", "address", "laddress")
    same = (F.col("address") == F.col("laddress")) | F.contains("address", F.col("laddress")) | F.contains("laddress", F.col("address"))
    sure, unsure = pairs.where(same), pairs.where(~same).where(partial_udf()("address", "laddress") >= ADDRESS_THRESHOLD)
    agree = sure.unionByName(unsure).select("name", "address", F.inline("leads"))
    full = own.join(agree, ["name", "address"]).where("lead < ord and since < ord").select("ord", "lead")
    best = by_phone.unionByName(blank).unionByName(open_).unionByName(full).groupBy("ord").agg(F.min("lead").alias("new"))
    return state.join(best, "ord", "left").withColumn("was", F.col("lead")).withColumn("lead", F.coalesce("new", "ord")).drop("new")


def _settle(rows: DataFrame, alike: DataFrame) -> DataFrame:
    """``(ord, lead)`` of listings in large components, by rounds until nothing changes."""
    ways = alike.select(F.col("a").alias("name"), F.col("b").alias("lname")).unionByName(alike.select(F.col("b").alias("name"), F.col("a").alias("lname")))
    ways = materialize(ways.unionByName(rows.where("name is not null").select("name", F.col("name").alias("lname")).distinct()), "alike")
    # Any start serves; the first listing of the same phone or name is mostly right.
    by_phone = rows.where("phone is not null").groupBy("phone").agg(F.min("ord").alias("p"))
    by_name = rows.where("name is not null").groupBy("name", "address").agg(F.min("ord").alias("q"))
    guess = rows.join(by_phone, "phone", "left").join(by_name, ["name", "address"], "left")
    state = materialize(guess.select("ord", "name", "phone", "address", "rank", F.least("ord", F.coalesce("p", "q", "ord")).alias("lead")), "greedy")
    while True:
        state = materialize(_round(state, ways), "greedy")
        if state.where("lead <> was").isEmpty():
            return state.select("ord", "lead")
        state = state.drop("was")


def greedy_clusters(listings: DataFrame, walk: int = WALK) -> DataFrame:
    """Add ``cluster``, the ``ord`` of the listing that opened it, to listings with ``ord, name,
    phone, address``; ``ord`` is a distinct long that gives the order.

    A column ``phone_rank`` (0 is best), where there is one, lets a better source's phone
    replace a cluster's; else phones are only filled. Listings without a name are left out:
    their cluster is null. Every listing is compared, whatever the size of its component.
    """
    rank = F.col("phone_rank").cast("int") if "phone_rank" in listings.columns else F.lit(0)
    keyed = listings.where(filled(F.col("name"))).select(F.col("ord").cast("long").alias("ord"), name_key(F.col("name")).alias("name"), match_digits(F.col("phone")).alias("phone"), F.lower(F.coalesce("address", F.lit(""))).alias("address"), rank.alias("rank"))
    keyed = materialize(keyed, "keyed")
    alike = materialize(similar_names(keyed.select("name")), "alike")
    # A name's node is its first listing, a listing without one is a node itself; nodes of one phone are tied to the first.
    first = keyed.where("name is not null").groupBy("name").agg(F.min("ord").alias("own"))
    owned = materialize(keyed.where("name is not null").join(first, "name").unionByName(keyed.where("name is null").withColumn("own", F.col("ord"))), "owned")
    of_phone = owned.where("phone is not null").groupBy("phone").agg(F.min("own").alias("b"))
    by_phone = owned.where("phone is not null").join(of_phone, "phone").select(F.col("own").alias("a"), "b")
    tied = materialize(alike.join(first.select(F.col("name").alias("a"), F.col("own").alias("i")), "a").join(first.select(F.col("name").alias("b"), F.col("own").alias("j")), "b"), "tied")
    roots = components(by_phone.unionByName(tied.select(F.col("i").alias("a"), F.col("j").alias("b"))))
    placed = owned.join(roots, F.col("own") == roots["node"], "left").withColumn("comp", F.coalesce("root", "own")).drop("own", "node", "root")
    placed = materialize(placed, "placed")
    large = materialize(placed.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > walk).select("comp"), "large")
    tied = tied.join(roots, F.col("i") == roots["node"]).select("a", "b", F.col("root").alias("comp"))
    few, few_tied = placed.join(large, "comp", "left_anti"), tied.join(large, "comp", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    rows = few_tied.select("comp", F.lit(0).alias("kind"), none("long").alias("ord"), "a", "b", none("string").alias("address"), none("int").alias("rank"))
    rows = rows.unionByName(few.select("comp", F.lit(1).alias("kind"), "ord", F.col("name").alias("a"), F.col("phone").alias("b"), "address", "rank"))
    tasks = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = rows.repartition(tasks, "comp").sortWithinPartitions("comp", "kind", "ord").mapInArrow(_walks, "ord bigint, lead bigint")
    if not large.isEmpty():
        done = done.unionByName(_settle(placed.join(large, "comp", "left_semi"), tied.join(large, "comp", "left_semi").select("a", "b")))
    done = done.select(F.col("ord").alias("_ord"), F.col("lead").alias("cluster"))
    return listings.join(done, listings["ord"] == done["_ord"], "left").drop("_ord")
