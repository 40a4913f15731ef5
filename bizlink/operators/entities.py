"""Entity resolution that goes on: a stored index of keys and a pool of merged records.

The store keeps, as versioned tables in parts (:mod:`bizlink.sources.versions`):

* ``places``: a row for each (name, address) seen, by name, and each phone, by phone, with the
  node it is;
* ``forms``: hashes of what deletions leave of the names, many to a row, by bin; ``grams``: the
  rare trigrams of other names. By these similar names are found;
* ``lengths``: the lengths of names seen, as keys are made for lengths that occur only;
* ``links``: which node a cluster's old root was united with, by old root;
* ``pool``: the merged record of each cluster, by root.

A batch joins the index on its own keys and reads and rewrites the parts of these keys only.
Its matches are edges between nodes; those between roots of stored clusters unite them, and
only the united clusters' records are merged again. Its joins are by sorting, as all of these
tables grow with the input (see :meth:`bizlink.sources.versions.Version.read`). The clusters are those of
:func:`bizlink.operators.linkage.resolve` over all batches, in whatever order they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlink.functions.identity import match_digits, name_key
from bizlink.operators.components import components
from bizlink.operators.golden import merge_pool
from bizlink.operators.linkage import agreeing, form_keys, gram_keys, lengths_of, met_by_forms, verified
from bizlink.scratch import materialize
from bizlink.sources.versions import Version, VersionedTables

#: Parts of each stored table; a part should stay within what one task rewrites.
PARTS = 256


class EntityStore:
    """Clusters and their merged records at ``path``; ``fields`` are merged as in the pool."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], parts: int = PARTS) -> None:
        self.spark, self.fields = spark, fields
        record = ", ".join(f"{f} string" for f in fields)
        self.tables = VersionedTables(spark, path, {
            "places": "key string, address string, node string",
            "forms": "key string, h binary, x binary",
            "grams": "key string, name string",
            "lengths": "key string",
            "links": "key string, root string",
            "pool": f"key string, ord long, sources string, phone_source_count int, {record}",
        }, parts)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in a batch of ``ord, sources, phone_source_count`` and the fields, ``name``,
        ``phone`` and ``address`` among them. ``ord`` is distinct over all batches. A batch
        whose number was taken in already changes nothing; one that was cut off leaves the
        version before it, and is taken in by calling this again."""
        if self.tables.has(number):
            return
        now = self.tables.latest()
        keyed = batch.withColumn("_phone", match_digits(F.col("phone"))).withColumn("_name", name_key(F.col("name"))).withColumn("_address", F.lower(F.coalesce("address", F.lit(""))))
        node = F.when(F.col("_name").isNotNull(), _place(F.col("_name"), F.col("_address"))).when(F.col("_phone").isNotNull(), _phone(F.col("_phone"))).otherwise(F.concat(F.lit("o"), F.col("ord").cast("string")))
        keyed = materialize(keyed.withColumn("node", node), "batch")
        named = materialize(keyed.where("_name is not null").select(F.col("_name").alias("key"), F.col("_address").alias("address"), "node").distinct(), "named")
        phones = keyed.where("_phone is not null").select(_phone(F.col("_phone")).alias("key"), F.lit("").alias("address"), _phone(F.col("_phone")).alias("node")).distinct()
        names = materialize(named.select(F.col("key").alias("name")).distinct(), "names")
        before = {int(r["key"]) for r in now.read("lengths").collect()}  # a few at most, see lengths_of
        lengths = before | lengths_of(names)
        alike, keys = _similar(now, names, before, lengths)
        both = alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("name"), F.col("b").alias("key")).unionByName(named.select(F.col("key").alias("name"), "key").distinct()).distinct()
        both = materialize(both, "alike")
        seen = now.read("places", both.select("key").unionByName(phones.select("key")))
        places = materialize(seen.unionByName(named).unionByName(phones).distinct(), "places")
        pairs = named.select(F.col("key").alias("name"), "address", "node").join(both.hint("merge"), "name").join(places.select("key", F.col("address").alias("other"), F.col("node").alias("there")).hint("merge"), "key").where("node <> there")
        agree = agreeing(materialize(pairs, "near"), "address", "other").select(F.col("node").alias("a"), F.col("there").alias("b"))
        calls = keyed.where("_phone is not null").select(F.col("node").alias("a"), _phone(F.col("_phone")).alias("b")).where("a <> b")
        edges = materialize(agree.unionByName(calls).distinct(), "edges")
        touched = materialize(keyed.select("node").union(edges.select("a")).union(edges.select("b")).distinct(), "touched")
        roots = materialize(_roots(now, touched), "roots")
        tied = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")).hint("merge"), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")).hint("merge"), "b")
        united = materialize(components(tied.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("node <> root").select(F.col("node").alias("key"), "root"), "united")
        # Records: those of the batch at their new roots, and those of clusters that lost theirs or get more.
        now_at = roots.join(united.select(F.col("key").alias("root"), F.col("root").alias("up")).hint("merge"), "root", "left").select("node", F.coalesce("up", "root").alias("key"))
        record = ["ord", "sources", "phone_source_count", *self.fields]
        fresh = keyed.join(now_at.hint("merge"), "node").select("key", *record)
        moved = now.read("pool", united).join(united.hint("merge"), "key").select(F.col("root").alias("key"), *record)
        staying = now.read("pool", fresh.select("key").unionByName(united.select(F.col("root").alias("key"))))
        everything = fresh.unionByName(moved).unionByName(staying.select("key", *record))
        first = everything.groupBy("key").agg(F.min("ord").alias("ord"))
        merged = merge_pool(everything, self.fields, "key").withColumnRenamed("sources_str", "sources").join(first.hint("merge"), "key").select("key", *record)
        new = self.tables.begin(now, number)
        new.put("places", named.unionByName(phones), keep=["key", "address"])
        for table, (rows, keep) in keys.items():
            new.put(table, rows, keep)
        new.put("lengths", self.spark.createDataFrame([(str(n),) for n in sorted(lengths)], "key string"), keep=["key"])
        new.put("links", united, keep=["key"])
        new.put("pool", merged, keep=["key"], gone=united)
        new.commit()

    def pool(self) -> DataFrame:
        """The merged records of the latest version, ``key`` the root of each cluster."""
        return self.tables.latest().read("pool")

    def clusters(self, listings: DataFrame) -> DataFrame:
        """``(ord, root)``: the cluster that each listing taken in belongs to now."""
        name, phone = name_key(F.col("name")), match_digits(F.col("phone"))
        node = F.when(name.isNotNull(), _place(name, F.lower(F.coalesce("address", F.lit(""))))).when(phone.isNotNull(), _phone(phone)).otherwise(F.concat(F.lit("o"), F.col("ord").cast("string")))
        keyed = listings.select("ord", node.alias("node"))
        return keyed.join(_roots(self.tables.latest(), keyed.select("node").distinct()).hint("merge"), "node").select("ord", "root")


def _place(name: Column, address: Column) -> Column:
    return F.concat(F.lit("n"), name, F.lit("|"), address)


def _phone(phone: Column) -> Column:
    return F.concat(F.lit("p"), phone)


def _similar(now: Version, names: DataFrame, before: set[int], lengths: set[int]) -> tuple[DataFrame, dict[str, tuple[DataFrame, list[str]]]]:
    """Similar pairs ``(a, b)`` among ``names`` and of these with stored ones; for each index the
    rows it gets and the columns by which they replace others."""
    spelled = lambda places: places.where("node like 'n%'").select(F.col("key").alias("name")).distinct()
    known = spelled(now.read("places", names.select(F.col("name").alias("key")))) if before else names.limit(0)
    # Stored names have no keys yet for the lengths that are new.
    late = spelled(now.read("places")) if before and lengths > before else names.limit(0)
    made = materialize(form_keys(names.join(known.hint("merge"), "name", "left_anti"), lengths), "forms")
    own, others = made, made.limit(0)
    if before:
        own = made.unionByName(materialize(form_keys(known, lengths), "forms"))
        old = materialize(form_keys(late, lengths, before), "forms")
        others = now.read("forms", materialize(own.select("key").distinct(), "bins"), "broadcast").unionByName(old)
        made = made.unionByName(old)
    met = materialize(met_by_forms(own, others), "met")
    there = now.read_hashed("places", met.select(F.explode(F.array("x", "y")).alias("hash")))
    by_hash = materialize(names.unionByName(spelled(there)).distinct().withColumn("x", F.xxhash64("name")), "names")
    pairs = met.join(by_hash.select("x", F.col("name").alias("a")).hint("merge"), "x").join(by_hash.select(F.col("x").alias("y"), F.col("name").alias("b")).hint("merge"), "y").select("a", "b")
    keys = {"forms": (made, [])}
    if (grams := gram_keys(names, lengths)) is not None:
        grams = materialize(grams, "grams")
        old = gram_keys(late, lengths, before) if before else None
        added = grams if old is None else grams.unionByName(materialize(old, "grams"))
        stored = now.read("grams", grams).unionByName(added).select("key", F.col("name").alias("other"))
        pairs = pairs.unionByName(grams.join(stored.hint("merge"), "key").select(F.col("name").alias("a"), F.col("other").alias("b")))
        keys["grams"] = (added, ["key", "name"])
    return verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), keys


def _roots(now: Version, nodes: DataFrame) -> DataFrame:
    """``(node, root)``: links are followed from old roots to new ones until all have ended.
    Each batch adds a link to a root at most, so there are as many steps as a root was united."""
    at = nodes.select("node", F.col("node").alias("root"))
    while True:
        links = now.read("links", at.select(F.col("root").alias("key"))).select(F.col("key").alias("root"), F.col("root").alias("up"))
        nexts = materialize(at.join(links.hint("merge"), "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("on")), "roots")
        if nexts.where("on").isEmpty():
            return nexts.select("node", "root")
        at = nexts.select("node", "root")
