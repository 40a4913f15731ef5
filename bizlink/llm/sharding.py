"""Sharding by fixed virtual slots (operator 8), DataFrame functions only.

Records are hashed into a fixed number of slots. Bytes are summed per slot, and a map from
slots to shards is made from those sums alone: largest slot first, each to the shard with
the fewest bytes so far. The map is a small stored table with a version; when the shard count
changes, :func:`rebalance` edits it, moving only the slots that the new shard needs, and when
bytes drift, :func:`even_out` moves what is too much; records follow their slots. Work on records never depends on the number of shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlink.llm.common import materialize, scratch_path

#: Slots, fixed for the life of a data set. The map has one row for each.
SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """``(vslot, bytes, n)`` of records with ``vslot`` and ``size``."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def _deal(slots: DataFrame, loads: Column) -> DataFrame:
    """``(vslot, shard)``: slots with ``vslot, bytes`` by falling bytes, each to the shard with the
    fewest bytes so far, beginning with ``loads`` bytes in each.

    There is a row per slot at most, a fixed number, so folding over them as one array is
    bounded whatever the data.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), F.col("vslot").alias("vslot"))))

    def place(acc: Column, slot: Column) -> Column:
        least = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda x, i: F.when(i == least - 1, x - slot["neg"]).otherwise(x))
        return F.struct(load.alias("load"), F.array_append(acc["to"], least - 1).alias("to"))

    state = F.struct(loads.alias("load"), F.array().cast("array<int>").alias("to"))
    dealt = slots.agg(order.alias("slots")).select("slots", F.aggregate("slots", state, place)["to"].alias("to"))
    return dealt.select(F.explode(F.arrays_zip("slots.vslot", "to")).alias("p")).select("p.vslot", F.col("p.to").alias("shard"))


def slot_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """``(vslot, shard, version)``: slots by falling bytes, each to the least loaded shard."""
    return _deal(loads, F.array_repeat(F.lit(0).cast("long"), shards)).withColumn("version", F.lit(version))


def save_map(slots: DataFrame, path: str) -> None:
    """Add a version of a map to the store at ``path``; a version that is there isn't overwritten."""
    version = slots.agg(F.max("version")).first()[0]
    slots.select("vslot", "shard").write.mode("error").parquet(f"{path}/version={version or 0}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(vslot, shard, version)`` of one version of a stored map, by default the newest."""
    every = spark.read.schema("vslot int, shard int, version int").parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == version)


def rebalance(old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for one more shard (number ``shards - 1``).

    Every old shard gives up slots, taken in the order of their hash, until it has given its
    equal part of the new shard's bytes; no slot moves between old shards.
    """
    with_bytes = old.join(F.broadcast(loads), "vslot")
    order = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot")
    whole = Window.partitionBy("shard")
    given = F.sum("bytes").over(order) <= F.sum("bytes").over(whole) / F.lit(shards)
    return with_bytes.select("vslot", F.when(given, F.lit(shards - 1)).otherwise(F.col("shard")).alias("shard"), (F.col("version") + 1).alias("version"))


def even_out(old: DataFrame, loads: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a map whose shards have drifted apart in bytes.

    A shard more than ``slack`` above the mean gives up slots, in the order of their hash, until
    it is at the mean; these and slots new to the map go, largest first, to the least loaded
    shards. All other slots stay where they are. Old slots without bytes stay in the map.
    """
    both = loads.select("vslot", "bytes").join(old, "vslot", "full").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), "shard")
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    total = F.sum("bytes").over(Window.partitionBy("shard"))
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot"))
    moves = F.col("shard").isNull() | ((total > mean * (1 + slack)) & (running <= total - mean))
    marked = both.select("vslot", "bytes", "shard", moves.alias("moves"))
    stay = marked.where("not moves").select("vslot", "shard")
    held = {r[0]: r[1] for r in marked.where("not moves").groupBy("shard").agg(F.sum("bytes")).collect()}
    start = F.array(*(F.lit(held.get(k, 0)).cast("long") for k in range(shards)))
    version = old.agg(F.max("version")).first()[0]
    return stay.unionByName(_deal(marked.where("moves"), start)).withColumn("version", F.lit((version or 0) + 1))


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, vslot, shard, slot, version)`` for every row.

    ``size`` is the UTF-8 length of the text (null: none) plus 1. The record hash covers
    id and text checksum, so null or repeated ids spread as long as their texts differ.
    ``slot`` is the record's place in its shard, gapless from 0: the place inside its virtual
    slot plus the records of the shard's earlier virtual slots, so no shard is gathered in one
    task. Places inside a virtual slot follow doc_id (nulls first) and checksum; equal rows
    take neighbouring places. An empty table gives no rows. Other columns are ignored.

    The shards are near equal in bytes; a group of equal texts, which may be a third of all
    rows, is therefore spread over shards by its ids. The map is stored at ``path`` (a scratch
    folder by default): its first version is made from these records; where there is one
    already, its newest version is used, and slots it lacks are added in a new version.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    records = materialize(records.withColumn("vslot", slot_of(F.struct("doc_id", "text_crc32"), slots)), "shard-records")
    loads = materialize(slot_bytes(records), "shard-loads")
    spark = docs.sparkSession
    if path is None:
        path = scratch_path(spark, "shard-map")
        save_map(slot_map(loads, shards), path)
    elif loads.join(load_map(spark, path), "vslot", "left_anti").limit(1).count():
        save_map(even_out(load_map(spark, path), loads, shards, slack=math.inf), path)
    placed = loads.join(load_map(spark, path), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.select("vslot", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("place", F.row_number().over(own) - 1)
    return ranked.join(F.broadcast(first), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "version")
