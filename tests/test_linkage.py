"""Similar names, first-match clusters and the incremental pool against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bizlink.functions.fuzzy import partial, ratio
from bizlink.functions.identity import match_digits, name_key
from bizlink.operators import greedy, linkage

LISTING = "ord long, name string, phone string, address string, phone_rank int"


def spelled(rng, letters, low, high, n, edits):
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)}
    for b in sorted(names):
        for _ in range(3):
            w = list(b)
            for _ in range(rng.randint(1, edits)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(letters)], [w[i], rng.choice(letters)]])
                w = w or ["a"]
            names.add("".join(w))
    return names


def test_similar_names_of_all_lengths(spark):
    rng = random.Random(5)
    names = spelled(rng, "abcde", 1, 16, 50, 3) | spelled(rng, "ab", 8, 18, 25, 4) | spelled(rng, "abcdefghij", 10, 40, 50, 6) | {f"business{i}" for i in range(0, 3000, 31)} | {f"supplier{i:09d}" for i in range(0, 3000, 61)}
    names = sorted(names)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if ratio(a, b) >= 88}
    assert {tuple(r) for r in linkage.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()} == want


def test_rare_grams_are_few(spark):
    name = F.lower(F.concat(*(F.substring(F.conv(F.substring(F.md5((F.col("id") * 7 + k).cast("string")), 1, 12), 16, 36), 2, 6) for k in range(3))))
    names = spark.range(5000).select(name.alias("name")).withColumn("n", F.length("name"))
    assert linkage.rare_grams(names).count() < 30 * 5000


def walk_plainly(rows):
    """The rule as written: each listing joins the first cluster that it matches."""
    out, clusters = {}, []
    for ord_, name, phone, address, rank in sorted(rows):
        for c in clusters:
            if phone and c["phone"] == phone:
                break
            if name and c["name"] and ratio(name, c["name"]) >= 88 and (not address or not c["address"] or partial(address, c["address"]) >= 60):
                break
        else:
            c = {"ord": ord_, "name": name, "phone": None, "rank": None, "address": ""}
            clusters.append(c)
        if phone and (not c["phone"] or rank < c["rank"]):
            c["phone"], c["rank"] = phone, rank
        c["address"] = c["address"] or address
        out[ord_] = c["ord"]
    return out


def random_listings(rng, n, ranks):
    names = ["Acme Roofing", "Acme Roofingg", "Acme Roofinggg", "Acme Roofer", "Bolt Electric", "Bolt Electrics", "Bolt Electricss", "Bold Electric", "Zen Spa", "The LLC", "", None]
    names += [f"Chain Store {chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30)]
    phones = [None, None, "", *(f"213-555-{k:04d}" for k in range(max(3, n // 8)))]
    places = [None, "", "1 Main St", "1 Main Street", "99 Oak Avenue", "500 Lakeshore Drive", "12 Elm Court, Bend", "77 Quarry Hill Plaza"]
    return [(i, rng.choice(names), rng.choice(phones), rng.choice(places), rng.choice(ranks)) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize(("seed", "walk", "ranks"), [(1, greedy.WALK, [0]), (2, 0, [0]), (3, 0, [0, 1, 2]), (4, 40, [0, 1])])
def test_greedy_is_the_sequential_walk(spark, seed, walk, ranks):
    rows = random_listings(random.Random(seed), 220, ranks)
    df = spark.createDataFrame(rows, LISTING).repartition(3)
    keyed = df.where("name <> ''").select("ord", name_key(F.col("name")), match_digits(F.col("phone")), F.lower(F.coalesce("address", F.lit(""))), "phone_rank").collect()
    want = walk_plainly([tuple(r) for r in keyed])
    got = {r["ord"]: r["cluster"] for r in greedy.greedy_clusters(df, walk).collect()}
    assert got == {i: want.get(i) for i, *_ in rows}


def test_greedy_walks_two_thousand_listings(spark):
    rows = random_listings(random.Random(9), 2000, [0, 1])
    df = spark.createDataFrame(rows, LISTING).repartition(4)
    keyed = df.where("name <> ''").select("ord", name_key(F.col("name")), match_digits(F.col("phone")), F.lower(F.coalesce("address", F.lit(""))), "phone_rank").collect()
    want = walk_plainly([tuple(r) for r in keyed])
    assert {r["ord"]: r["cluster"] for r in greedy.greedy_clusters(df).where("cluster is not null").collect()} == want


@pytest.mark.parametrize("walk", [greedy.WALK, 0])
def test_greedy_on_a_chain_and_on_none(spark, walk):
    """a matches b and b matches c, but a doesn't match c: the closure would join all three."""
    chain = [(1, "aaaaaaaaaaaaaaaaaaaa", None, None, 0), (2, "aaaaaaaaaaaaaaaaaabb", None, None, 0), (3, "aaaaaaaaaaaaaaaabbbb", None, None, 0), (4, "aaaaaaaaaaaaaabbbbbb", None, None, 0)]
    got = {r["ord"]: r["cluster"] for r in greedy.greedy_clusters(spark.createDataFrame(chain, LISTING), walk).collect()}
    assert got == walk_plainly([(i, n, p, a or "", k) for i, n, p, a, k in chain])
    assert len(set(got.values())) > 1
    assert greedy.greedy_clusters(spark.createDataFrame([], LISTING), walk).count() == 0


def test_greedy_pools_as_tiles_do(spark):
    rows = [(1, "Elite Clinic", "213-555-0142", None, 0), (2, "Elite Clinic", None, None, 0), (3, "Alpha Medical Center", "111-111-1111", None, 0), (4, "Zeta Family Practice", "222-222-2222", None, 0), (5, "Other Name", "(213) 555-0142", None, 0)]
    got = {r["ord"]: r["cluster"] for r in greedy.greedy_clusters(spark.createDataFrame(rows, LISTING)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}


def tiles_of(rng, n, tiles):
    rows = []
    for ord_, name, phone, address, _ in random_listings(rng, n, [0]):
        rows.append((ord_, name, phone, address, rng.choice(["npi", "yelp,npi", "google_maps"]), rng.randint(0, 3), rng.choice([None, "short", "a longer text"])))
    return [rows[k::tiles] for k in range(tiles)]


TILE = "ord long, name string, phone string, address string, sources string, phone_source_count int, description string"
FIELDS = ["name", "phone", "address", "description"]


def groups(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_entity_store_gives_resolve_of_the_whole(spark, tmp_path):
    from bizlink.operators.entities import EntityStore
    from bizlink.operators.golden import merge_pool

    tiles = tiles_of(random.Random(3), 120, 3)
    store = EntityStore(spark, str(tmp_path / "s"), FIELDS, 8)
    for k, tile in enumerate(tiles):
        store.merge(spark.createDataFrame(tile, TILE), k)
    whole = spark.createDataFrame([r for t in tiles for r in t], TILE)
    want = linkage.resolve(whole.withColumnRenamed("ord", "id"))
    assert groups((r["ord"], r["root"]) for r in store.clusters(whole).collect()) == groups((r["id"], r["cluster"]) for r in want.select("id", "cluster").collect())
    pool = merge_pool(want.withColumnRenamed("id", "ord"), FIELDS).select(*FIELDS, "sources_str", "phone_source_count").collect()
    assert sorted(map(str, (tuple(r) for r in store.pool().select(*FIELDS, "sources", "phone_source_count").collect()))) == sorted(map(str, (tuple(r) for r in pool)))
    assert store.tables.numbers() == list(range(3))
    # A batch that comes again changes nothing; one without news of a cluster leaves its parts.
    store.merge(spark.createDataFrame(tiles[0], TILE), 2)
    assert store.tables.numbers() == list(range(3))
    before = store.tables.latest()
    store.merge(spark.createDataFrame([(99_999, "Quite Another Business", "999-111-2222", "1 Far Road", "npi", 1, None)], TILE), 3)
    after = store.tables.latest()
    assert sum(before.folders["pool"].get(p) != f for p, f in after.folders["pool"].items()) == 1
    assert before.read("pool").count() + 1 == after.read("pool").count()


def test_entity_store_survives_a_batch_cut_off(spark, tmp_path, monkeypatch):
    from bizlink.operators.entities import EntityStore
    from bizlink.sources.versions import Version

    store = EntityStore(spark, str(tmp_path / "s"), FIELDS, 4)
    one = [(1, "Acme Roofing", "213-555-0101", None, "npi", 1, None), (2, "Zen Spa", None, "1 Main St", "npi", 0, None)]
    two = [(3, "Acme Roofingg", None, None, "yelp", 2, "text"), (4, "Zen Spa", "213-555-0101", "1 Main St", "yelp", 0, None)]
    store.merge(spark.createDataFrame(one, TILE), 0)
    with monkeypatch.context() as m:
        m.setattr(Version, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.merge(spark.createDataFrame(two, TILE), 1)
    assert sorted(r["name"] for r in store.pool().collect()) == ["Acme Roofing", "Zen Spa"]
    store.merge(spark.createDataFrame(two, TILE), 1)
    (left,) = store.pool().collect()
    assert (left["ord"], left["name"], left["sources"], left["phone_source_count"], left["description"], left["address"]) == (1, "Acme Roofing", "npi,yelp", 2, "text", "1 Main St")
    assert store.tables.at(0).read("pool").count() == 2
    assert store.tables.vacuum(keep=1) > 0
    assert store.pool().count() == 1 and store.tables.numbers() == [1]


def test_random_names_meet_by_deletions_only(spark):
    """Names of few letters have all trigrams in common, so that joining on these meets all pairs."""
    cuts, grams = linkage.length_pairs({13, 14, 18})
    assert grams == [] and {c[:2] for c in cuts} == {(13, 13), (14, 13), (14, 14), (18, 18)}
    rng = random.Random(7)
    names = {"".join(rng.choice("bcdfghjk") for _ in range(n)) for n in (13, 14, 18) for _ in range(300)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    keys = linkage.candidate_keys(df, linkage.lengths_of(df))
    met = keys.distinct().groupBy("key").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert met < 300


def test_entity_store_takes_in_new_lengths(spark, tmp_path):
    from bizlink.operators.entities import EntityStore

    store = EntityStore(spark, str(tmp_path / "s"), FIELDS, 4)
    long = "qwrtpsdfghjklzxcvbnmqwrtpsdf"
    rows = [(1, "bcdfghjklmnpqr", None, None, "npi", 0, None), (2, long, None, None, "npi", 0, None), (3, "bcdfghjklmnpq", None, None, "npi", 0, None), (4, long + "x", None, None, "npi", 0, None), (5, "bcdfghjklmnpqrstv", None, None, "npi", 0, None)]
    for k, part in enumerate((rows[:2], rows[2:])):
        store.merge(spark.createDataFrame(part, TILE), k)
    whole = spark.createDataFrame(rows, TILE)
    assert groups((r["ord"], r["root"]) for r in store.clusters(whole).collect()) == [[1, 3, 5], [2, 4]]


def test_short_names_meet_by_one_form_each(spark):
    """Forms of equal lengths are made once for both sides and are few rows; no pair is lost."""
    rng = random.Random(11)
    names = sorted(spelled(rng, "abcé😀", 1, 20, 60, 3) | {"a" * n for n in range(1, 21)} | {"b" + "a" * n for n in range(1, 20)})
    cuts, _ = linkage.length_pairs(set(range(1, 21)))
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, x bigint")
    rows = df.coalesce(1).mapInArrow(linkage._hashed_forms(cuts, 16), "bin int, h binary, x binary").collect()
    assert len(rows) <= 16 * 20
    got = {tuple(sorted((names[r["x"]], names[r["y"]]))) for r in spark.createDataFrame(rows, "bin int, h binary, x binary").coalesce(1).sortWithinPartitions("bin").mapInArrow(linkage._meeting, "x bigint, y bigint").collect()}
    asked = {c[:2] for c in cuts}
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if (max(len(a), len(b)), min(len(a), len(b))) in asked and ratio(a, b) >= 88}
    assert got == want


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from bizlink.operators import components as module

    written, plain = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, tag: written.append(tag) or plain(df, tag))
    edges = spark.range(120).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(500, 900), (900, 700), (600, 600)], "a long, b long"))
    got = {r["node"]: r["root"] for r in module.components(edges).collect()}
    assert got == {**{i: 0 for i in range(121)}, 500: 500, 700: 500, 900: 500}
    assert len(written) <= 40
    assert module.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_the_smallest_node_reachable(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    from bizlink.operators.components import components

    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_forms_meet_where_one_name_is_own(spark):
    """Stored names meet the batch's and not each other, whichever of the two is longer; a stored name may come again."""
    rng = random.Random(12)
    names = sorted(spelled(rng, "abc", 1, 20, 60, 3))
    own, others = set(names[::3]), set(names[1::3]) | set(names[2::3]) | set(names[::9])
    lengths = {len(n) for n in names}
    table = lambda some: spark.createDataFrame([(n,) for n in sorted(some)], "name string")
    hashed = {r["x"]: r["name"] for r in table(names).withColumn("x", F.xxhash64("name")).collect()}
    met = linkage.met_by_forms(linkage.form_keys(table(own), lengths), linkage.form_keys(table(others), lengths)).collect()
    got = {tuple(sorted((hashed[r["x"]], hashed[r["y"]]))) for r in met}
    asked = {c[:2] for c in linkage.length_pairs(lengths)[0]}
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if (a in own or b in own) and (max(len(a), len(b)), min(len(a), len(b))) in asked and ratio(a, b) >= 88}
    assert got == want and len(met) == len(want) > 20


def test_entity_store_has_no_table_of_a_row_for_each_form(spark, tmp_path, monkeypatch):
    """Such a table is small as a file, so that Spark sends it to the driver to broadcast it."""
    from bizlink.operators import entities

    written, plain = [], entities.materialize
    monkeypatch.setattr(entities, "materialize", lambda df, tag: written.append(plain(df, tag)) or written[-1])
    monkeypatch.setattr(linkage, "BINS", 16, raising=False)
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("bcdfghjklmnpqrst") for _ in range(14)), None, None, "npi", 0, None) for i in range(400)]
    store = entities.EntityStore(spark, str(tmp_path / "s"), FIELDS, 4)
    for k in range(2):
        # The names come again under other numbers, and nothing is kept twice.
        store.merge(spark.createDataFrame([(400 * k + i, *r) for i, *r in rows], TILE), k)
    assert max(t.count() for t in written) <= 2 * len(rows)
    kept = store.tables.latest().read("forms")
    assert kept.agg(F.sum(F.length("h"))).first()[0] == 8 * 14 * len(rows)
    assert store.pool().count() == len(rows)
