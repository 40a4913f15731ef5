"""Record linkage: candidate keys, verification, clusters; never a cross join.

Two listings match on the last seven phone digits, or on names at least 88 percent alike
unless both have addresses that disagree. The work is done on distinct names. Names of up to
``SHORT`` letters are joined on what is left of them after deletions, which is exact by itself
and meets no pair that isn't similar, as long as each side loses at most ``MOST`` letters. The
other pairs (longer names, and lengths that differ by more) are joined on the longer name's
rarest trigrams: a pair may differ in so few places that one of each name's rarest ones is
common to both, near the same place. Only lengths that occur are provided for. Native edit
distance settles most of these pairs, the rest goes to the subsequence ratio.

Clusters are the transitive closure of matches (:func:`resolve`), or what the sequential
first-match rule makes of the listings in their order (:func:`greedy_clusters`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlink.functions.fuzzy import partial_udf, ratio_udf
from bizlink.functions.identity import match_digits, name_key
from bizlink.operators.components import components
from bizlink.scratch import materialize

THRESHOLD, ADDRESS_THRESHOLD = 88, 60
#: Names up to ``SHORT`` letters are joined by deletions of up to ``MOST`` letters; a partner of
#: one joined by trigrams has ``LEAST`` or more.
SHORT, MOST, LEAST, GRAM = 20, 2, 11, 3
#: A trigram of more names than this is dealt over several tasks.
HOT_GRAM = 4096


def _deletions(la: int, lb: int) -> tuple[int, int] | None:
    """How many letters names of la >= lb letters lose at most down to what they share."""
    most = 12 * (la + lb) // 100
    most -= (most - (la - lb)) % 2
    return None if most < la - lb else ((most + la - lb) // 2, (most - la + lb) // 2)


def length_pairs(lengths: set[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Pairs of lengths that similar names may have, the longer first: ``(la, lb, ka, kb)`` of those
    joined by ka and kb deletions, ``(la, lb)`` of those joined by trigrams. All lengths over
    ``SHORT`` count as the one after it."""
    cuts, grams = [], []
    for la, lb in ((x, y) for x in sorted(lengths) for y in sorted(lengths) if y <= x):
        if la > SHORT:
            grams += [(la, lb)] if 14 * lb >= 11 * la else []
        elif (cut := _deletions(la, lb)) and max(cut) > MOST:
            grams.append((la, lb))
        elif cut and cut != (0, 0):
            cuts.append((la, lb, *cut))
    return cuts, grams


def lengths_of(names: DataFrame) -> set[int]:
    """The lengths that occur, at most one over ``SHORT``."""
    return {r[0] for r in names.select(F.least(F.length("name"), F.lit(SHORT + 1)).alias("n")).distinct().collect()}


#: Hashes of what is left of names that a task sorts, on average.
FORMS = 1 << 22
#: Bins of an index of hashes that is kept; a task sorts one at a time.
BINS = 2048
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SHORT, _ODD)]), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _short_hashes(letters: np.ndarray, times: int) -> np.ndarray:
    """For names of equal length, a row of code points each: hashes of what ``times`` deletions leave."""
    n = letters.shape[1]
    codes = _mixed((letters.astype(np.uint64) + np.uint64(1)) * _ODD)
    # Sums of the letters before each place, each letter moved to the left by 0, 1 or 2.
    sums = [np.pad(np.cumsum(codes[:, k:] * _POWER[: n - k], axis=1, dtype=np.uint64), ((0, 0), (1 + k, 0))) for k in range(times + 1)]
    if times == 0:
        return sums[0][:, n:]
    if times == 1:
        i = np.arange(n)
        return sums[0][:, i] + sums[1][:, n:] - sums[1][:, i + 1]
    i, j = np.triu_indices(n, 1)
    return sums[0][:, i] + sums[1][:, j] - sums[1][:, i + 1] + sums[2][:, n:] - sums[2][:, j + 1]


def _hashed_forms(cuts: list[tuple[int, int, int, int]], bins: int):
    """From ``(name, x)`` the hashes of every form that a pair of lengths asks for, many to a row:
    ``(bin, h, x)``. The last two bits of a hash say whose form it is: 0 of either of equal
    lengths, 1 of the longer name, 2 of the shorter; the others give the bin."""
    asked: dict[int, list[tuple[int, int, int, int]]] = {}
    for la, lb, ka, kb in cuts:
        for n, times, side in ((la, ka, 0),) if la == lb else ((la, ka, 1), (lb, kb, 2)):
            asked.setdefault(n, []).append((la, lb, times, side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            sizes = np.fromiter(map(len, names), np.int64, len(names))
            for n in np.intersect1d(sizes, list(asked)):
                own = np.flatnonzero(sizes == n)
                letters = np.frombuffer("".join(names[own]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                made = []
                for la, lb, times, side in asked[int(n)]:
                    h = _mixed(_short_hashes(letters, times) ^ _mixed(np.full(1, (la << 8) + lb, np.uint64) * _ODD))
                    made.append((h & ~np.uint64(3)) | np.uint64(side))
                h = np.concatenate(made, axis=1)
                x, h = np.repeat(ids[own], h.shape[1]), h.ravel()
                where = ((h >> np.uint64(2)) % np.uint64(bins)).astype(np.uint16)
                order = np.argsort(where, kind="stable")
                h, x, where = h[order], x[order], where[order]
                cuts_ = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
                parts = [[v[i:j].tobytes() for i, j in zip(cuts_[:-1], cuts_[1:], strict=True)] for v in (h, x)]
                yield pa.RecordBatch.from_arrays([pa.array(where[cuts_[:-1]].astype(np.int32)), *(pa.array(v, pa.binary()) for v in parts)], names=["bin", "h", "x"])

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(x, y)`` of names with a form in common, from rows in the order of their bins. With
    a fourth column only pairs that have a name from a row where it is false."""

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, x = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((0, np.uint64), (1, np.int64)))
        own = np.repeat([not any(r[2:]) for r in rows], [len(r[0]) // 8 for r in rows])
        if not own.any():
            return
        order = np.argsort(h)
        h, x, own = h[order], x[order], own[order]
        key = h >> np.uint64(2)
        same = np.r_[False, key[1:] == key[:-1], False]
        some = same[1:] | same[:-1]
        h, x, own = h[some], x[some], own[some]
        order = np.lexsort((~own, x, h))
        h, x, own = h[order], x[order], own[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])] if len(h) else np.empty(0, bool)
        h, x, own = h[new], x[new], own[new]
        if not own.any():
            return
        # Own names go before others of the same form and meet what comes after them; so that these
        # meet all of the other length too, the shorter own ones meet its others.
        order = np.lexsort((x, ~own, h))
        h, x, own = h[order], x[order], own[order]
        side, at, owned = h & np.uint64(3), np.arange(len(h)), np.r_[0, np.cumsum(own)]
        there = np.where(side == 0, h, h ^ np.uint64(3))
        first, end = np.searchsorted(h, there, "left"), np.searchsorted(h, there, "right")
        first = np.where(side == 0, at + 1, np.where(side == 1, first, first + owned[end] - owned[first]))
        count = np.where(own, end - first, 0)
        done = np.r_[0, np.cumsum(count)]
        lo = 0
        while lo < len(h):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + (1 << 18), "right")) - 1)
            i = np.repeat(at[lo:hi], count[lo:hi])
            j = np.arange(len(i)) - np.repeat(done[lo:hi] - done[lo], count[lo:hi]) + first[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], x[j])), pa.array(np.maximum(x[i], x[j]))], names=["x", "y"])
            lo = hi

    held, own = [], None
    for batch in batches:
        for bin_, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bin_ != own:
                yield from pairs(held)
                held, own = [], bin_
            held.append(row)
    yield from pairs(held)


_FORM = "bin int, h binary, x binary"


def _hashed(keyed: DataFrame, cuts: list[tuple[int, int, int, int]], bins: int) -> DataFrame:
    """Forms of names with their hashes. Names are few bytes and many forms: the tasks go by rows."""
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(tasks, "x").mapInArrow(_hashed_forms(cuts, bins), _FORM)


def _by_deletions(names: DataFrame, cuts: list[tuple[int, int, int, int]], counts: dict[int, int]) -> DataFrame:
    """Similar pairs among names of these lengths: those that share a string which both become
    by deletions. Strings meet by 62 bits of hash and names go by 64, so that pairs may come up in
    vain but none is lost; the few found are verified."""
    session = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = sum(counts.get(n, 0) * math.comb(n, k) for la, lb, ka, kb in cuts for n, k in {(la, ka), (lb, kb)})
    tasks = max(session, -(-made // FORMS))
    keyed = names.select("name", F.xxhash64("name").alias("x"))
    forms = _hashed(keyed, cuts, min(8 * tasks, 1 << 16))
    met = forms.repartition(tasks, "bin").sortWithinPartitions("bin").mapInArrow(_meeting, "x bigint, y bigint").distinct()
    both = met.join(keyed.select("x", F.col("name").alias("p")), "x").join(keyed.select(F.col("x").alias("y"), F.col("name").alias("q")), "y")
    return verified(both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def rare_grams(names: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``(name, n, gram, pos, df)``: the rarest trigrams of each name with so many letters that
    a similar name has one of them too. A gram's repeats in a name are told apart by number.

    The order is by ``counts`` (gram, df), by default those of the names themselves; any order
    serves as long as all names to be joined go by the same. Grams not counted come first. A
    gram that a name has more than once has no place: its repeats may stand for each other.
    """
    at = F.sequence(F.lit(1), F.col("n") - (GRAM - 1))
    grams = F.transform(at, lambda i: F.struct(F.substring(F.col("name"), i, F.lit(GRAM)).alias("g"), i.alias("pos")))
    same = lambda x, earlier: F.size(F.filter("grams", lambda y: (y["g"] == x["g"]) & ((y["pos"] < x["pos"]) | ~F.lit(earlier))))
    numbered = F.transform("grams", lambda x: F.struct(F.concat(x["g"], same(x, True).cast("string")).alias("gram"), F.when(same(x, False) == 1, x["pos"]).alias("pos")))
    plain = F.transform("grams", lambda x: F.struct(F.concat(x["g"], F.lit("0")).alias("gram"), x["pos"].alias("pos")))
    numbered = F.when(F.size(F.array_distinct(F.transform("grams", lambda x: x["g"]))) == F.size("grams"), plain).otherwise(numbered)
    each = names.where(F.col("n") >= LEAST).withColumn("grams", grams).select("name", "n", F.inline(numbered))
    if counts is None:
        counts = each.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = each.join(counts, "gram", "left").select("name", "n", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "pos").alias("g"))
    own = ranked.groupBy("name", "n").agg(F.array_sort(F.collect_list("g")).alias("gs"))
    # A pair of n letters and fewer loses at most 3n/14 of them, and with each three trigrams.
    most = F.least(F.col("n") - (GRAM - 1), F.floor(F.col("n") * (3 * GRAM) / 14).cast("int") + 1)
    return own.select("name", "n", F.inline(F.slice("gs", F.lit(1), most))).select("name", "n", "gram", "pos", "df")


def _gram_roles(grams: DataFrame, pairs: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`rare_grams` as those of the longer and of the shorter name of a pair of
    lengths, with the longer one's length as ``tag``, so that only such pairs meet."""
    plan = grams.sparkSession.createDataFrame(pairs, "tag int, lb int")  # a few dozen rows
    own = F.least("n", F.lit(SHORT + 1))
    longer = grams.join(F.broadcast(plan.select("tag").distinct()), own == F.col("tag"))
    return longer, grams.join(F.broadcast(plan), own == F.col("lb")).drop("lb")


def _by_grams(grams: DataFrame, lengths: list[tuple[int, int]]) -> DataFrame:
    """Similar pairs of these lengths among the names of :func:`rare_grams`."""
    one, two = _gram_roles(grams, lengths)
    parts = F.ceil(F.col("df") / HOT_GRAM).cast("int") + 1
    left = one.withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int")).select("tag", "gram", "part", F.col("name").alias("x"), F.col("n").alias("la"), F.col("pos").alias("i"))
    right = two.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("tag", "gram", "part", F.col("name").alias("y"), F.col("n").alias("lb"), F.col("pos").alias("j"))
    # The work is in the pairs and not in the bytes, so tasks aren't joined up by size.
    tasks = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(tasks, "tag", "gram", "part"), right.repartition(tasks, "tag", "gram", "part")
    near = ((F.col("la") > F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("x") < F.col("y")))) & (14 * F.col("lb") >= 11 * F.col("la")) & F.coalesce(14 * F.abs(F.col("i") - F.col("j")) <= 3 * F.col("la"), F.lit(True))
    k = F.floor((F.col("la") + F.col("lb")) * 12 / 100).cast("int")
    # The distance is taken before pairs are made distinct: few of them are left to shuffle.
    pairs = left.join(right, ["tag", "gram", "part"]).where(near & (F.call_function("levenshtein", F.col("x"), F.col("y"), k) >= 0))
    # Written, or the filters that follow would be taken into the join and run on all its rows.
    return verified(materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs"))


def verified(pairs: DataFrame) -> DataFrame:
    """The distinct pairs ``(a, b)`` of different names that are at least 88 percent alike."""
    k = F.floor((F.length("a") + F.length("b")) * 12 / 100)
    near = materialize(pairs.where(F.col("a") != F.col("b")).distinct().withColumn("e", F.levenshtein("a", "b")).where(F.col("e") <= k), "near")
    unsure = _dealt(near.where(2 * F.col("e") > k).select("a", "b")).where(ratio_udf()("a", "b") >= THRESHOLD)
    return near.where(2 * F.col("e") <= k).select("a", "b").unionByName(unsure)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of few bytes over the session's tasks, for work in Python that goes by rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _named(names: DataFrame) -> DataFrame:
    return names.select("name").where(F.length("name") > 0).distinct().withColumn("n", F.length("name"))


def _asked(lengths: set[int], but: set[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """:func:`length_pairs` without those of two lengths of ``but``."""
    cuts, pairs = length_pairs(lengths)
    return [c for c in cuts if not {c[0], c[1]} <= but], [p for p in pairs if not {p[0], p[1]} <= but]


def form_keys(names: DataFrame, lengths: set[int], but: set[int] = frozenset()) -> DataFrame:
    """``(key, h, x)``: hashes ``h`` of what deletions leave of the names, and the names' own ``x``,
    many to a row, as 64-bit numbers; ``key`` is their bin. Forms are made for pairs of these
    lengths without those for two lengths of ``but``."""
    cuts, _ = _asked(lengths, but)
    made = _hashed(_named(names).select("name", F.xxhash64("name").alias("x")), cuts, BINS) if cuts else names.sparkSession.createDataFrame([], _FORM)
    return made.select(F.col("bin").cast("string").alias("key"), "h", "x")


def met_by_forms(own: DataFrame, others: DataFrame) -> DataFrame:
    """Hashes ``(x, y)`` of names that share a form, out of rows of :func:`form_keys`: pairs among
    ``own``, and of one of these with one of ``others``. Forms meet in NumPy, a bin at a time, as
    tables of a row for each form are small enough as files to be broadcast and far larger in memory."""
    rows = own.select("key", "h", "x", F.lit(False).alias("other")).unionByName(others.select("key", "h", "x", F.lit(True).alias("other")))
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_meeting, "x bigint, y bigint").distinct()


def gram_keys(names: DataFrame, lengths: set[int], but: set[int] = frozenset()) -> DataFrame | None:
    """``(key, name)``: trigrams of which two similar names share one, for pairs of lengths that aren't
    joined by deletions; none if there are no such lengths. They go by alphabet, which stays."""
    _, pairs = _asked(lengths, but)
    if not pairs:
        return None
    grams = rare_grams(_of_lengths(_named(names), pairs), names.sparkSession.createDataFrame([], "gram string, df long"))
    return reduce(DataFrame.unionByName, (f.select(F.concat(F.lit("g"), F.col("tag").cast("string"), F.lit(","), "gram").alias("key"), "name") for f in _gram_roles(grams, pairs)))


def candidate_keys(names: DataFrame, lengths: set[int], but: set[int] = frozenset()) -> DataFrame:
    """``(key, name)``: keys of which two similar names of these lengths share one, whenever each
    was made; a row for each, of :func:`form_keys` and :func:`gram_keys`. Some rows repeat."""
    forms = form_keys(names, lengths, but).mapInArrow(_single, "h bigint, x bigint")
    keys = forms.join(_named(names).withColumn("x", F.xxhash64("name")).hint("merge"), "x").select(F.col("h").cast("string").alias("key"), "name")
    grams = gram_keys(names, lengths, but)
    return keys if grams is None else keys.unionByName(grams)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            # Whose form it is doesn't matter for a key.
            yield pa.RecordBatch.from_arrays([pa.array((np.frombuffer(h, np.uint64) >> np.uint64(2)).astype(np.int64)), pa.array(np.frombuffer(x, np.int64))], names=["h", "x"])


def _of_lengths(names: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    return names.where(F.least("n", F.lit(SHORT + 1)).isin([n for p in pairs for n in p]))


def similar_names(names: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct ``name`` values at least 88 percent alike."""
    names = materialize(_named(names), "names")
    counts = {r[0]: r[1] for r in names.groupBy(F.least(F.length("name"), F.lit(SHORT + 1))).count().collect()}
    cuts, pairs = length_pairs(set(counts))
    found = names.select(F.col("name").alias("a"), F.col("name").alias("b")).limit(0)
    if cuts:
        found = found.unionByName(_by_deletions(names, cuts, counts))
    if pairs:
        found = found.unionByName(_by_grams(materialize(rare_grams(_of_lengths(names, pairs)), "grams"), pairs))
    return found


def link_keys(listings: DataFrame) -> DataFrame:
    return listings.withColumn("_phone", match_digits(F.col("phone"))).withColumn("_name", name_key(F.col("name")))


def resolve(listings: DataFrame) -> DataFrame:
    """Add ``cluster`` to listings with ``id, name, phone, address``: the transitive closure of
    matching pairs, addresses checked per pair of equal or similar names. The result doesn't
    depend on the order of arrival, and the rule is the same for groups of any size."""
    return _with_cluster(listings, components(strict_edges(link_keys(listings))))


def strict_edges(keyed: DataFrame) -> DataFrame:
    """Matching edges: phone stars; for names, records of one (name, address) are a node that
    ties to the name's records without an address and to similar addresses of the name and of
    similar names. Distinct (name, address) pairs are compared, not records."""
    rows = materialize(keyed.select("id", "_phone", "_name", F.lower(F.coalesce("address", F.lit(""))).alias("_addr")), "keyed")
    by_phone = rows.where("_phone is not null").groupBy("_phone").agg(F.min("id").alias("b"))
    phone = rows.join(by_phone, "_phone").select(F.col("id").alias("a"), "b")
    named = rows.where("_name is not null")
    nodes = materialize(named.groupBy("_name", "_addr").agg(F.min("id").alias("b")), "nodes")
    same = named.join(nodes, ["_name", "_addr"]).select(F.col("id").alias("a"), "b")
    alike = similar_names(nodes.select(F.col("_name").alias("name")))
    groups = alike.unionByName(nodes.select(F.col("_name").alias("a"), F.col("_name").alias("b")).distinct())
    one = nodes.select(F.col("_name").alias("a"), F.col("_addr").alias("x"), F.col("b").alias("i"))
    two = nodes.select(F.col("_name").alias("b"), F.col("_addr").alias("y"), F.col("b").alias("j"))
    pairs = materialize(groups.join(one, "a").join(two, "b").where("i <> j and (a <> b or i < j)").select("i", "j", "x", "y"), "places")
    agree = agreeing(pairs, "x", "y").select("i", "j")
    return phone.unionByName(same).unionByName(agree.select(F.col("i").alias("a"), F.col("j").alias("b"))).where("a <> b")


def agreeing(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """Rows of a written table whose addresses agree: one is empty or contained in the other, or
    they are alike. Only the last is left to Python."""
    open_ = F.contains(one, F.col(two)) | F.contains(two, F.col(one))
    return pairs.where(open_).unionByName(_dealt(pairs.where(~open_)).where(partial_udf()(one, two) >= ADDRESS_THRESHOLD))


def _with_cluster(rows: DataFrame, found: DataFrame) -> DataFrame:
    roots = found.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(roots, rows["id"] == roots["_node"], "left").withColumn("cluster", F.coalesce("_root", "id")).drop("_node", "_root")


def best_place(leads: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each lead's place: the candidate whose name is most alike if 0.4 or more, else the
    first; dropped to an empty match if its name isn't 0.6 alike by the best of three ratios.

    The first 20 candidates of a lead count. Ratios are computed once per row, in one pass."""
    from bizlink.functions.fuzzy import best_ratio_udf, sorted_ratio_udf
    from bizlink.functions.identity import spaced_name
    from bizlink.operators.select import first_by

    few = first_by(candidates.where(F.contains("href", F.lit("/maps/place/"))), ["lead_id"], [F.col("cand_ord")], 20)
    a, b = spaced_name(F.col("target_name")), spaced_name(F.col("cand_name"))
    scored = few.withColumn("score", sorted_ratio_udf()(a, b)).withColumn("gate", best_ratio_udf()(a, b))
    best = scored.groupBy("lead_id").agg(F.max_by(F.struct("href", "score", "gate", "rating", "reviews"), F.struct("score", (-F.col("cand_ord")).alias("o"))).alias("top"), F.min_by(F.struct("href", "score", "gate", "rating", "reviews"), "cand_ord").alias("lead"))
    pick = F.when(F.col("top.score") >= 40, F.col("top")).otherwise(F.col("lead"))
    chosen = best.select("lead_id", pick.alias("p"))
    ok = F.coalesce(F.col("p.gate") >= 60, F.lit(False))
    return leads.select("lead_id").join(chosen, "lead_id", "left").select("lead_id", ok.alias("has_google_maps"), F.when(ok, F.col("p.href")).alias("google_maps_url"), F.when(ok, F.col("p.rating")).alias("google_rating"), F.when(ok, F.col("p.reviews")).otherwise(0).alias("google_review_count"))
