"""SimHash near-duplicates with pigeonring filtering (operator 7).

A fingerprint has 64 bits in a ring of five segments. If two fingerprints differ in at most
four bits, some segment starts a chain whose first l segments differ in at most floor(4l/5)
bits for every l: 0, 1, 2, 3, 4. Chains of length two are the join key: the first segment
exactly, the second with any one bit left out, which is one key per bit of the fingerprint.
Members of a key are checked for the budgets of the longer chains, then by full Hamming
distance, and only the edges of a spanning forest of each key leave the task. A key with
more members than ``BUCKET`` isn't compared: its members are instead tied to every value
within two bits of them, which links the same pairs (two values within four bits share such
a middle) with work linear in the members. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlink.llm.common import fresh, materialize, n_tasks
from bizlink.llm.graph import components

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4
#: Members of one key that are compared with each other; larger keys take the middle values.
BUCKET = 16_384
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: First bit of each of the five segments, and the end.
_CUTS = [0, 13, 26, 39, 52, 64]
_SEGMENT = [sum(1 << b for b in range(_CUTS[i], _CUTS[i + 1])) for i in range(5)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, fp)``: the fingerprint of every whole text, ``th`` its XXH64.

    A null or empty text, or one of white space, has fingerprint 0. No shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                fp = fingerprint_texts(part.column(2).to_pylist())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(fp.view(np.int64))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


def fingerprint_texts(texts: list[str | None]) -> np.ndarray:
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    h = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = (text or "").encode().translate(_LOWER).split()
        if len(words) <= SHINGLE:
            own = [h(b" ".join(words), SEED)] if words else []
        else:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - SHINGLE].tolist()
            own = [h(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
        counts[k] = len(own)
        hashes += own
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        some = np.flatnonzero(counts)
        at = np.concatenate([[0], np.cumsum(counts[some])])
        raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        for k, doc in enumerate(some):
            ones = np.unpackbits(raw[at[k] : at[k + 1]], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[doc] = np.packbits(2 * ones > counts[doc], bitorder="little").view("<u8")[0]
    return out


def _chain_keys() -> list[tuple[int, int]]:
    """(bit, mask) of each key: the segment before the bit's, and the bit's without the bit."""
    out = []
    for t in range(5):
        for b in range(_CUTS[t], _CUTS[t + 1]):
            out.append((b, (_SEGMENT[t - 1] | _SEGMENT[t]) & ~(1 << b)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _budgets(start: int) -> list[tuple[np.uint64, int]]:
    """Masks of the chains of 2 to 5 segments from ``start`` with the bits they may differ in."""
    out, mask = [], _SEGMENT[start]
    for n in range(2, 6):
        mask |= _SEGMENT[(start + n - 1) % 5]
        out.append((np.uint64(mask), n * DISTANCE // 5))
    return out


_BUDGETS = [_budgets(i) for i in range(5)]
_START = [next((t - 1) % 5 for t in range(5) if _CUTS[t] <= b < _CUTS[t + 1]) for b in range(BITS)]


def _near(diff: np.ndarray, start: int) -> np.ndarray:
    """Which differences stay within the budget of every chain, the whole ring last."""
    ok = np.ones(len(diff), bool)
    for mask, most in _BUDGETS[start]:
        ok &= np.bitwise_count(diff & mask) <= most
    return ok


def _forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the members of one key."""
    edges, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _near(left ^ x, start)
            if near.any():
                found, left = left[near], left[~near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
    return edges


def _link_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bit, key, fp) to edges; a key over the limit to its members, b null.

    A member within the budgets of a third one only through other keys is found there.
    """
    names = ["a", "b"]

    def out(pairs: list[tuple[int, int | None]]) -> pa.RecordBatch:
        a = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array([None if p[1] is None else _signed(p[1]) for p in pairs], pa.int64())], names=names)

    held: list[np.ndarray] = []
    held_key, held_n, over = None, 0, False

    def close() -> list[tuple[int, int | None]]:
        if over:
            return [(int(x), None) for part in held for x in part]
        return _forest(np.concatenate(held), _START[held_key[0]]) if held_n > 1 else []

    for batch in batches:
        bit = batch.column(0).to_numpy()
        key = batch.column(1).to_numpy()
        fp = batch.column(2).to_numpy().view(np.uint64)
        if not len(bit):
            continue
        cut = np.flatnonzero(np.r_[True, (bit[1:] != bit[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[cut, len(bit)])
        pairs: list[tuple[int, int | None]] = []
        last = len(cut) - 1
        twos = np.flatnonzero((size == 2) & (np.arange(len(cut)) != 0) & (np.arange(len(cut)) != last))
        if len(twos):
            i = cut[twos]
            x, y, starts = fp[i], fp[i + 1], np.array(_START)[bit[i]]
            for s in range(5):
                own = starts == s
                ok = _near(x[own] ^ y[own], s)
                pairs += list(zip(x[own][ok].tolist(), y[own][ok].tolist(), strict=True))
        todo = sorted({0, last, *np.flatnonzero(size > 2).tolist()})
        for g in todo:
            i, n = int(cut[g]), int(size[g])
            k, members = (int(bit[i]), int(key[i])), fp[i : i + n]
            if k != held_key:
                pairs += close()
                held, held_key, held_n, over = [], k, 0, False
            held.append(members.copy())
            held_n += n
            if held_n > BUCKET:
                over = True
                pairs += close()
                held = []
        if pairs:
            yield out(pairs)
    rest = close()
    if rest:
        yield out(rest)


def _middles(members: DataFrame) -> DataFrame:
    """Edges among ``fp`` through the values within two bits of them."""
    one = [1 << b for b in range(BITS)]
    masks = [0, *one, *(x | y for i, x in enumerate(one) for y in one[:i])]
    spread = members.select("fp", F.explode(F.array([F.lit(_signed(m)) for m in masks])).alias("m"))
    around = spread.groupBy(F.col("fp").bitwiseXOR(F.col("m")).alias("middle")).agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` among distinct ``fp`` that connect all within four bits."""
    keys = F.array(*(F.struct(F.lit(b).cast("int").alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for b, m in _chain_keys()))
    spread = distinct.select("fp", F.explode(keys).alias("k")).select("k.bit", "k.key", "fp")
    sorted_keys = spread.repartition(n_tasks(distinct), "bit", "key").sortWithinPartitions("bit", "key", "fp")
    found = materialize(sorted_keys.mapInArrow(_link_keys, "a bigint, b bigint").distinct(), "links")
    crowded = found.where("b is null").select(F.col("a").alias("fp"))
    edges = found.where("b is not null")
    return edges if crowded.isEmpty() else edges.unionByName(_middles(crowded))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, fingerprint, component_id)`` for every row.

    ``component_id`` is the smallest doc_id that links reach, null only where all ids of the
    group are null. Repeated rows give a row each; other columns are ignored.
    """
    each = materialize(fingerprints(docs), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("low"))
    stars = components(links(distinct.select("fp")))
    nodes = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    nodes = materialize(nodes, "nodes")
    grown = nodes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("root", "component_id")
    classes = nodes.join(grown, "root", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return each.join(classes, "fp").select("doc_id", "th", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest doc_id of each group; of rows that
    share that id the one with the smallest text hash, of repeated rows one."""
    verdict = near_duplicates(docs)
    groups = verdict.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("alone"))
    keep = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.th").alias("keep_th"))
    th, n = fresh(docs, "__th"), fresh(docs, "__n")
    keyed = docs.withColumn(th, F.xxhash64("text"))
    both = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep["keep_id"]) & (keyed[th] == keep["keep_th"]), "left_semi")
    once = Window.partitionBy("doc_id", th).orderBy("doc_id", th)
    return both.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
