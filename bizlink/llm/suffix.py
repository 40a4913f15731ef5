"""Repeated substrings by a depth-limited, most-significant-digit sort of suffixes (operator 10).

A suffix is ordered by its first ``DEPTH`` bytes only, a window; equal groups are the
repeated windows. The digits are taken in an order that lets most suffixes go early:

1. The first digit of a window is its anchor, the smallest hash of a ``GRAM``-byte string in
   it (the leftmost of equal ones), with the anchor's place. Equal windows have equal
   anchors, and one anchor serves all consecutive windows that chose it, so a pass over the
   text gives one row for about 90 windows. A group with one row holds no repeat and is dropped.
2. The second digit is the whole stretch of text under those windows. Rows with an equal
   anchor and stretch (128 bits together) settle all their windows at once; this takes care
   of copies, and most repeats are found here.
3. What is left, anchors that are equal in stretches that differ, is where repeats begin and
   end. One row of each stretch is expanded to its windows, which go through passes over four
   digits of 50 bytes, keeping only groups that are still tied; the windows of a tied group are
   compared byte by byte.

So equal groups are those of the named sort, but suffixes are never put in the order of their
bytes, which nothing here needs. Only anchor rows, the contexts of step 3 and one copy of the
texts are dealt out, and rows of frequent anchors and stretches are spread. An anchor with more
than ``MEMBERS`` stretches is sorted window by window across tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlink.llm.common import HOT_ROWS, materialize, materialize_buckets, n_tasks, spread_join

DEPTH, GRAM, DIGIT = 200, 24, 50
#: Bytes of a text that are worked on at once; the next piece starts so that no window is lost.
PIECE = 1 << 17
#: Stretches of one anchor that a task sorts in memory.
MEMBERS = 10_000
#: What makes up more than this part of a task's rows, and of all, is not dealt out by its anchor
#: alone; pairs that a task counts at a time for that.
FREQUENT, HELD_PAIRS = 2_000, 1 << 20
_PAIR = np.dtype([("h", np.uint64), ("s", np.uint64), ("n", np.int64), ("id", np.int64), ("th", np.int64), ("first", np.int32), ("last", np.int32), ("at", np.int32)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


_BYTE, _BYTE2 = _table(1), _table(2)
_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + DEPTH, _ODD)]), dtype=np.uint64)
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + DEPTH, np.uint64(pow(int(_ODD), -1, 1 << 64)))]), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _gram_hashes(data: np.ndarray, size: int, table: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, built from halves."""
    levels, width = {1: table[data]}, 1
    while 2 * width <= size:
        h = levels[width]
        levels[2 * width] = h[:-width] * _POWER[width] + h[width:]
        width *= 2
    out, done = levels[width], width
    for bit in sorted(levels, reverse=True):
        if done + bit <= size and size - done & bit:
            n = len(data) - done - bit + 1
            out = out[:n] * _POWER[bit] + levels[bit][done : done + n]
            done += bit
    return _mixed(out)


def _window_minima(key: np.ndarray, width: int) -> np.ndarray:
    now, size = key, 1
    while 2 * size <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    return np.minimum(now[: len(key) - width + 1], now[width - size :]) if size < width else now


def anchors(data: np.ndarray) -> list[np.ndarray]:
    """(gram hash, stretch hash, first window, last window, anchor) of one text's bytes."""
    parts: list[list[np.ndarray]] = []
    for off in range(0, max(0, len(data) - DEPTH + 1), PIECE):
        piece = data[off : off + PIECE + DEPTH - 1]
        grams = _gram_hashes(piece, GRAM, _BYTE)
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 24) - 1)
        at = (_window_minima((grams & ~low) | place, DEPTH - GRAM + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE2[piece] * _POWER[: len(piece)], dtype=np.uint64)])
        stretch = (sums[last + DEPTH] - sums[first]) * _INVERSE[first]
        a = at[first]
        stretch = _mixed(stretch ^ ((last - first).astype(np.uint64) << np.uint64(20)) ^ (a - first).astype(np.uint64))
        parts.append([grams[a], stretch, first + off, last + off, a + off])
    return [np.concatenate([p[k] for p in parts]) for k in range(5)] if parts else [np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor rows (kind 0), and at the end of the task what is frequent in it: (anchor, stretch)
    pairs with their number of rows and one of these (kind 1) and anchors with their number of
    stretches (kind 2)."""
    names = ["kind", "id", "th", "h", "s", "first", "last", "at", "n"]
    counted, held, rows = np.empty(0, _PAIR), [], 0

    def merged(limit: int) -> np.ndarray:
        whole = np.concatenate([counted, *held])
        order = np.lexsort((whole["s"], whole["h"]))
        h, s = whole["h"][order], whole["s"][order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])]) if len(whole) else np.empty(0, np.int64)
        out = whole[order[new]]
        out["n"] = np.add.reduceat(whole["n"][order], new) if len(new) else out["n"]
        _, group, stretches = np.unique(out["h"], return_inverse=True, return_counts=True)
        return out[(out["n"] >= limit) | (stretches[group] >= limit)] if len(out) else out

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = [anchors(_bytes(t)) for t in part.column(2).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            h, s, *places = (np.concatenate([f[k] for f in found]) for k in range(5))
            id_, th = (part.column(k).to_numpy()[row] for k in (0, 1))
            held.append(np.rec.fromarrays([h, s, np.ones(len(h), np.int64), id_, th, *places], dtype=_PAIR))
            rows += len(h)
            if sum(map(len, held)) > HELD_PAIRS:
                # Pairs that are rare so far go, as in counting frequent items with bounded memory.
                counted, held = merged(max(1, rows // FREQUENT)), []
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(row), np.int8)), pa.array(id_), pa.array(th), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), *(pa.array(p.astype(np.int32)) for p in places), pa.nulls(len(row), pa.int64())], names=names)
    counted = merged(max(2, rows // FREQUENT))
    least = max(2, rows // FREQUENT)
    pairs = counted[counted["n"] >= least]
    h, stretches = np.unique(counted["h"], return_counts=True)
    many = np.zeros(int((stretches >= least).sum()), _PAIR)
    many["h"], many["n"] = h[stretches >= least], stretches[stretches >= least]
    for kind, found in ((1, pairs), (2, many)):
        columns = (np.ascontiguousarray(found[k]) for k in names[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int8)), *(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns)], names=names)


def removed(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n bytes lie in a window that starts in one of the ranges (first, last)."""
    edge = np.zeros(n + 1, np.int32)
    if spans:
        s = np.array(spans, np.int64)
        np.add.at(edge, s[:, 0], 1)
        np.add.at(edge, s[:, 1] + DEPTH, -1)
    return np.cumsum(edge[:n]) > 0


def _digest(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    gone = removed(len(data), spans)
    starts = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return len(data), int(gone.sum()), starts, hashlib.sha256(data[~gone].tobytes()).hexdigest()


_RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_CONTEXT = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("members", pa.int64()), ("context", pa.binary())])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of texts without open anchors; of the others text, spans and contexts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            done, texts, spans, contexts = [], [], [], []
            for text, found in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                data, found = _bytes(text), found or []
                own = [(f["first"], f["last"]) for f in found if f["copied"]]
                still = [f for f in found if f["open"]]
                texts.append(text if still else None)
                spans.append([{"first": a, "last": b} for a, b in own] if still else None)
                contexts.append([{k: f[k] for k in ("h", "at", "first", "last", "members")} | {"context": data[f["first"] : f["last"] + DEPTH].tobytes()} for f in still])
                done.append((None,) * 4 if still else _digest(data, own))
            cols = [pa.array([d[k] for d in done], t) for k, (_, t) in enumerate(_RESULT)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), *cols, pa.array(texts, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(contexts, pa.list_(_CONTEXT))],
                names=["doc_id", "id", "th", *(n for n, _ in _RESULT), "text", "spans", "contexts"],
            )


def _context_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All contexts of a batch as one array of bytes, and where each begins."""
    text = batch.column("context")
    buffers, base = text.buffers(), text.offset
    cuts = np.frombuffer(buffers[1], np.int32)[base : base + len(text) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[cuts[0] : cuts[-1]] if len(text) else np.empty(0, np.uint8)
    return data, cuts[:-1] - cuts[0]


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (h, first, last, at, context) for every window: row, start in its context, start in
    the bytes of all contexts, place of the anchor; and those bytes."""
    first, last, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "at"))
    data, begins = _context_bytes(batch)
    count = last - first + 1
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return row, inside, begins[row] + inside, at[row] - first[row] - inside, data


def _by_digits(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows are tied with another of their group after all digits, by passes over
    digits of 50 bytes from the most significant; groups of one leave early. A digit is compared
    by its hash; members of a group that is left are then compared byte by byte."""
    left = np.arange(len(start))
    blocks = _gram_hashes(data, DIGIT, _BYTE2) if len(data) >= DIGIT else np.empty(0, np.uint64)
    for k in range(0, DEPTH, DIGIT):
        _, group, n = np.unique(_mixed(group ^ blocks[start[left] + k] * _ODD), return_inverse=True, return_counts=True)
        tied = n[group] > 1
        left, group = left[tied], group[tied].astype(np.uint64)
        if len(left) == 0:
            return left
    order = np.argsort(group, kind="stable")
    left, group = left[order], group[order]
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    head = np.repeat(begins, np.diff(np.r_[begins, len(group)]))
    words = np.lib.stride_tricks.sliding_window_view(data, DEPTH)
    unlike = np.zeros(len(left), bool)
    for lo in range(0, len(left), 50_000):
        own = slice(lo, lo + 50_000)
        unlike[own] = (words[start[left[own]]] != words[start[left[head[own]]]]).any(axis=1)
    if unlike.any():
        # Hashes that met by chance: the few groups concerned are ordered by their bytes.
        keep = ~np.isin(group, group[unlike])
        again: dict[tuple[int, bytes], list[int]] = {}
        for i in np.flatnonzero(~keep):
            again.setdefault((int(group[i]), words[start[left[i]]].tobytes()), []).append(i)
        keep[[i for found in again.values() if len(found) > 1 for i in found]] = True
        left = left[keep]
    return np.sort(left)


def _tied(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Ranges of windows of whole anchor groups that are equal to another window."""
    row, inside, start, place, data = _windows(batch)
    group = _mixed(batch.column("h").to_numpy().view(np.uint64)[row] ^ (place.astype(np.uint64) * _ODD))
    left = _by_digits(data, start, group)
    return _ranges(batch, row[left], inside[left])


def _ranges(batch: pa.RecordBatch, row: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
    start = inside + batch.column("first").to_numpy().astype(np.int64)[row]
    begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.empty(0, np.int64)
    ends = np.r_[begins[1:] - 1, len(row) - 1] if len(row) else begins
    take = pa.array(row[begins])
    return pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("th").take(take), pa.array(start[begins].astype(np.int32)), pa.array(start[ends].astype(np.int32))], names=["id", "th", "first", "last"])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor hash; groups are completed across batches, many sorted at once."""
    held: pa.RecordBatch | None = None

    def pieces(whole: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo = 0
        while lo < len(cuts) - 1:
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + 2_000, "right")) - 1)
            yield _tied(whole.slice(int(cuts[lo]), int(cuts[hi] - cuts[lo])))
            lo = hi

    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = batch.column("h").to_numpy()
        cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        if len(cuts) > 1:
            yield from pieces(batch, cuts)
        held = batch.slice(int(cuts[-1])) if len(cuts) else batch
    if held is not None and held.num_rows:
        yield _tied(held)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window, for anchors with too many stretches for a task."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            row, inside, at, place, data = _windows(part)
            blocks = _gram_hashes(data, DIGIT, _BYTE2) if len(data) else data
            digits = [blocks[at + k] for k in range(0, DEPTH, DIGIT)]
            take = pa.array(row)
            start = inside + part.column("first").to_numpy().astype(np.int64)[row]
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(take), part.column("th").take(take), part.column("h").take(take), pa.array(place.astype(np.int32)), *(pa.array(d.view(np.int64)) for d in digits), pa.array(start.astype(np.int32))],
                names=["id", "th", "h", "place", "d0", "d1", "d2", "d3", "first"],
            )


def repeated_ranges(contexts: DataFrame, tasks: int) -> DataFrame:
    """``(id, th, first, last)`` of windows of the contexts that occur twice."""
    own = "id bigint, th bigint, first int, last int"
    few = contexts.where(F.col("members") <= MEMBERS).repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(_sort_groups, own)
    keys = ["h", "place", "d0", "d1", "d2", "d3"]
    wide = contexts.where(F.col("members") > MEMBERS).mapInArrow(_spread, "id bigint, th bigint, h bigint, place int, d0 bigint, d1 bigint, d2 bigint, d3 bigint, first int")
    twice = wide.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    many = spread_join(wide, twice.select(*keys), keys, materialize(twice, "suffix-hot"), ["id", "th", "first"], "left_semi").select("id", "th", "first", F.col("first").alias("last"))
    return few.unionByName(many)


def marked_anchors(rows: DataFrame) -> DataFrame:
    """``(id, th, h, at, first, last, members, copied, open)`` of anchor rows whose stretch occurs
    again (``copied``) or that stand for their stretch where their anchor has several (``open``).

    Frequent pairs of anchor and stretch are known from the tasks' own counts and are fewer than
    ``FREQUENT`` by construction. Each row is asked once whether its pair is one of them, and then
    is settled and dealt out by its place; one row of each pair, which the tasks gave with the
    counts, stands for it among the rows of its anchor. Frequent anchors are sorted by stretch in
    several tasks. The rest is sorted by anchor.
    """
    total = rows.where("kind = 0").count()
    often = lambda kind, keys, *more: rows.where(F.col("kind") == kind).groupBy(*keys).agg(F.sum("n").alias("n"), *more).where(F.col("n") >= max(HOT_ROWS, total // FREQUENT))
    place = ["id", "th", "first", "last", "at"]
    pairs = materialize(often(1, ["h", "s"], F.min(F.struct(*place)).alias("one")), "suffix-pairs")
    anchors_ = F.broadcast(often(2, ["h"]).select("h", F.col("n").alias("stretches")))
    own = rows.where("kind = 0").join(F.broadcast(pairs.select("h", "s", F.lit(True).alias("settled"))), ["h", "s"], "left")
    own = own.select("h", "s", *place, F.coalesce("settled", F.lit(False)).alias("settled"), F.lit(False).alias("stands"))
    ones = pairs.select("h", "s", "one.*", F.lit(False).alias("settled"), F.lit(True).alias("stands"))
    # Parts below zero hold settled rows only.
    part = F.when(F.col("settled"), -1 - F.pmod(F.xxhash64("id", "th", "first"), F.lit(1024))).when(F.col("stretches").isNotNull(), F.pmod("s", F.lit(1024))).otherwise(0)
    dealt = own.unionByName(ones).join(anchors_, "h", "left").withColumn("part", part)
    group = Window.partitionBy("h", "part")
    by_stretch = group.orderBy("s")
    new = ~F.col("settled") & F.coalesce(F.lag("s").over(by_stretch) != F.col("s"), F.lit(True))
    copied = F.col("stands") | ~new | F.coalesce(F.lead("s").over(by_stretch) == F.col("s"), F.lit(False))
    marked = dealt.withColumn("new", new).withColumn("copied", copied)
    marked = marked.withColumn("members", F.coalesce("stretches", F.sum(F.col("new").cast("long")).over(group)))
    marked = marked.withColumn("open", F.col("new") & (F.col("members") > 1)).where("copied or open")
    return marked.select("id", "th", "h", "at", "first", "last", "members", "copied", "open")


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row.

    Each byte under a string of ``DEPTH`` bytes that also starts elsewhere is removed, in all
    its places. A null text counts as empty, shorter texts have no windows, rows that repeat
    id and text are copies of each other; other columns are ignored.
    """
    tasks = n_tasks(docs)
    # A null id can't be a join key; equal texts are copies, so that any value serves for it.
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64("text").alias("th"), "text")
    anchor = "kind tinyint, id bigint, th bigint, h bigint, s bigint, first int, last int, at int, n bigint"
    rows = materialize(keyed.select("id", "th", "text").mapInArrow(_anchor_rows, anchor), "suffix-anchors")
    found = marked_anchors(rows).groupBy("id", "th").agg(F.collect_list(F.struct("h", "at", "first", "last", "members", "copied", "open")).alias("found"))
    joined = keyed.join(found, ["id", "th"], "left").select("doc_id", "id", "th", "text", "found")
    result = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    span = "array<struct<first: int, last: int>>"
    settled = joined.mapInArrow(_settle, f"doc_id bigint, id bigint, th bigint, {result}, text string, spans {span}, contexts array<struct<h: bigint, at: int, first: int, last: int, members: bigint, context: binary>>")
    settled = materialize_buckets(settled, "suffix", ["id", "th"], tasks)
    contexts = settled.where("text is not null").select("id", "th", F.inline("contexts"))
    ranges = repeated_ranges(contexts, tasks).groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("more"))
    pending = settled.where("text is not null").select("doc_id", "id", "th", "text", "spans").join(ranges, ["id", "th"], "left").select("doc_id", "text", "spans", "more")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for text, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                done.append(_digest(_bytes(text), [(x["first"], x["last"]) for x in (*(a or ()), *(b or ()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[k] for d in done], t) for k, (_, t) in enumerate(_RESULT))], names=["doc_id", *(n for n, _ in _RESULT)])

    final = settled.where("text is null").select("doc_id", *(n for n, _ in _RESULT))
    return final.unionByName(pending.mapInArrow(finish, f"doc_id bigint, {result}"))
