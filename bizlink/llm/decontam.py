"""Benchmark decontamination by Wu-Manber search over words (operator 9).

Test items become windows of 10 consecutive words (a shorter item is one window). Windows
of one length m form a search: a shift table over blocks of two words says how far the end
of the window may move when a block is seen (m - 1 words for a block that no window has),
buckets by the hash of the window's words select the windows that can end there, and a direct
comparison of the words confirms each. Documents are read once, in place: no shuffle.

Spark cuts long items into pieces and deals the pieces into blocks of about ``BLOCK_BYTES``, which
are sent to the tasks one at a time. A Python worker builds a block's tables once and keeps them
for its later tasks. With more than one block the finds of each are written, and united by document.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlink.llm.common import fresh, materialize

WINDOW = 10
#: Aim for the text of the items whose windows are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Words of an item that stay together.
PIECE_WORDS = 20_000
#: Words of short texts that are searched together; a longer text is searched alone.
TOGETHER = 100_000
#: ASCII bytes that are not part of a word become spaces, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _window_hash(ids: np.ndarray, starts: np.ndarray, m: int, seed: int) -> np.ndarray:
    h = np.full(len(starts), seed, np.uint64)
    for k in range(m):
        h = _mixed(h * _ODD + ids[starts + k].astype(np.uint64))
    return h


class Search:
    """Shift table and buckets for windows of one length ``m``. ``ids`` are the word numbers of
    all pieces, ``first`` and ``size`` where each piece of this search lies, ``owner`` its item."""

    def __init__(self, m: int, ids: np.ndarray, n_ids: int, first: np.ndarray, size: np.ndarray, owner: np.ndarray):
        self.m, self.ids, self.n_ids = m, ids, n_ids
        self.block = min(2, m)
        self.default = m - self.block + 1
        inside = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        n = size - self.block + 1
        at = inside(n)
        keys = self._blocks(ids, np.repeat(first, n) + at)
        shift = np.maximum(m - self.block - at, 0)
        order = np.lexsort((shift, keys))
        keys, shift = keys[order], shift[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        self.block_keys, self.shift = keys[new], shift[new].astype(np.int16)
        n = size - m + 1
        starts, owners = np.repeat(first, n) + inside(n), np.repeat(owner, n)
        h, h2 = _window_hash(ids, starts, m, 1), _window_hash(ids, starts, m, 2)
        order = np.lexsort((h2, h))
        h, h2, starts, self.owners = h[order], h2[order], starts[order], owners[order]
        run = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        self.bucket, self.start, self.run = h[run], starts[run], np.r_[run, len(h)]

    def _blocks(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = ids[at].astype(np.int64)
        return key if self.block == 1 else key * (self.n_ids + 1) + ids[at + 1]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences and the number of the window that occurs there."""
        m, b, n = self.m, self.block, len(ids)
        none = np.empty(0, np.int64)
        if n < m:
            return none, none
        keys = self._blocks(ids, np.arange(n - b + 1))
        at = np.minimum(np.searchsorted(self.block_keys, keys), len(self.block_keys) - 1)
        shift = np.where(self.block_keys[at] == keys, self.shift[at], self.default).tolist()
        ends, end = [], m
        while end <= n:
            step = shift[end - b]
            if step == 0:
                ends.append(end)
                step = 1
            end += step
        starts = np.array(ends, np.int64) - m
        h = _window_hash(ids, starts, m, 1)
        lo, hi = (np.searchsorted(self.bucket, h, side) for side in ("left", "right"))
        starts, window = np.repeat(starts, hi - lo), np.repeat(lo, hi - lo) + (np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
        same = np.ones(len(starts), bool)
        for k in range(m):
            same &= ids[starts + k] == self.ids[self.start[window] + k]
        return starts[same], window[same]


class Tables:
    """The searches of one block of pieces ``(item, m, text)``."""

    def __init__(self, items: list[str], lengths: list[int], texts: list[str]):
        self.items = items
        self.number: dict[bytes, int] = {}
        parts = [np.array([self.number.setdefault(w, len(self.number)) for w in t.encode().split()], np.int32) for t in texts]
        size = np.array([len(p) for p in parts], np.int64)
        first, m = np.cumsum(size) - size, np.array(lengths, np.int64)
        ids = np.concatenate([*parts, np.empty(0, np.int32)])
        owner = np.arange(len(items))
        self.searches = [Search(int(k), ids, len(self.number), first[m == k], size[m == k], owner[m == k]) for k in np.unique(m)]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Positions inside any occurrence, and the items that own one."""
        return self._hits([words])[0]

    def hits_of(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """Of each text the positions inside any occurrence, and the items that own one. Texts go
        through the tables together, an unknown word after each, which no window holds."""
        out, at = [], 0
        while at < len(texts):
            upto, n = at, 0
            while upto < len(texts) and (upto == at or n + len(texts[upto]) <= TOGETHER):
                n += len(texts[upto])
                upto += 1
            out += self._hits(texts[at:upto])
            at = upto
        return out

    def _hits(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        get, unknown = self.number.get, len(self.number)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size + 1) - (size + 1)
        ids = np.fromiter(chain.from_iterable(chain(map(get, t, repeat(unknown)), (unknown,)) for t in texts), np.int64, int((size + 1).sum()))
        edge, items = np.zeros(len(ids) + 1, np.int64), [set() for _ in texts]
        for s in self.searches:
            starts, window = s.find(ids)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + s.m, -1)
            owner = np.searchsorted(first, starts, "right") - 1
            for both in np.unique(owner * len(s.start) + window):
                k, u = divmod(int(both), len(s.start))
                items[k].update(self.items[o] for o in np.unique(s.owners[s.run[u] : s.run[u + 1]]))
        inside = np.cumsum(edge[:-1]) > 0
        return [(np.flatnonzero(inside[f : f + n]), own) for f, n, own in zip(first, size, items, strict=True)]


#: The tables of the block that a worker used last, by the block's name.
_BUILT: dict[str, Tables] = {}


def _tables(name: str, sent: Broadcast) -> Tables:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Tables(*sent.value)
    return _BUILT[name]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to ``(item, m, text)``: folded words joined by spaces, long items in overlapping parts."""
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = words_of(text)
            m = min(WINDOW, len(w))
            out += [(item, m, b" ".join(w[k : k + PIECE_WORDS + m - 1]).decode()) for k in range(0, len(w) - m + 1 if m else 0, PIECE_WORDS)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], names=["item", "m", "text"])


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct pieces with their block, and the number of blocks: so many that none holds
    over ``BLOCK_BYTES``, but for one that is a single piece."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    pieces = materialize(items.mapInArrow(_pieces, "item string, m int, text string").distinct(), "decontam-pieces")
    n = 1
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("c"))
        over = sizes.where((F.col("b") > BLOCK_BYTES) & (F.col("c") > 1)).agg(F.max("b")).first()[0]
        if over is None:
            return dealt, n
        n = max(2 * n, n * math.ceil(over / BLOCK_BYTES))


def _send(pieces: DataFrame, block: int) -> tuple[str, Broadcast]:
    own = pieces.where(F.col("block") == block).select("item", "m", "text").toArrow()
    return uuid.uuid4().hex, pieces.sparkSession.sparkContext.broadcast(tuple(own.column(k).to_pylist() for k in range(3)))


def _scan(name: str, sent: Broadcast, emit: Callable) -> Callable:
    """Batches through the tables: ``emit`` makes the rows of a slice with its hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(name, sent)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                words = [words_of(t) for t in part.column("text").to_pylist()]
                yield emit(part, [len(w) for w in words], tables.hits_of(words))

    return run


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _verdicts(part: pa.RecordBatch, n: list[int], found: list) -> pa.RecordBatch:
    sha = [hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for _, items in found]
    hit = pa.array([len(at) for at, _ in found], pa.int64())
    cols = [part.column("doc_id"), pa.array(n, pa.int64()), hit, pa.array([len(items) for _, items in found], pa.int64()), pa.array(sha), pa.compute.greater(hit, 0)]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", *(c.split()[0] for c in RESULT.split(", "))])


def _finds(part: pa.RecordBatch, n: list[int], found: list) -> pa.RecordBatch:
    hit = [k for k, (at, _) in enumerate(found) if len(at)]
    cols = [part.column("__row").take(pa.array(hit, pa.int64())), pa.array([found[k][0] for k in hit], pa.list_(pa.int64())), pa.array([sorted(found[k][1]) for k in hit], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, names=["__row", "at", "items"])


def _clean(part: pa.RecordBatch, n: list[int], found: list) -> pa.RecordBatch:
    return part.filter(pa.array([len(at) == 0 for at, _ in found], pa.bool_()))


def _finds_by_block(keyed: DataFrame, pieces: DataFrame, n: int) -> DataFrame:
    """``(__row, at, items)`` of rows with a find, block by block; one block is held at a time."""
    found = None
    for block in range(n):
        name, sent = _send(pieces, block)
        part = materialize(keyed.select("__row", "text").mapInArrow(_scan(name, sent, _finds), "__row bigint, at array<bigint>, items array<string>"), "decontam-finds")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row.

    Null texts have no words; an empty benchmark or an item without words hits nothing; a
    null item id counts as the empty string; repeated rows give a row each; other columns
    are ignored.
    """
    pieces, n = _blocks(benchmark)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    if n == 1:
        return docs.mapInArrow(_scan(*_send(pieces, 0), _verdicts), f"doc_id bigint, {RESULT}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(words_of(t)) for t in b.column("text").to_pylist()], pa.int64())], names=["__row", "doc_id", "text", "n_words"])

    keyed = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "text").mapInArrow(count, "__row bigint, doc_id bigint, text string, n_words bigint")
    keyed = materialize(keyed, "decontam")
    each = _finds_by_block(keyed, pieces, n).groupBy("__row").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("items")).alias("items"))
    each = keyed.select("__row", "doc_id", "n_words").join(each, "__row", "left")
    n_hit = F.coalesce(F.size(F.array_distinct("at")), F.lit(0)).cast("long")
    items = F.coalesce(F.array_sort(F.array_distinct("items")), F.array().cast("array<string>"))
    return each.select("doc_id", "n_words", F.greatest(n_hit, F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs. Null and
    empty texts stay, as do repeated rows."""
    pieces, n = _blocks(benchmark)
    if n == 1:
        return docs.mapInArrow(_scan(*_send(pieces, 0), _clean), docs.schema)
    row = fresh(docs, "__row")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontam")
    found = _finds_by_block(keyed.select(F.col(row).alias("__row"), "text"), pieces, n).select(F.col("__row").alias("__found"))
    return keyed.join(found, F.col(row) == found["__found"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
