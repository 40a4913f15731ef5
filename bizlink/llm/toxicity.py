"""Toxicity from class-conditional Kneser-Ney models (operator 6).

Each class, toxic and ordinary, has a model of word pairs from a bounded sample of labelled rows
(``PER_CLASS`` rows of each label, by hash of the id). Its levels, each interpolated with the next:

1. counts of word pairs, a pair counting once in a text, so that a text that repeats itself doesn't
   outvote others;
2. continuation counts of words: how many different words come before one in the class, so that
   a copied text counts a word once;
3. counts of words that both classes share and that are taken over all documents: an expression
   that is rare in a class gets there the probability that it has anywhere.

What one or two occurrences would give is left to the next level whole; higher counts lose the
modified Kneser-Ney discount, estimated from counts of counts, and their standard error beside it,
so that chance repeats of rare words don't look like expressions of a class. The shared counts
cover every word of the corpus and stay a distributed table; only those of words that a class has something left for
are sent to the tasks, as any other word is as likely in one class as in the other up to the
classes' backoff weights. A document is scored from its length-normalised log-likelihood ratio, the part
of it that comes from expressions well above the noise of sparse counts, that part's sum, and the length, by a logistic
curve fitted on labelled rows that the counts didn't see.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlink.llm.common import materialize, units

#: Labelled rows of each label that the class counts take, and that the curve takes.
PER_CLASS, PER_CLASS_CURVE = 20_000, 5_000
#: Log-likelihood ratio from which a word pair counts as more than noise.
MARGIN = 1.0
#: Discount of higher counts where the counts of counts give none.
DISCOUNT = 0.75
#: What stands before a text's first word.
START = 0
#: Bytes of text that are taken together.
UNIT_BYTES = 8 << 20
#: Different words, and word pairs of labelled rows, from which counts leave the worker.
FLUSH_WORDS, FLUSH_PAIRS = 1 << 18, 1 << 22
#: A word, or what parts pieces of text that are taken apart together.
_WORD = re.compile(r"\w+|\n")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)).cast("int")


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, folds: Column) -> DataFrame:
    """At most ``per_class`` rows ``(id, y)`` of each label; of labels that disagree the higher."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("y")).where(folds)
    parts = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select(F.col("doc_id").cast("long").alias("id"), F.col("y").cast("int").alias("y"))


def _numbers() -> defaultdict[str, int]:
    """Numbers of words as they are met, from 1; 0 is what stands before a text's first word."""
    number = defaultdict(count().__next__)
    number["\n"] = number.default_factory()
    return number


def _number_hashes(number: dict[str, int]) -> np.ndarray:
    hashes = _hashes(list(number))
    hashes[0] = START
    return hashes


def _numbered(texts: pa.Array, number: defaultdict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as their numbers, and where those of each text begin and the last end.

    A word is a run of letters, digits and underscores of the text in lower case. Arrow cuts the texts
    at spaces and line ends, which are in no word and decide a letter's lower case as an end of text
    does, so each distinct piece is taken apart once, all in one string with line ends between them.
    """
    cut = pa.compute.split_pattern(pa.compute.replace_substring(texts.fill_null(""), "\n", " "), " ")
    pieces = cut.flatten().dictionary_encode()
    every = pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary)
    found = _WORD.findall(pa.compute.binary_join(every, "\n")[0].as_py().lower())
    own = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
    marks = np.flatnonzero(own == 0)
    own = own[own != 0]
    ends = np.concatenate([[0], marks - np.arange(len(marks)), [len(own)]]).astype(np.int32)
    got = pa.ListArray.from_arrays(pa.array(ends), pa.array(own)).take(pieces.indices)
    at = got.offsets.to_numpy()[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
    return got.flatten().to_numpy().astype(np.int64), at


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, v, w, n) of a task's texts: texts that hold a word pair, for labelled rows under
    their label, and under kind 2 the words of all rows."""
    number, total = _numbers(), np.zeros(0, np.int64)
    pairs: list[list[np.ndarray]] = [[], []]
    waiting = 0
    for part in units(batches, 0, UNIT_BYTES):
        own, at = _numbered(part.column(0), number)
        more = np.bincount(own, minlength=len(number))
        more[: len(total)] += total
        total = more
        for k, y in enumerate(part.column(1).to_pylist()):
            text = own[at[k] : at[k + 1]]
            if y is not None and len(text):
                pairs[y].append(np.unique(np.r_[0, text[:-1]] << 32 | text))
                waiting += len(pairs[y][-1])
        if len(number) > FLUSH_WORDS or waiting > FLUSH_PAIRS:
            yield from _counts(number, total, pairs)
            number, total, pairs, waiting = _numbers(), np.zeros(0, np.int64), [[], []], 0
    yield from _counts(number, total, pairs)


def _counts(number: dict[str, int], total: np.ndarray, pairs: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    hashes = _number_hashes(number)
    yield _rows(2, np.zeros(len(total[1:]), np.int64), hashes[1:], total[1:])
    for y in (0, 1):
        if pairs[y]:
            both, n = np.unique(np.concatenate(pairs[y]), return_counts=True)
            yield _rows(y, hashes[both >> 32], hashes[both & 0xFFFFFFFF], n)


def _rows(kind: int, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), kind, np.int32)), pa.array(v), pa.array(w), pa.array(n.astype(np.int64))], names=["kind", "v", "w", "n"])


def discount(n: list[float]) -> float:
    """Discount of counts of three and more from how many grams occur 1, 2, 3 and 4 times."""
    if not (n[0] and n[1] and n[2]):
        return DISCOUNT
    return min(max(3 - 4 * n[0] / (n[0] + 2 * n[1]) * n[3] / n[2], 0.1), 2.9)


def lost(n: Column, cut: Column) -> Column:
    """What a count gives to the next level."""
    n = n.cast("double")
    return F.when(n <= 2, n).otherwise(F.least(n, cut + F.sqrt(n)))


class Model:
    """Probabilities of words and word pairs by class, for words of labelled rows in the order
    of their hashes; a word outside has the number of words as its place."""

    def __init__(self, words: pa.Table, pairs: pa.Table, back: list[float], shared_total: int):
        col = lambda t, c: t.column(c).to_numpy()
        order = np.argsort(col(words, "key"))
        self.key = col(words, "key")[order]
        size, floor = len(self.key), 1 / max(1, shared_total)
        shared = np.maximum(np.r_[col(words, "shared")[order] * floor, 0], floor)
        pair = np.searchsorted(self.key, col(pairs, "v")) * size + np.searchsorted(self.key, col(pairs, "w"))
        by_pair = np.argsort(pair)
        self.pair = pair[by_pair]
        self.word = [np.r_[col(words, f"kept{y}")[order], 0] + back[y] * shared for y in (0, 1)]
        self.rest = [np.r_[col(words, f"rest{y}")[order], 1.0] for y in (0, 1)]
        self.more = [col(pairs, f"more{y}")[by_pair] for y in (0, 1)]

    def place(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, hashes)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == hashes[known]
        return np.where(known, at, len(self.key))

    def ratios(self, places: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(word | before, toxic) - log P(word | before, ordinary)."""
        size = len(self.key)
        seen = np.flatnonzero((places < size) & (before < size))
        pair = before[seen] * size + places[seen]
        at = np.searchsorted(self.pair, pair)
        kept = at < len(self.pair)
        kept[kept] = self.pair[at[kept]] == pair[kept]
        seen, at = seen[kept], at[kept]
        p = []
        for y in (0, 1):
            now = self.rest[y][before] * self.word[y][places]
            now[seen] += self.more[y][at]
            p.append(now)
        return np.log(p[1]) - np.log(p[0])


def _features(model: Model, texts: pa.Array) -> np.ndarray:
    """Mean excess over the margin, mean ratio, number of words, summed excess, by text."""
    number = _numbers()
    own, at = _numbered(texts, number)
    of_number = model.place(_number_hashes(number))
    places = of_number[own]
    n = np.diff(at)
    some = n > 0
    first = at[:-1][some]
    before = np.roll(places, 1)
    before[first] = of_number[0]
    r = model.ratios(places, before)
    out = np.zeros((len(texts), 4))
    if len(first):
        high, n = np.add.reduceat(np.maximum(r - MARGIN, 0), first), n[some]
        out[some] = np.column_stack([high / n, np.add.reduceat(r, first) / n, n, high])
    return out


def _design(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), np.log(f[:, 0] + 1e-3), f[:, 1], np.log1p(f[:, 2]), np.log1p(f[:, 3])])


def _logistic(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge; a class without rows gives a constant 0.5 or its side."""
    x = _design(f)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
    return w


def count_grams(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``(kind, v, w, n)``: counts of word pairs by label (0, 1) of the rows ``(id, y)`` in
    ``train``, and of the words of all documents (2). Words are 64-bit hashes."""
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    joined = texts.join(F.broadcast(train), texts["doc_id"] == train["id"], "left").select("text", "y")
    rows = joined.mapInArrow(_count_grams, "kind int, v bigint, w bigint, n bigint")
    return rows.groupBy("kind", "v", "w").agg(F.sum("n").alias("n"))


def model_of(grams: DataFrame) -> Model:
    """The model of both classes from the counts. What comes to the driver has a row for each
    word and each kept pair of the labelled sample, whatever the size of the corpus."""
    own, shared = grams.where("kind < 2"), grams.where("kind = 2").select(F.col("w").alias("key"), F.col("n").alias("shared"))

    def with_lost(df: DataFrame, n: str) -> DataFrame:
        few = {(r[0], r[1]): r[2] for r in df.where(F.col(n) <= 4).groupBy("kind", n).count().collect()}
        cuts = [discount([few.get((y, k), 0) for k in (1, 2, 3, 4)]) for y in (0, 1)]
        return df.withColumn("lost", lost(F.col(n), F.when(F.col("kind") == 0, cuts[0]).otherwise(cuts[1])))

    pairs = with_lost(own, "n")
    before = with_lost(own.groupBy("kind", F.col("w").alias("key")).agg(F.count("*").alias("n")), "n")
    ahead = pairs.groupBy("kind", F.col("v").alias("key")).agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    totals = {r["kind"]: r for r in before.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")).collect()}
    total, back = [totals[y]["n"] if y in totals else 1 for y in (0, 1)], [totals[y]["lost"] / totals[y]["n"] if y in totals else 1.0 for y in (0, 1)]
    of = lambda y, c: F.sum(F.when(F.col("kind") == y, c))
    kept = pairs.withColumn("kept", F.col("n") - F.col("lost")).where("kept > 0").join(ahead.select("kind", F.col("key").alias("v"), F.col("n").alias("follow")), ["kind", "v"])
    kept = kept.groupBy("v", "w").agg(*(F.coalesce(of(y, F.col("kept") / F.col("follow")), F.lit(0.0)).alias(f"more{y}") for y in (0, 1)))
    kept = materialize(kept, "tox-pairs")
    # Words that no count is left for, in either class and alone or in pairs, are like unseen ones.
    facts = before.select("key", "kind", ((F.col("n") - F.col("lost")) / F.when(F.col("kind") == 0, total[0]).otherwise(total[1])).alias("kept"), F.lit(None).cast("double").alias("rest"))
    facts = facts.unionByName(ahead.select("key", "kind", F.lit(None).cast("double").alias("kept"), (F.col("lost") / F.col("n")).alias("rest"))).where("kept > 0 or rest < 1")
    facts = facts.unionByName(kept.select(F.col("w").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("kept"), F.lit(None).cast("double").alias("rest")))
    fields = [F.coalesce(of(y, F.col(c)), F.lit(none)).alias(f"{c}{y}") for c, none in (("kept", 0.0), ("rest", 1.0)) for y in (0, 1)]
    words = facts.groupBy("key").agg(*fields).join(shared, "key", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return Model(words.toArrow(), kept.toArrow(), back, shared.agg(F.sum("shared")).first()[0] or 0)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast[Model], np.ndarray]:
    """The model and the curve's weights. Rows of fold 0 never give a label."""
    fold = fold_of(F.col("doc_id"))
    grams = materialize(count_grams(docs, _sample(docs, labels, PER_CLASS, fold.isin(1, 2, 3))), "tox-grams")
    sent = docs.sparkSession.sparkContext.broadcast(model_of(grams))
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    curve = _sample(docs, labels, PER_CLASS_CURVE, fold == 4)
    seen = texts.join(F.broadcast(curve), texts["doc_id"] == curve["id"]).select("text", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in units(batches, 0, UNIT_BYTES):
            f = _features(sent.value, part.column(0))
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(f[:, k]) for k in range(4))], names=["y", "a", "b", "c", "d"])

    got = seen.mapInArrow(measure, "y int, a double, b double, c double, d double").toArrow()
    f = np.column_stack([got.column(k).to_numpy() for k in (1, 2, 3, 4)])
    rates = labels.where("toxic in (0, 1)").where(fold == 4).agg(F.avg("toxic")).first()[0]
    y = got.column(0).to_numpy().astype(float)
    weights = _logistic(f, y)
    if rates and 0 < y.mean() < 1:
        weights[0] += math.log(rates / (1 - rates)) - math.log(y.mean() / (1 - y.mean()))
    return sent, weights


def score(docs: DataFrame, sent: Broadcast[Model], weights: np.ndarray) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, in the scan's partitions.

    Null and empty texts have no words and get the curve's value there; a null id isn't held
    out; repeated rows are scored alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in units(batches, 2, UNIT_BYTES):
            z = _design(_features(sent.value, part.column(2))) @ weights
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labels`` outside fold 0 and score all of ``docs``. Without labels of both
    kinds the models back off to the shared counts and every score is the curve's start."""
    return score(docs, *fit(docs, labels))
