"""Quality rules from repetition inside a document (operator 2).

Words are the symbols of a suffix array. Many documents share one array: a symbol is the
pair (document, word), so no match crosses documents. Prefix doubling orders the suffixes,
refining only groups that are still tied and keeping the ranks of every level; the longest
common prefix of neighbours is then read off those levels from the longest down. A suffix's
deepest longest-common-prefix interval has the larger of its two neighbour values as depth,
and that prefix is a maximal repeat starting there. The spans of all repeats of at least
``min_repeat`` words are united. A document is rejected when the union covers more than
``max_covered`` of its words or one repeat is longer than ``max_longest`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base rules of the contract (fixed values).
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Words that one suffix array holds, give or take one document.
ARRAY_WORDS = 200_000
COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, covered_words bigint, longest_repeat bigint, kept boolean"


def deepest_repeat(symbols: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each position the length of the longest repeat that starts there.

    ``symbols`` of documents one after the other, equal only within one document; ``stops``
    is the end of its document for each position.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    head = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = head
    levels, step = [rank], 1
    tied = order[np.r_[s[1:] == s[:-1], False] | np.r_[False, s[1:] == s[:-1]]]
    first = tied
    while len(tied):
        after = np.where(tied + step < stops[tied], rank[np.minimum(tied + step, n - 1)].astype(np.int64) + 1, 0)
        key = rank[tied].astype(np.int64) * (n + 1) + after
        o = np.argsort(key, kind="stable")
        tied, key = tied[o], key[o]
        group, idx = rank[tied], np.arange(len(tied))
        group_at = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], idx, 0))
        same = key[1:] == key[:-1]
        sub_at = np.maximum.accumulate(np.where(np.r_[True, ~same], idx, 0))
        rank = rank.copy()
        rank[tied] = group + (sub_at - group_at).astype(np.int32)
        levels.append(rank)
        step *= 2
        tied = tied[np.r_[same, False] | np.r_[False, same]]
    out = np.zeros(n, np.int64)
    if len(first):
        a = first[np.argsort(rank[first], kind="stable")]
        a, b = a[:-1], a[1:]
        near = levels[0][a] == levels[0][b]
        a, b = a[near], b[near]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + common, b + common
            inside = (x < stops[a]) & (y < stops[b])
            equal = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
            common += equal * (1 << k)
        np.maximum.at(out, a, common)
        np.maximum.at(out, b, common)
    return out


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str], min_repeat: int) -> np.ndarray:
    """Rows of (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered, longest)."""
    out = np.zeros((len(texts), 7), np.int64)
    words: list[bytes] = []
    for k, text in enumerate(texts):
        raw = text.encode()
        own = raw.split()
        words += own
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        blank = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
        out[k, :4] = len(own), len(text) - blank, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))
    n = len(words)
    if n:
        ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        ends = np.cumsum(out[:, 0])
        doc = np.repeat(np.arange(len(texts)), out[:, 0])
        depth = deepest_repeat(doc * (int(ids.max()) + 1) + ids, ends[doc])
        of_doc = lambda flags: np.bincount(doc[flags], minlength=len(texts))
        at = np.flatnonzero(depth >= WINDOW)
        out[:, 4] = of_doc(_covered(at, np.full(len(at), WINDOW), n))
        at = np.flatnonzero(depth >= min_repeat)
        out[:, 5] = of_doc(_covered(at, depth[at], n))
        np.maximum.at(out[:, 6], doc, depth)
    return out


def repetition(docs: DataFrame, min_repeat: int = 10, max_covered: float = 0.2, max_longest: int = 100, only_kept: bool = False) -> DataFrame:
    """The columns of ``docs`` with the measures of ``COLUMNS`` after them.

    One pass in the partitions of the scan, no shuffle. A null text has no words and so fails
    the base rules, as does an empty one; repeated rows are judged alike; other columns pass
    through, and one that bears the name of a measure gives way to the measure. With
    ``only_kept`` the result is the kept rows in their own columns.
    """
    names = {c.split()[0] for c in COLUMNS.split(", ")}
    own = [c for c in docs.columns if only_kept or c not in names]
    fields = [docs.schema[c] for c in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)) // 6
            lo = 0
            while lo < batch.num_rows:
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo : lo + 2000]), ARRAY_WORDS)))
                part = batch.slice(lo, hi - lo)
                m = measure([t or "" for t in part.column("text").to_pylist()], min_repeat)
                failed = (m[:, 0] < MIN_WORDS) | (100 * m[:, 4] > MAX_REPEAT_PERCENT * m[:, 0])
                kept = ~failed & (m[:, 5] <= max_covered * m[:, 0]) & (m[:, 6] <= max_longest)
                if only_kept:
                    yield part.filter(pa.array(kept))
                else:
                    more = [*(pa.array(m[:, k]) for k in range(5)), pa.array(failed), pa.array(m[:, 5]), pa.array(m[:, 6]), pa.array(kept)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*own, *(c.split()[0] for c in COLUMNS.split(", "))])
                lo = hi

    return docs.select(*(F.col(f"`{c}`") for c in own)).mapInArrow(run, schema if only_kept else f"{schema}, {COLUMNS}")
