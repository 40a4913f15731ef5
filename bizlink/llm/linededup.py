"""Line dedup by winnowing over line hashes (operator 4).

The lines of a document that hold a word are its sequence. In each window of ``run`` lines
the smallest line hash (the last of equal ones) is the window's fingerprint, so any two equal
windows choose the same line of themselves. With ``words`` shorter windows of that many words
or more are windows too, with fingerprints of their own for each number of lines, so that a
match counts that has either enough lines or enough words.

Texts are read once for 128-bit hashes of their lines, a small table from which the rest follows:

1. one row per selected position: document, line, fingerprint, and the windows that chose it.
   Positions whose fingerprint occurs once in the corpus are dropped; a match can't contain them;
2. the others are joined by fingerprint and window with the first position (by doc_id, then
   line) that has both. A later one is a seed of a match between two documents;
3. seeds of the same two documents and shift are extended both ways: each window that follows
   or precedes on the same shift is a seed too until the texts differ, so the match at its full
   length is the seeds joined end to end, and no lines are fetched or compared again;
4. the later side of each match is deleted when the texts are read again.

A frequent line or passage costs one row per position in partial counts, and its positions
are spread over tasks in the joins; no position is ever paired with any but the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlink.llm.common import fresh, materialize, spread_join

RUN = 3
#: Words that make a match of fewer lines count.
WORDS = 50
#: Bytes of a line's hash.
WIDTH = 16
DOC = ["doc_id", "th"]


def _has_word(line: str) -> bool:
    return bool(line) and not line.encode().isspace()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, hashes of its lines with a word, words in each)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            kept = [[x.encode() for x in (t or "").split("\n") if _has_word(x)] for t in part.column(2).to_pylist()]
            hashes = pa.array([b"".join(map(xxhash.xxh3_128_digest, ls)) for ls in kept], pa.binary())
            words = pa.array([[len(x.split()) for x in ls] for ls in kept], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), hashes, words], names=[*DOC, "lines", "words"])


def line_hashes(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, lines, words)`` of ``(doc_id, th, text)``, written."""
    return materialize(docs.mapInArrow(_hash_lines, "doc_id bigint, th bigint, lines binary, words array<int>"), "lines")


def winnow(lines: bytes, words: list[int], run: int, enough: int | None = None) -> list[tuple[int, int, list[tuple[bytes, int, int]]]]:
    """(fingerprint, its line, windows that chose it as (content hash, first line, lines))."""
    n = len(lines) // WIDTH
    order = np.frombuffer(lines, "<u8")[::2].tolist()
    before = np.cumsum([0, *words]).tolist()
    out: list[tuple[int, int, list]] = []
    for size in range(1 if enough else run, run + 1):
        chosen_at = -1
        for i in range(n - size + 1):
            if size < run and before[i + size] - before[i] < enough:
                continue
            at = min(range(i, i + size), key=lambda k: (order[k], -k))
            if at != chosen_at:
                out.append((order[at] ^ size, at, []))
                chosen_at = at
            out[-1][2].append((xxhash.xxh3_128_digest(lines[WIDTH * i : WIDTH * (i + size)], size), i, size))
    return out


def fingerprints(hashed: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """``(doc_id, th, fp, at, windows)``: the selected positions with the windows that chose them."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(a, b, run, words) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            flat = [x for f in found for x in f]
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x[2]) for x in flat])]).astype(np.int32))
            inner = [pa.array([w[k] for x in flat for w in x[2]], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int32()))]
            windows = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(inner, ["content", "line", "size"]))
            fp = pa.array(np.array([x[0] for x in flat], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), fp, pa.array([x[1] for x in flat], pa.int32()), windows], names=[*DOC, "fp", "at", "windows"])

    return hashed.mapInArrow(one, "doc_id bigint, th bigint, fp bigint, at int, windows array<struct<content: binary, line: int, size: int>>")


def seeds(hashed: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """``(doc_id, th, first_id, first_th, shift, windows)``: later windows (line, size) by the
    document that has them first and by how many lines later they stand."""
    positions = fingerprints(hashed, run, words)
    twice = materialize(positions.groupBy("fp").agg(F.count("*").alias("n"), F.sum(F.size("windows")).alias("w")).where("w > 1"), "line-fps")
    left = spread_join(positions, twice.select("fp"), ["fp"], twice.select("fp", "n"), ["doc_id", "th", "at"], "left_semi")
    windows = materialize(left.select(*DOC, "fp", F.inline("windows")), "line-windows")
    place = F.struct(*DOC, "line")
    first = materialize(windows.groupBy("fp", "content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-first")
    later = spread_join(windows, first.drop("n"), ["fp", "content"], first, ["doc_id", "th", "line"]).where(place > F.col("first"))
    found = later.select(*DOC, F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"), (F.col("line") - F.col("first.line")).alias("shift"), F.struct("line", "size").alias("window"))
    return found.groupBy(*DOC, "first_id", "first_th", "shift").agg(F.collect_list("window").alias("windows"))


def extended(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first line, lines) of the matches at full length from seeds (line, size) on one shift."""
    out: list[tuple[int, int]] = []
    for line, size in sorted(windows):
        if out and line <= out[-1][0] + out[-1][1]:
            start, had = out.pop()
            out.append((start, max(had, line + size - start)))
        else:
            out.append((line, size))
    return out


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extended([(w["line"], w["size"]) for w in ws]) for ws in batch.column("windows").to_pylist()]
        take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
        flat = [x for f in found for x in f]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1))], names=[*DOC, "line", "size"])


def repeated_runs(docs: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """``(doc_id, th, runs)`` of ``(doc_id, th, text)``: the runs that occurred earlier."""
    matches = seeds(line_hashes(docs), run, words)
    found = matches.select(*DOC, "windows").mapInArrow(_extend, "doc_id bigint, th bigint, line int, size int")
    return found.groupBy(*DOC).agg(F.collect_set(F.struct("line", "size")).alias("runs"))


def _delete(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """The text without the runs, its lines with a word, and how many went."""
    gone = {k for w in runs for k in range(w["line"], w["line"] + w["size"])}
    if not gone:
        return text, sum(map(_has_word, text.split("\n"))), 0
    out, n, held = [], 0, []
    after_gone = True
    for line in text.split("\n"):
        if not _has_word(line):
            held.append(line)
            continue
        if n in gone:
            if not after_gone:
                out += held
            held, after_gone = [], True
        else:
            out += [*held, line]
            held, after_gone = [], False
        n += 1
    if not after_gone:
        out += held
    return "\n".join(out), n, len(gone)


def dedup_lines(docs: DataFrame, run: int = RUN, words: int | None = WORDS, counts: bool = False) -> DataFrame:
    """``docs`` with later repeated runs of at least ``run`` lines, or (unless ``words`` is None)
    of at least that many words, deleted from ``text``.

    Order is doc_id (nulls first), for equal ids the text's hash, then the line. Blank lines
    between two deleted lines go with them, and a text of deleted lines only becomes empty.
    Null texts stay null; texts too short for a run stay as they are; rows that
    repeat both id and text count as one document and stay alike; an empty table stays empty.
    Other columns pass through (``n_chars``, if there, keeps its value). With ``counts`` the
    columns ``n_lines`` and ``n_deleted`` are added, and columns of these names give way.
    """
    more = ["n_lines", "n_deleted"] if counts else []
    columns = [c for c in docs.columns if c not in more]
    th, found_id, found_th, runs = (fresh(docs, c) for c in ("__th", "__id", "__found", "__runs"))
    keyed = docs.select(*(F.col(f"`{c}`") for c in columns), F.xxhash64("text").alias(th))
    found = repeated_runs(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(th).alias("th"), "text"), run, words)
    found = found.select(F.col("doc_id").alias(found_id), F.col("th").alias(found_th), F.col("runs").alias(runs))
    both = keyed.join(found, keyed["doc_id"].eqNullSafe(found[found_id]) & (keyed[th] == found[found_th]), "left").drop(found_id, found_th, th)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"{c} bigint" for c in more)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column("text").to_pylist(), batch.column(runs).to_pylist()
            done = [(None, 0, 0) if t is None else _delete(t, w or []) if w or counts else (t, 0, 0) for t, w in zip(texts, gone, strict=True)]
            new = pa.array([d[0] for d in done], pa.string())
            cols = [new if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([d[k] for d in done], pa.int64()) for k, _ in enumerate(more, 1))], names=[*columns, *more])

    return both.mapInArrow(apply, schema)
