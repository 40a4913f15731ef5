"""Token-id files (operator 1): encode, write sorted Parquet list columns, read selectively.

Documents are dealt out by ranges
of ``doc_id`` and sorted inside, so file order is ascending id order. A file holds

* ``doc_id``, ``n_tokens``, ``local_start`` with delta encoding, and ``ids`` as a
  dictionary-encoded list; row groups and pages are bounded by the options below, and page
  indexes let a reader skip pages by ``doc_id``;
* ``shard``, the number of its range, so that a reader needs no listing order.

Metadata can be read without touching the ids column and the other way round.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlink.llm.bpe import INNER_SPACE, SPACE
from bizlink.llm.common import n_tasks, units

#: Writer settings: row group and page sizes in bytes, rows a page; version 2 pages give the
#: delta encodings where no dictionary is used, and page indexes are always written.
FILE_OPTIONS = {
    "parquet.block.size": 32 << 20,
    "parquet.page.size": 256 << 10,
    "parquet.page.row.count.limit": 2_000,
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "snappy",
}
#: Marks a chunk that was cut before a line end; texts that hold it are encoded whole.
_LINE = "\x00"
#: A line end with no white space beside it is a pre-token of its own, so a cut before it is exact.
_LINE_END = f"([^{SPACE}])\n([^{SPACE}])"
#: Distinct chunks that a worker keeps at most, beside those of the texts at hand.
CACHE_CHUNKS = 1_000_000
#: Bytes of text that are encoded together.
UNIT_BYTES = 8 << 20
#: Chunks that the library gets as one text, a line end behind each.
JOINED = 64
#: A letter and marks behind it up to the end: the splitter always parts them, and the marks are one pre-token.
_MARKS = r"(\pL)([!-/:-@\[-`{-~]+)$"
_LOADED: dict[str, LibraryEncoder] = {}


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


class LibraryEncoder:
    """Whole texts through the tokenizers library, each distinct chunk once.

    Arrow cuts the texts of a unit before spaces and single line ends and numbers the distinct chunks; those that
    the cache lacks go to the library, many in one text with line ends between them, and the ids of every text are
    gathered from theirs. A chunk that ends in marks after a letter is the ids of both parts. Texts where a cut could fall inside a pre-token, or with a
    special token's string, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.whole = "|".join(filter(None, [INNER_SPACE, special, _LINE]))
        self.alone = "|".join(filter(None, ["^$", f"[{SPACE}]", special]))
        self.known, self.ids = pa.array([], pa.string()), _lists([])
        self.line_end = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, chunks: pa.Array) -> pa.ListArray:
        """Ids of each chunk with the space it was cut from, or without the line end.

        A line end between two chunks that hold no white space is a pre-token of its own, as the next one starts
        with a space or no white space at all; other chunks go to the library alone."""
        body = pa.compute.replace_substring_regex(chunks, f"^{_LINE}\n", "")
        text = pa.compute.if_else(pa.compute.starts_with(chunks, f"{_LINE}\n"), body, pa.compute.binary_join_element_wise("", body, " "))
        alone = pa.compute.match_substring_regex(body, self.alone).to_numpy(zero_copy_only=False)
        n = int((~alone).sum())
        groups = pa.ListArray.from_arrays(pa.array(np.r_[np.arange(0, n, JOINED), n].astype(np.int32)), text.filter(pa.array(~alone)))
        joined = self._ids([g + "\n" for g in pa.compute.binary_join(groups, "\n").to_pylist()])
        flat = np.concatenate([np.empty(0, np.int32), *joined])
        ends = np.flatnonzero(flat == self.line_end[0])
        if len(self.line_end) != 1 or len(ends) != n:
            return _lists(self._ids(text.to_pylist()))
        parted = pa.ListArray.from_arrays(pa.array(np.r_[0, ends - np.arange(n)].astype(np.int32)), pa.array(flat[flat != self.line_end[0]]))
        both = pa.concat_arrays([parted, _lists(self._ids(text.filter(pa.array(alone)).to_pylist()))])
        return both.take(pa.array(np.argsort(np.argsort(alone, kind="stable"))))

    def _chunks(self, chunks: pa.Array) -> pa.ListArray:
        """Ids of each chunk with the space or the line end that it was cut from."""
        base = pa.compute.replace_substring_regex(chunks, _MARKS, r"\1")
        cut = np.flatnonzero(pa.compute.binary_length(base).to_numpy() < pa.compute.binary_length(chunks).to_numpy())
        marks = pa.compute.replace_substring_regex(chunks.take(pa.array(cut)), f"(?s)^.*{_MARKS}", f"{_LINE}\n\\2")
        own = pa.concat_arrays([base, marks]).dictionary_encode()
        at = pa.compute.index_in(own.dictionary, value_set=self.known)
        unseen = own.dictionary.filter(at.is_null())
        known, ids = pa.concat_arrays([self.known, unseen]), pa.concat_arrays([self.ids, self._pieces(unseen)])
        place = at.fill_null(-1).to_numpy().copy()
        place[place < 0] = len(self.known) + np.arange(len(unseen))
        keep = len(known) <= CACHE_CHUNKS
        self.known, self.ids = (known, ids) if keep else (own.dictionary, ids.take(pa.array(place)))
        of_own = place[own.indices.to_numpy()]
        three = np.full((len(chunks), 3), len(ids) + 1)
        three[pa.compute.starts_with(base, f"{_LINE}\n").to_numpy(zero_copy_only=False), 0] = len(ids)
        three[:, 1] = of_own[: len(chunks)]
        three[cut, 2] = of_own[len(chunks) :]
        got = pa.concat_arrays([ids, _lists([self.line_end, self.line_end[:0]])]).take(pa.array(three.ravel()))
        return pa.ListArray.from_arrays(pa.array(got.offsets.to_numpy()[::3]), got.values)

    def encode(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """Ids of each text and the end id behind them."""
        whole = np.flatnonzero(pa.compute.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False))
        cut = pa.compute.split_pattern(pa.compute.replace_substring_regex(texts, _LINE_END, f"\\1 {_LINE}\n\\2"), " ")
        numbered = cut.flatten().dictionary_encode()
        place = numbered.indices.to_numpy().astype(np.int64)
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        chunks = self._chunks(numbered.dictionary)
        firsts = self._ids(numbered.dictionary.take(pa.array(place[at[:-1]])).to_pylist())
        end = len(chunks) + len(texts)
        place[at[:-1]] = len(chunks) + np.arange(len(texts))
        for row, own in zip(whole.tolist(), self._ids(texts.take(pa.array(whole)).to_pylist()), strict=True):
            place[at[row] + 1 : at[row + 1]] = end + 1
            firsts[row] = own
        ids = pa.concat_arrays([chunks, _lists([*firsts, np.array([end_id], np.int32), self.line_end[:0]])])
        got = ids.take(pa.array(np.insert(place, at[1:], end)))
        return pa.ListArray.from_arrays(pa.array(got.offsets.to_numpy()[at + np.arange(len(at))]), got.values)


def _library(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, options: dict | None = None) -> None:
    """Write the token files of ``docs`` to ``path``.

    Every document ends with ``end_id``. Null texts count as empty (only the end id); null
    ids come first, rows that share an id follow each other ordered by text; other columns
    are ignored; an empty table gives a folder with a schema only.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = _library(vocabulary), 0
        for part in units(batches, 2, UNIT_BYTES):
            ids = enc.encode(part.column(2).fill_null(""), end_id)
            n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            stop = at + np.cumsum(n)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(stop - n), pa.array(n), ids], schema=schema)
            at = int(stop[-1])

    ranged = (
        docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
        .repartitionByRange(n_tasks(docs), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", F.spark_partition_id().alias("shard"), "text")
    )
    out = ranged.mapInArrow(run, "doc_id bigint, shard int, local_start bigint, n_tokens bigint, ids array<int>")
    out.write.options(**{k: str(v) for k, v in {**FILE_OPTIONS, **(options or {})}.items()}).parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """``(doc_id, shard, local_start, n_tokens, ids)``; select what is needed, the rest isn't read."""
    return spark.read.schema("doc_id bigint, shard int, local_start bigint, n_tokens bigint, ids array<int>").parquet(path)


def token_index(spark, path: str) -> DataFrame:
    """``(doc_id, shard, start, n_tokens)`` from the metadata columns alone. ``start`` counts
    the ids of all documents before: a running sum over one row per shard, added to the sum
    inside the shard that each file holds."""
    files = read_token_files(spark, path)
    return files.select("doc_id", "shard", "local_start", "n_tokens").join(_before(files), "shard").select("doc_id", "shard", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens")


def _before(files: DataFrame) -> DataFrame:
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("before"))


def token_digests(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` computed from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(4)
            flat, cut = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([j - i for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    files = read_token_files(spark, path)
    each = files.mapInArrow(run, "doc_id bigint, shard int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return each.join(_before(files), "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
