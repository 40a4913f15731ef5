"""Byte-level BPE by backtracking over longest token matches (operator 3).

A text is cut into pre-tokens as the vocabulary file's splitter does; each distinct
pre-token is encoded once per worker. Inside a pre-token an Aho-Corasick automaton gives
the longest vocabulary token that starts at every byte. The encoder walks left to right,
takes the longest token, and accepts it only if the pair (last token, this token) is
compatible, that is if BPE run on the joined bytes of the pair would leave exactly these
two tokens. A sequence whose neighbours are all compatible is the BPE result, so the merges
are never replayed. When no prefix of a match is compatible the position is marked dead and
the last token is taken back; every position dies at most once, so the time is linear.

Decoding gathers bytes through an offset table: one blob with all token bytes and the
offset of each token in it.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as Unicode's White_Space property has it (fixed value).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public byte-level splitter (fixed value), with white space written out.
_SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A space with white space on both sides, or before it and nothing behind it: there a cut
#: before the space would fall inside a pre-token.
INNER_SPACE = rf"[{SPACE}] (?:[{SPACE}]|$)"
_INNER_SPACE = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")
#: Entries of one generation of a worker's cache: bounds its memory, results don't depend on it.
CACHE_ENTRIES = 250_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Filling(dict):
    """A dictionary that computes what it lacks. A full one becomes the older of two
    generations, and what is used again moves to the younger, so frequent keys stay."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """Encodes whole texts from the ids of their pre-tokens.

    ``of_piece`` gives the ids of one pre-token as little-endian 32-bit bytes. A text is
    first cut before spaces, which is exact unless a space lies inside a run of white space
    (such texts take the splitter as a whole); each chunk's ids are then looked up.
    """

    def __init__(self, of_piece: Callable[[str], bytes], special: dict[str, bytes]):
        self.piece = Filling(of_piece)
        self.chunk = Filling(lambda c: self._split(" " + c))
        self.special = special
        self._cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, _SPLIT.findall(text)))

    def _plain(self, text: str) -> bytes:
        if _INNER_SPACE.search(text):
            return self._split(text)
        first, *rest = text.split(" ")
        return self._split(first) + b"".join(map(self.chunk.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if self._cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self._cut.split(text)
        return b"".join(self.special[p] if k % 2 else self._plain(p) for k, p in enumerate(parts))


class Bpe:
    """The tables of one vocabulary file: matches, pair compatibility, prefixes, offsets."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.to_chars = dict(enumerate(alphabet))
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.rank = [-1] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((x, y), r)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.length = [0] * size
        self.prefix = [-1] * size
        raw = [b""] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            raw[i] = bytes(to_byte[c] for c in token)
            self.length[i] = len(token)
            self.automaton.add_word(token, i)
            self.prefix[i] = next((vocab[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in vocab), -1)
        self.automaton.make_automaton()
        for t in spec["added_tokens"]:
            raw[t["id"]] = t["content"].encode()
        self.special = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in spec["added_tokens"]}
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int32)
        self.table = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(raw))])
        self.fits: dict[tuple[int, int], bool] = Filling(self._compatible)
        self.encoder = PieceEncoder(self.encode_piece, self.special)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether BPE leaves the two tokens apart.

        Both tokens are taken apart from their last merge backwards. At each step the pair at
        the border existed until the undone merge; a merge across the border that comes
        before that one would have won. Equal ranks go to the left place first.
        """
        a, b = pair
        before = len(self.pair)
        while True:
            if self.pair.get((a, b), before) < before:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, self.right[a]
            else:
                before, b = rb + 1, self.left[b]

    def encode_piece(self, piece: str) -> bytes:
        chars = piece.encode().decode("latin-1").translate(self.to_chars)
        n, length, fits, prefix = len(chars), self.length, self.fits, self.prefix
        longest = [-1] * n
        for end, i in self.automaton.iter(chars):
            start = end + 1 - length[i]
            if longest[start] < 0 or length[i] > length[longest[start]]:
                longest[start] = i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not dead[end] and (not out or fits[out[-1], token]):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif prefix[token] >= 0:
                token = prefix[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encoder.encode(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the ids, special tokens included: one gather from the offset table."""
        if not len(ids):
            return b""
        got = self.table.take(pa.array(ids))
        at = np.frombuffer(got.buffers()[1], np.int32)
        return got.buffers()[2][at[got.offset] : at[got.offset + len(got)]].to_pybytes()


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tables of a file, built once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)`` for every row of ``docs``.

    No shuffle: rows stay in the partitions of the scan. A null text counts as empty (no
    ids, empty decoded text); rows with null or repeated ``doc_id`` each give a row; other
    columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for doc_id, texts in _slices(batches):
            ids = [np.frombuffer(bpe.encode(t or ""), "<u4").astype(np.int32) for t in texts]
            back = [bpe.decode(i).decode("utf-8", "replace") for i in ids]
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield pa.record_batch([doc_id, pa.ListArray.from_arrays(at, pa.array(flat)), pa.array(back, pa.string())], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: the same pass, digests only, so
    that no ids leave the worker. Nulls and repeated rows as in :func:`encode_documents`."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for doc_id, texts in _slices(batches):
            n, a, b = [], [], []
            for t in texts:
                ids = bpe.encode(t or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                back = bpe.decode(np.frombuffer(ids, "<u4"))
                b.append(hashlib.sha256(back).hexdigest())
            yield pa.record_batch([doc_id, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).to_pylist()
