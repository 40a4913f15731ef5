"""Conversation structure repair (operator 12).

Rows of a conversation are kept, reroled, deleted or preceded by empty rows until the role
initials read ``(s?(ua)+)?``. The cheapest edits are found by iterative-deepening A*: a depth
first search in ASCII order of the edits under a growing bound of cost, with a table of the
states that failed and the budget they failed with. Its lower bound is the cost in an automaton
that takes a lone system row for a turn answered; it is short of the truth only there.

A conversation may hold any share of all rows. Rows are therefore dealt out by range, and runs
of at most ``BLOCK`` rows of a conversation are searched apart, for every state they may be
entered and left in. An answer for a run always ends with one of its rows, so no answer is the
beginning of another, and the least of joined answers is made of least answers. What is left is
a pass over a conversation's runs in order that holds four states, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlink.llm.common import materialize, n_tasks, spread_join

BLOCK, BLOCK_CHARS = 128, 1 << 17
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after s, after u, after a. What may be kept where, and what comes next.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after an inserted or reroled row, whose role the state decides.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The lower bound's automaton has states 1 and 3 as one.
_MERGED = (0, 1, 2, 1)
_SPACES = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` damaged by crc32 of ``conv_id:turn``: of twenty rows one
    is dropped, one loses its text, one its ``.!?``, one comes twice, and one is the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _lower_bounds(rows: list[tuple[int, str]], goal: int | None) -> list[list[int]]:
    """For every row and merged state the cheapest way on in the merged automaton."""
    last = [_NEVER] * 3
    if goal is None:
        last = [0, 0, INSERT]
    else:
        last[_MERGED[goal]] = 0
    out = [last]
    for fault, initial in reversed(rows):
        after, more = out[-1], TRUNCATED if fault == 2 else 0
        own = [DELETE + after[c] for c in range(3)]
        if fault != 1:
            for c, q in ((0, 0), (1, 3), (2, 2)):
                own[c] = min(own[c], REROLE + more + after[_MERGED[_NEXT[q]]])
                if (q, initial) in _STEP:
                    own[c] = min(own[c], more + after[_MERGED[_STEP[q, initial]]])
        way = own.copy()
        for _ in range(2):  # at most two rows are worth inserting at one place
            way = [min(own[c], INSERT + way[2 if c < 2 else 1]) for c in range(3)]
        out.append(way)
    return out[::-1]


def cheapest_edits(rows: list[tuple[int, str]], entry: int = 0, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and initials of the cheapest edits of rows ``(fault, role initial)``, of equally
    cheap ones the least in ASCII; fault 1 must go, fault 2 is truncated. Without a ``goal`` the
    conversation ends well after the rows; with one the last edit is a row's and leads to that
    state, or None says that none does."""
    n = len(rows)
    if goal == 0 or (goal == 1 and entry == 1):
        return (DELETE * n, "D" * n) if goal == entry else None
    if goal == 1:  # one system row stays, the last of the cheapest
        kept = [((TRUNCATED if f == 2 else 0), -i) for i, (f, r) in enumerate(rows) if f != 1 and r == "s"] if entry == 0 else []
        if not kept:
            return None
        more, i = min(kept)
        return DELETE * (n - 1) + more, "D" * -i + "K" + "D" * (n - 1 + i)
    low = _lower_bounds(rows, goal)
    bound = low[0][_MERGED[entry]]
    while bound < _NEVER:
        failed: dict[tuple[int, int], int] = {}
        beyond = _NEVER
        stack, letters = [[0, entry, 0, 0]], []
        if n == 0 and (entry in (0, 3) if goal is None else entry == goal):
            return 0, ""
        while stack:
            top = stack[-1]
            i, q, spent, edit = top
            if edit == 4:
                failed[i, q] = max(failed.get((i, q), -1), bound - spent)
                stack.pop()
                if letters:
                    letters.pop()
                continue
            top[3] += 1
            fault, initial = rows[i] if i < n else (1, "")
            more = TRUNCATED if fault == 2 else 0
            if edit == 0 and i < n:
                child = (i + 1, q, spent + DELETE)
            elif edit == 1 and (i < n or goal is None):
                child = (i, _NEXT[q], spent + INSERT)
            elif edit == 2 and fault != 1 and (q, initial) in _STEP:
                child = (i + 1, _STEP[q, initial], spent + more)
            elif edit == 3 and fault != 1:
                child = (i + 1, _NEXT[q], spent + REROLE + more)
            else:
                continue
            j, p, cost = child
            least = cost + low[j][_MERGED[p]]
            if least > bound:
                beyond = min(beyond, least)
            elif j == n and (p in (0, 3) if goal is None else p == goal):
                return cost, "".join(letters) + "DIKR"[edit]
            elif failed.get((j, p), -1) < bound - cost:
                stack.append([j, p, cost, 0])
                letters.append("DIKR"[edit])
        bound = beyond
    return None


def repaired_lines(edits: str, roles: list[str], texts: list[str], state: int) -> list[str]:
    """``role:text`` of the rows that the edits leave, entered in ``state``."""
    out, at = [], 0
    for e in edits:
        if e in "IR":
            out.append(f"{_ROLE[state]}:{texts[at] if e == 'R' else ''}")
            state = _NEXT[state]
        elif e == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = _STEP[state, roles[at][:1]]
        at += e != "I"
    return out


_RUN = pa.schema([
    ("ck", pa.string()), ("seq", pa.int64()), ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())),
    ("whole", pa.bool_()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
_RUN_DDL = "ck string, seq bigint, counts array<bigint>, turns array<bigint>, ends array<string>, whole boolean, costs array<bigint>, edits array<string>, roles array<string>, texts array<string>"


def _run(ck: str, seq: int, rows: list[tuple], alone: bool) -> tuple:
    """One run of a conversation: its counts and turns, and its answers by entry and exit."""
    faults = [(1 if r[3] in ("blank", "duplicate") else 2 if r[3] == "truncated" else 0, r[1][:1]) for r in rows]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
    counts = [sum(r[3] == what for r in rows) for what in ("blank", "duplicate", "truncated")] + [illegal]
    turns = [r[0] for r in rows]
    known = [t for t in turns if t is not None]
    if alone:
        found = [cheapest_edits(faults)]
    else:
        found = [cheapest_edits(faults, entry, goal) for entry in range(4) for goal in range(4)]
    return (
        ck, seq, counts, [min(known, default=None), max(known, default=None), len(set(known)), turns[0], turns[-1]], [initials[0], initials[-1]],
        alone, [f[0] if f else None for f in found], [f[1] if f else None for f in found], [r[1] for r in rows], [r[2] for r in rows],
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _runs(block: int):
    """Sorted rows and marks to runs. The first and the last conversation of a task may go on
    in its neighbours, so they are never taken for whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, out, size = TaskContext.get().partitionId() << 32, 0, [], 0
        held, chars, key, first, cut, mark, before = [], 0, None, True, False, None, None

        def close(last: bool) -> None:
            nonlocal made, held, chars, cut, first
            if held:
                out.append(_run(key, base + made, held, not (first or cut or last)))
                made += 1
            held, chars = [], 0

        for batch in batches:
            for ck, turn, role, digest, kind, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ck != key:
                    if key is not None:
                        close(False)
                        first = False
                    key, cut, mark, before = ck, False, None, None
                place = (turn, role, digest)
                if kind == 0:
                    mark = place
                    continue
                if fault != "blank" and (place in (mark, before)):
                    fault = "duplicate"
                if len(held) >= block or chars > BLOCK_CHARS:
                    cut = True
                    close(False)
                held.append((turn, role, text, fault))
                before, chars = place, chars + len(text)
                size += len(text)
                if size > 1 << 23 and out:
                    yield _batch(out, _RUN)
                    out, size = [], 0
        close(True)
        if out:
            yield _batch(out, _RUN)

    return run


class _Chain:
    """The runs of one conversation so far: for every state it may be in the least cost, the
    order of its edits among the states', the edits as a linked list, and the digest."""

    def __init__(self) -> None:
        self.counts, self.turns, self.tail = [0] * 4, [None, None, 0, None], None
        self.ways = {0: (0, 0, None, hashlib.sha256())}

    def add(self, counts: list[int], turns: list[int | None], ends: list[str], whole: bool, costs: list, edits: list, roles: list, texts: list) -> None:
        joint = self.tail is not None and self.tail + ends[0] not in ("su", "ua", "au")
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.counts[3] += joint
        low, high, several, start, end = turns
        again = start is not None and start == self.turns[3]
        known = [t for t in (self.turns[0], self.turns[1], low, high) if t is not None]
        self.turns = [min(known, default=None), max(known, default=None), self.turns[2] + several - again, end]
        self.tail = ends[1]
        if whole:
            digest = hashlib.sha256("\n".join(repaired_lines(edits[0], roles, texts, 0)).encode())
            self.ways = {3: (costs[0], 0, (None, edits[0]), digest)}
            return
        best: dict[int, tuple] = {}
        for q, (cost, rank, _, _) in self.ways.items():
            for p in range(4):
                if costs[4 * q + p] is not None:
                    best[p] = min(best.get(p, (_NEVER,)), (cost + costs[4 * q + p], rank, edits[4 * q + p], q))
        ranks = {key: i for i, key in enumerate(sorted((b[1], b[2]) for b in best.values()))}
        ways = {}
        for p, (cost, rank, letters, q) in best.items():
            digest = self.ways[q][3].copy()
            lines = repaired_lines(letters, roles, texts, q)
            if lines:
                digest.update((("\n" if q else "") + "\n".join(lines)).encode())
            ways[p] = (cost, ranks[rank, letters], (self.ways[q][2], letters), digest)
        self.ways = ways

    def result(self) -> tuple:
        ends = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
        cost, _, tail, q = min((way[0] + ends[q][0], way[1], ends[q][1], q) for q, way in self.ways.items())
        _, _, node, digest = self.ways[q]
        if tail:
            digest.update(("\nuser:" * (q == 1) + "\nassistant:").encode())
        parts = [tail]
        while node is not None:
            node, letters = node
            parts.append(letters)
        low, high, several, _ = self.turns
        gaps = 0 if low is None else high - low + 1 - several
        return (gaps if gaps < 1 << 63 else None, *self.counts, cost, "".join(reversed(parts)), digest.hexdigest())


_RESULT = "ck string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_RESULT_ARROW = pa.schema([("ck", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, chain, out = None, None, []
    for batch in batches:
        for ck, _, *run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ck != key:
                if chain:
                    out.append((key, *chain.result()))
                key, chain = ck, _Chain()
            chain.add(*run)
        if out:
            yield _batch(out, _RESULT_ARROW)
            out = []
    if chain:
        yield _batch([(key, *chain.result())], _RESULT_ARROW)


def _key(conv_id: str | Column) -> Column:
    """A null id has a key of its own."""
    text = F.col(conv_id).cast("string")
    return F.when(text.isNull(), "").otherwise(F.concat(F.lit("="), text))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Diagnosis and cheapest repair of every conversation of ``(conv_id, turn, role, text)``.

    Returns ``(ck, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``
    with ``ck`` the key of the id. Rows go by turn, nulls first, those of one turn by role and
    then by digest of the text; nulls of role and text are one space. Rows without an id are one
    conversation. ``gaps`` is null beyond the range of a long. Other columns are ignored.
    """
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    bare = F.rtrim(text, F.lit(_SPACES))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    keyed = rows.select(_key("conv_id").alias("ck"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), F.lit(1).alias("kind"), text.alias("text"), fault.alias("fault"))
    # Only rows whose role and text come more than once in a conversation can be repeats.
    said = keyed.select("ck", "turn", "role", "digest")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn"))
    again = materialize(said.groupBy("ck", "role", "digest").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1"), "said")
    marks = spread_join(said, again.drop("n"), ["ck", "role", "digest"], again.select("ck", "role", "digest", "n"), ["turn"])
    marks = marks.where(F.struct(F.col("turn").isNotNull().alias("has"), "turn") > F.col("first")).select("ck", "turn", "role", "digest").distinct()
    marks = marks.select("*", F.lit(0).alias("kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("fault"))
    order = ["ck", "turn", "role", "digest"]
    dealt = keyed.unionByName(marks).repartitionByRange(n_tasks(rows), *order).sortWithinPartitions(*order, "kind")
    runs = dealt.mapInArrow(_runs(block), _RUN_DDL)
    return runs.repartition(n_tasks(rows), "ck").sortWithinPartitions("ck", "seq").mapInArrow(_chains, _RESULT)


def repair_conversations(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`repair` of the damaged table, a row for every original ``conv_id``: one that has
    lost all rows has zeros, an empty audit and the digest of an empty text."""
    found = repair(damage(conversations), block)
    every = conversations.select(_key("conv_id").alias("ck"), "conv_id").distinct()
    out = every.join(found, "ck", "left").drop("ck")
    zeros = {c: 0 for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    lost = F.col("audit").isNull()
    out = out.withColumn("gaps", F.when(lost, 0).otherwise(F.col("gaps"))).withColumn("repaired_sha256", F.when(lost, hashlib.sha256().hexdigest()).otherwise(F.col("repaired_sha256")))
    return out.fillna(zeros | {"audit": ""})
