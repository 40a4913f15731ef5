"""Operators 11 and 13 against numpy, 12 against a plain dynamic programme."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from bizlink.llm import dialogue, vecgraph, whitening

VECTORS = "vec_id long, embedding array<float>, n int, x string, node long, w double"


def rows_of(vectors, rng):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 5, 0.5) for i, v in enumerate(vectors)] + [(None, [float(c) for c in rng.normal(size=len(vectors[0]))], None, None, None, None)]


@pytest.fixture(scope="module")
def cloud():
    """Random vectors, groups of near copies of several sizes, exact copies, and unusable ones."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 24))
    near = [c + rng.normal(size=(k, 24)) * 0.02 for c, k in zip(base[:6], (2, 3, 10, 40, 90, 5), strict=True)]
    far = [c + rng.normal(size=(6, 24)) * 0.25 for c in base[6:10]]
    copies = [np.repeat(base[11:12], 60, axis=0), base[12:13] * 3.5, base[12:13] * -1]
    vectors = list(np.concatenate([base, *near, *far, *copies]).astype(np.float32))
    return rows_of([*vectors, None, [0.0] * 24, [float("nan"), *[1.0] * 23], [float("inf"), *[1.0] * 23], [None, *[1.0] * 23]], rng)


def linked(rows):
    """Links and components by brute force."""
    good = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    out = {r[0]: (0, r[0]) for r in rows}
    for d in {len(r[1]) for r in good}:
        own = [r for r in good if len(r[1]) == d]
        x = np.array([r[1] for r in own], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        hit = x @ x.T >= 0.95
        label = np.array([10**9 if r[0] is None else r[0] for r in own])
        while True:
            low = np.where(hit, label[None, :], 10**9).min(axis=1)
            if (low == label).all():
                break
            label = low
        out |= {r[0]: (int(h.sum()) - 1, None if c == 10**9 else int(c)) for r, h, c in zip(own, hit, label, strict=True)}
    return out


def test_op11_against_brute_force(spark, cloud):
    rows = [*cloud, (1000, [1.0, 2.0], 0, "", 0, 0.0), (1001, [2.0, 4.0], 0, "", 0, 0.0), (1002, [], 0, "", 0, 0.0)]
    got = vecgraph.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want = linked(rows)
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("cloud_rows", [[], [(1, None, 0, "", 0, 0.0)], [(4, [1.0, 0.0], 0, "", 0, 0.0)], [(4, [1.0, 0.0], 0, "", 0, 0.0), (4, [1.0, 0.0], 0, "", 0, 0.0), (2, [3e38, 1e38], 0, "", 0, 0.0), (3, [1e-38, 0.0], 0, "", 0, 0.0)]])
def test_op11_few_rows(spark, cloud_rows):
    got = vecgraph.near_duplicates(spark.createDataFrame(cloud_rows, VECTORS)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted((r[0], *linked(cloud_rows)[r[0]]) if len(cloud_rows) < 4 else {4: (4, 2, 3), 2: (2, 0, 2), 3: (3, 2, 3)}[r[0]] for r in cloud_rows)


def test_op11_goes_on_to_other_shards(spark, monkeypatch):
    """Many small shards and no border at first: hits lie across, and the audit widens borders."""
    rng = np.random.default_rng(5)
    vectors = np.concatenate([c + rng.normal(size=(30, 8)) * 0.25 for c in rng.normal(size=(12, 8))])
    rows = [(i, [float(c) for c in v], 0, "", 0, 0.0) for i, v in enumerate(vectors.astype(np.float32))]
    monkeypatch.setattr(vecgraph, "SHARD", 20)
    done = vecgraph.link(spark.createDataFrame(rows, VECTORS).select("vec_id", "embedding"), margin=0.02)
    want = linked(rows)
    found = {r["vec_id"]: r["hits"] or 0 for r in done.classes.join(done.counts, "node", "left").collect()}
    assert done.recall >= 0.98
    assert all(found[i] <= want[i][0] for i in want)
    assert sum(found.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_op11_graph_is_pruned_and_reachable():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 16)), rng.normal(size=16) + rng.normal(size=(200, 16)) * 0.05])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = vecgraph.build_graph(x)
    assert lists.shape[1] <= vecgraph.DEGREE + 8
    seen, queue = set(), [int(e) for e in vecgraph._entries(x)]
    while queue:
        at = queue.pop()
        if at not in seen:
            seen.add(at)
            queue += [int(v) for v in lists[at] if v >= 0]
    assert len(seen) >= 495
    met = vecgraph.range_search(x, [[] for _ in x], x, lists, 0.95)
    want = x @ x.T >= 0.95
    assert not (met & ~(x @ x.T >= 0.95 - 1e-5)).any()
    assert (met & want).sum() >= 0.97 * want.sum()


def test_op13_as_numpy(spark, cloud):
    rows = [*cloud, (7, cloud[7][1], 0, "", 0, 0.0)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    kept = [r for r in rows if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all()]
    x = np.floor(256 * np.array([r[1] for r in kept], np.float32).astype(float))
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    order = np.argsort(-values)[:4]
    white = np.abs((x - s / n) @ axes[:, order] / np.sqrt(values[order]))
    want = sorted((-1 if r[0] is None else r[0], k + 1, int(((n * v - s) ** 2).sum()), round(w[k], 7)) for r, v, w in zip(kept, x, white, strict=True) for k in range(4))
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 7)) for r in got) == want
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    assert {r["component"]: round(r["explained"], 9) for r in got} == {k + 1: round(values[c] / values.sum(), 9) for k, c in enumerate(order)}


def test_op13_weights_by_rows(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 2.0], [3.0, 1.0]])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), by_rows=True).collect()
    x = np.array([v for _, v in rows]) * 256
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert {r["n"] for r in got} == {4} and max(r["identity_error"] for r in got) < 1e-9
    assert {r["component"]: round(r["explained"], 9) for r in got} == {1: round(values[0] / values.sum(), 9), 2: round(values[1] / values.sum(), 9)}


def test_op13_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, 0.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, [float("inf"), 1.0])], schema)).collect()
    assert {(r["vec_id"], r["component"]) for r in line} == {(i, c) for i in (1, 2, 3) for c in (1, 2)}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e15]), (2, [-1e15]), (3, [1e15 + 1])], schema)).collect()
    assert all(r["deviation"] is None for r in huge) and max(r["identity_error"] for r in huge) < 1e-4
    offset = whitening.whiten(spark.createDataFrame([(i, [1e13 + i, float(i % 3)]) for i in range(50)], schema)).collect()
    near = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(50)], schema)).collect()
    assert [round(abs(r["whitened"]), 6) for r in sorted(offset)] == [round(abs(r["whitened"]), 6) for r in sorted(near)]


STEP, NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, [2, 2, 3, 2]


def options(rows, i, q):
    if i < len(rows):
        yield 2, i + 1, q, "D"
    yield 5, i, NEXT[q], "I"
    if i < len(rows) and rows[i][0] != 1:
        more = 5 if rows[i][0] == 2 else 0
        if (q, rows[i][1]) in STEP:
            yield more, i + 1, STEP[q, rows[i][1]], "K"
        yield 1 + more, i + 1, NEXT[q], "R"


def plain_edits(rows):
    """Cheapest edits, of equally cheap ones the least, from costs filled in backwards."""
    n = len(rows)
    cost = [[10**9] * 4 for _ in range(n + 1)]
    cost[n][0] = cost[n][3] = 0
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in range(4):
                cost[i][q] = min([cost[i][q], *(c + cost[j][p] for c, j, p, _ in options(rows, i, q))])
    i = q = 0
    out = ""
    while not (i == n and q in (0, 3)):
        i, q, e = next((j, p, e) for c, j, p, e in options(rows, i, q) if c + cost[j][p] == cost[i][q])
        out += e
    return cost[0][0], out


def plain_repair(table):
    convs = {}
    for c, t, r, x, *_ in table:
        own = convs.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub(r"[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.sha256(v[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", x)
            faults.append("b" if not marks else "d" if (r, x) in seen else "t" if marks[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, *_ in own if t is not None]
        cost, audit = plain_edits([({"": 0, "t": 2}.get(f, 1), v[1][:1]) for f, v in zip(faults, own, strict=True)])
        lines, i, q = [], 0, 0
        for e in audit:
            if e in "IR":
                lines.append(f"{'assistant' if q == 2 else 'user'}:{own[i][2] if e == 'R' else ''}")
                q = NEXT[q]
            elif e == "K":
                lines.append(f"{own[i][1]}:{own[i][2]}")
                q = STEP[q, own[i][1][:1]]
            i += e != "I"
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))  # noqa: B905
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_op12_edits_are_cheapest_and_least():
    rng = random.Random(2)
    for _ in range(3000):
        rows = [(rng.choice([0, 0, 0, 1, 2]), rng.choice(["u", "a", "s", "u", "a", "", " "])) for _ in range(rng.randint(0, 9))]
        assert dialogue.cheapest_edits(rows) == plain_edits(rows)


def test_op12_edits_of_a_long_conversation_take_no_recursion():
    rng = random.Random(4)
    rows = [(rng.choice([0] * 9 + [1, 2]), rng.choice("ua")) for _ in range(5000)]
    assert dialogue.cheapest_edits(rows) == plain_edits(rows)


@pytest.mark.parametrize("block", [128, 4, 1])
def test_op12_against_plain_repair(spark, block):
    rng = random.Random(block)
    rows = []
    for conv in (None, 1, 2, 3, 4, 5):
        for _ in range({2: 700, 5: 1}.get(conv, 50)):
            text = rng.choice([None, "", "  \t", "a.", "b", "c!", "d? ", "x" * 3000 + ".", *(f"t{i}." for i in range(40))])
            rows.append((conv, rng.choice([None, *range(500 if conv == 2 else 40)]), rng.choice([None, "user", "assistant", "assistant", "user", "system", "tool", ""]), text, "c", 9))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, ck string, seq int").repartition(3)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in dialogue.repair_conversations(df, block).select(*names).collect()]
    want = plain_repair(rows)
    assert len(got) == len(want) and {g[0]: g[1:] for g in got} == want


def test_op12_empty_table_and_lost_conversations(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert dialogue.repair_conversations(spark.createDataFrame([], schema)).count() == 0
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = dialogue.repair_conversations(spark.createDataFrame(gone, schema)).collect()
    assert {r["conv_id"] for r in got} == {g[0] for g in gone}
    assert {(r["gaps"], r["blank"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got} == {(0, 0, 0, "", hashlib.sha256().hexdigest())}
