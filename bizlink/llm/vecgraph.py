"""Embedding near-duplicates by a robust-pruned flat graph (operator 11).

Distinct vectors are dealt to the shards of their two nearest centroids; the nearest is a
vector's home. Each shard builds its own graph: nearest, random and backward candidates pruned
so that a neighbour isn't behind a nearer one. The lists that a vector has from its two shards
are united, with the home of every neighbour. A query visits the shards whose border is near
it, walks greedily from their medoids (and itself, where it is a node) and, once in range, through everything in range; a
neighbour in range whose home hasn't been visited sends it there in the next round. Every hit
is verified by its cosine in double precision and counted in its home only.

Hits leave a task as counts and as the edges of a spanning forest, never as pairs. Recall is
audited against brute force, and borders are widened until it is reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlink.llm.common import materialize, n_tasks, spread_join
from bizlink.llm.graph import components

THRESHOLD = 0.95
#: Centroids are fitted on so many vectors at most; a shard has about so many homes, a task so many queries.
SAMPLE, SHARD, QUERIES, CENTROIDS = 16_384, 1_000, 8_192, 4_096
#: Nearest and random candidates of a node, neighbours kept, and how much nearer a neighbour must be to hide another.
NEAREST, RANDOM, DEGREE, ALPHA = 40, 16, 16, 1.2
#: Starting points of a shard, nodes opened before a walk may end, opened at a time.
ENTRIES, BEAM, STEP = 8, 32, 4
#: A walk goes on through nodes that miss the threshold by so much: hits may touch only through them.
SLACK = 0.08
#: Queries of the audit, recall to reach, and the width of a border that is tried first: a hit lies
#: (2 - 2 * threshold) ** 0.5 away at most, of which a border sees a root of the dimension's share.
AUDIT, RECALL, MARGIN = 200, 0.98, 0.06


def _units(column: pd.Series) -> np.ndarray:
    """Unit vectors in double precision, scaled by powers of two first, so that nothing overflows."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of the sample."""
    rng = np.random.default_rng(7)
    out = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(8):
        best = np.concatenate([(sample[i : i + 2048] @ out.T).argmax(axis=1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(out)
        np.add.at(sums, best, sample)
        norm = np.linalg.norm(sums, axis=1)
        out[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return out


def _route(centroids: np.ndarray, margin: float):
    """``(node, home, second, near)`` of every vector: its two nearest centroids, and all whose
    border with the nearest is within ``margin``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
        np.fill_diagonal(gap, 1)
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.iloc[lo : lo + 2048]
                sims = _units(part["embedding"]) @ centroids.T
                order = np.argsort(-sims, axis=1, kind="stable")[:, :2]
                home, second = order[:, 0], order[:, -1]
                best = np.take_along_axis(sims, home[:, None], 1)
                near = (best - sims) <= margin * gap[home]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "home": home.astype("int32"), "second": second.astype("int32"), "near": [np.flatnonzero(r).astype("int32") for r in near]})

    return run


def _prune(sims: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """The pruned list of every node from its pool of candidates (-1: none), all nodes at once."""
    m = len(sims)
    rows = np.arange(m)[:, None]
    own = np.where((pool >= 0) & (pool != rows), sims[rows, pool], -np.inf)
    order = np.argsort(-own, axis=1, kind="stable")
    pool, own = np.take_along_axis(pool, order, 1), np.take_along_axis(own, order, 1)
    alive = own > -np.inf
    alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    far = np.sqrt(np.maximum(0, 2 - 2 * own, where=alive, out=np.zeros_like(own)))
    out = np.full((m, degree), -1, np.int64)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = np.where(some, np.take_along_axis(pool, alive.argmax(axis=1)[:, None], 1)[:, 0], -1)
        out[:, k] = pick
        between = np.sqrt(np.maximum(0, 2 - 2 * sims[pick[:, None], pool]))
        alive &= some[:, None] & (ALPHA * between > far) & (pool != pick[:, None])
    return out


def _backward(lists: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` nodes that have each node in their lists, nearest places first."""
    m, degree = lists.shape
    at, source = lists.T.ravel(), np.tile(np.arange(m), degree)
    source, at = source[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    at, source = at[order], source[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    out = np.full((m, most), -1, np.int64)
    keep = rank < most
    out[at[keep], rank[keep]] = source[keep]
    return out


def _attach(lists: np.ndarray, times: int = 2, room: int = 8) -> np.ndarray:
    """Further neighbours, so that each node is in the lists of the ``times`` nearest of its
    own neighbours that have room for it; a node many are nearest to passes them on."""
    m = len(lists)
    out, used, placed = np.full((m, room), -1, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for column in lists.T:
        node = np.flatnonzero((placed < times) & (column >= 0))
        node = node[np.argsort(column[node], kind="stable")]
        to = column[node]
        slot = used[to] + np.arange(len(to)) - np.searchsorted(to, to)
        fits = slot < room
        out[to[fits], slot[fits]] = node[fits]
        used += np.bincount(to[fits], minlength=m)
        placed[node[fits]] += 1
    return out


def build_graph(vectors: np.ndarray, seed: int = 7) -> np.ndarray:
    """Neighbour lists (-1: none) of one shard's vectors, pruned twice as candidates come in.
    A node stays reachable: near neighbours that it has kept also have it."""
    m = len(vectors)
    if m < 2:
        return np.full((m, 1), -1, np.int64)
    sims = (vectors @ vectors.T).astype(np.float32)
    near = np.argpartition(-sims, min(NEAREST, m - 1), axis=1)[:, : NEAREST + 1]
    far = np.random.default_rng(seed).integers(0, m, (m, RANDOM))
    first = _prune(sims, np.concatenate([near, far], 1), DEGREE)
    second = _prune(sims, np.concatenate([first, _backward(first, DEGREE)], 1), DEGREE)
    return np.concatenate([second, _attach(second)], 1)


def _entries(vectors: np.ndarray) -> np.ndarray:
    """The medoid, then nodes far from those taken."""
    at = [int((vectors @ vectors.mean(axis=0)).argmax())]
    most = vectors @ vectors[at[0]]
    while len(at) < min(ENTRIES, len(vectors)):
        at.append(int(most.argmin()))
        most = np.maximum(most, vectors @ vectors[at[-1]])
    return np.array(at)


def range_search(queries: np.ndarray, starts: list, vectors: np.ndarray, lists: np.ndarray, reach: float) -> np.ndarray:
    """Which vectors each query meets within ``reach`` of cosine: greedy from the entries and
    its own starts, ``BEAM`` nodes at least, then on while an unopened node is near reach."""
    k, m = len(queries), len(vectors)
    q, x = queries.astype(np.float32), vectors.astype(np.float32)
    seen = np.full((k, m), -2, np.float32)
    left = np.full((k, m), -2, np.float32)  # the same for nodes that aren't opened yet
    entries = _entries(x)
    seen[:, entries] = left[:, entries] = q @ x[entries].T
    for i, own in enumerate(starts):
        if len(own):
            seen[i, own] = left[i, own] = x[own] @ q[i]
    step, opened, active = min(STEP, m), 0, np.arange(k)
    while len(active):
        part = left[active]
        best = np.argpartition(-part, step - 1, axis=1)[:, :step]
        sims = np.take_along_axis(part, best, 1)
        top = sims.max(axis=1)
        go = (top > -2) if opened < BEAM else (top >= reach - SLACK)
        active, best, sims = active[go], best[go], sims[go]
        if not len(active):
            break
        if opened >= BEAM:
            best = np.where(sims >= reach - SLACK, best, best[np.arange(len(best)), sims.argmax(axis=1)][:, None])
        rows = active[:, None]
        left[rows, best] = -2
        next_ = lists[best].reshape(len(active), -1)
        at, to = np.nonzero(next_ >= 0)
        node = next_[at, to]
        new = seen[active[at], node] == -2
        at, node = at[new], node[new]
        found = np.einsum("ij,ij->i", q[active[at]], x[node])
        seen[active[at], node] = left[active[at], node] = found
        opened += step
    return seen >= reach


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    vectors = _units(shard["embedding"])
    lists = build_graph(vectors)
    nodes, homes = shard["node"].to_numpy(), shard["home"].to_numpy()
    rows = []
    for i, own in enumerate(lists):
        own = own[own >= 0]
        rows.append((nodes[i], nodes[own], homes[own], (vectors[own] @ vectors[i]).astype("float32")))
    return pd.DataFrame(rows, columns=["node", "nbrs", "homes", "sims"])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of every node's component under the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search(threshold: float):
    """Queries of one shard against its graph: counts (kind 0), edges (1), and ways on (2)."""

    def run(asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "a", "b", "shard"]
        if not len(asked) or not len(graph):
            return pd.DataFrame([], columns=columns)
        graph = graph.sort_values("node")
        nodes, homes, weight = graph["node"].to_numpy(), graph["home"].to_numpy(), graph["n"].to_numpy()
        here = int(graph["shard"].iloc[0])
        vectors = _units(graph["embedding"])
        lengths = graph["nbrs"].map(len).to_numpy()
        flat, flat_home, flat_sim = (np.concatenate(graph[c].to_numpy()) if lengths.sum() else np.zeros(0, t) for c, t in (("nbrs", np.int64), ("homes", np.int64), ("sims", np.float32)))
        source = np.repeat(np.arange(len(nodes)), lengths)
        local = np.searchsorted(nodes, flat).clip(max=len(nodes) - 1)
        inside = nodes[local] == flat if len(flat) else np.zeros(0, bool)
        lists = np.full((len(nodes), max(1, lengths.max(initial=1))), -1, np.int64)
        lists[source[inside], (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[inside]] = local[inside]
        # Nodes with a neighbour outside that may be in range of a query that has them in range.
        open_ = np.flatnonzero(~inside & (flat_sim >= 2 * threshold * threshold - 1 - 1e-3))
        onward = {z: open_[source[open_] == z] for z in np.unique(source[open_])}
        ids, visited = asked["node"].to_numpy(), asked["visited"].to_numpy()
        every = np.concatenate([nodes, ids[~np.isin(ids, nodes)]])
        every.sort()
        place, own_place = np.searchsorted(every, ids), np.searchsorted(every, nodes)
        counts, ways, a, b = [], [], [], []
        home = homes == here
        # Hits between vectors at home here count for both, whichever found the other.
        at_home = np.cumsum(home) - 1
        mutual, asking = np.zeros((int(home.sum()),) * 2, bool), np.zeros(int(home.sum()), bool)
        own_node = np.searchsorted(nodes, ids).clip(max=len(nodes) - 1)
        resident = (nodes[own_node] == ids) & home[own_node]
        asking[at_home[own_node[resident]]] = True
        for lo in range(0, len(ids), 1024):
            part = slice(lo, lo + 1024)
            q = _units(asked["embedding"].iloc[part])
            starts = [np.append(s, own) for s, own in zip(asked["starts"].iloc[part], ids[part], strict=True)]
            starts = [np.searchsorted(nodes, s[np.isin(s, nodes)]) for s in starts]
            met = range_search(q, starts, vectors, lists, threshold - 1e-4)
            i, j = np.nonzero(met)
            sims = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[i[s : s + 65536]], vectors[j[s : s + 65536]]) for s in range(0, len(i), 65536))])
            i, j, sims = i[sims >= threshold], j[sims >= threshold], sims[sims >= threshold]
            other = nodes[j] != ids[part][i]
            both = other & home[j] & resident[part][i]
            mutual[at_home[own_node[part][i[both]]], at_home[j[both]]] = True
            rest = other & home[j] & ~resident[part][i]
            hits = np.bincount(i[rest], weight[j[rest]], minlength=len(q))
            counts += [(0, ids[lo + k], int(v), here) for k, v in enumerate(hits) if v]
            a.append(place[part][i[other]])
            b.append(own_place[j[other]])
            # (query, node, home) to go on to: what is at home elsewhere, and neighbours outside that may be in range.
            on = [np.stack([i[~home[j]], nodes[j[~home[j]]], homes[j[~home[j]]]])]
            for z in np.unique(j[np.isin(j, list(onward))]) if onward else ():
                k, angle = i[j == z], np.arccos(np.clip(sims[j == z], -1, 1))
                for e in onward[z]:
                    k_ = k[np.arccos(np.clip(flat_sim[e], -1, 1)) - angle <= np.arccos(threshold) + 1e-3]
                    on.append(np.stack([k_, np.full(len(k_), flat[e]), np.full(len(k_), flat_home[e])]))
            on = np.concatenate(on, axis=1)
            _, once = np.unique(on[[0, 2]], axis=1, return_index=True)
            ways += [(2, ids[lo + k], z, h) for k, z, h in on[:, once].T.tolist() if h not in visited[lo + k]]
            label = _forest(np.concatenate(a), np.concatenate(b), len(every))
            moved = np.flatnonzero(label != np.arange(len(every)))
            a, b = [label[moved]], [moved]
        hits = (mutual | (mutual.T & asking[:, None])) @ weight[home]
        counts += [(0, n, int(v), here) for n, v in zip(nodes[home], hits, strict=True) if v]
        edges = [(1, every[x], every[y], here) for x, y in zip(a[0], b[0], strict=True)]
        return pd.DataFrame(counts + edges + ways, columns=columns)

    return run


_FOUND = "kind int, a bigint, b bigint, shard int"


class Linked:
    """What :func:`link` leaves: ``classes`` (node, embedding, n, vec_id), ``counts`` (node, hits), ``edges`` (a, b)."""

    def __init__(self, classes: DataFrame, counts: DataFrame, edges: DataFrame, recall: float) -> None:
        self.classes, self.counts, self.edges, self.recall = classes, counts, edges, recall


def link(vectors: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> Linked:
    """Distinct vectors of ``(vec_id, embedding)`` with the number of rows each is linked to."""
    spark = vectors.sparkSession
    classes = vectors.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "embedding", "n", "vec_id"), "classes")
    size = classes.count()
    sample = classes.select("embedding").orderBy(F.xxhash64("node")).limit(SAMPLE).toPandas()
    if not len(sample):
        none = spark.createDataFrame([], "a bigint, b bigint")
        return Linked(classes, none.select(F.col("a").alias("node"), F.col("b").alias("hits")), none, 1.0)
    k = max(1, min(CENTROIDS, len(sample) // 4 or 1, -(-size // SHARD)))
    centroids = _centroids(_units(sample["embedding"]), k)
    tried = margin
    while True:
        counts, edges = _link_once(classes, centroids, threshold, tried)
        recall = audit(classes, counts, threshold)
        # At this width every shard that can hold a hit is visited, so wider borders give no more.
        if recall >= RECALL or tried >= (2 - 2 * threshold) ** 0.5:
            return Linked(classes, counts, edges, recall)
        tried = 2 * tried


def _link_once(classes: DataFrame, centroids: np.ndarray, threshold: float, margin: float) -> tuple[DataFrame, DataFrame]:
    routed = materialize(classes.mapInPandas(_route(centroids, margin), "node bigint, home int, second int, near array<int>"), "routes")
    # A centroid with more vectors than a task should hold has several shards, each visited.
    homes = routed.groupBy("home").agg(F.count("*").alias("c")).collect()
    parts = {r["home"]: max(1, -(-r["c"] // (4 * SHARD))) for r in homes}
    base, first = 0, []
    for c in range(len(centroids)):
        first.append(base)
        base += parts.get(c, 1)
    width = F.create_map(*(F.lit(v) for c in range(len(centroids)) for v in (c, parts.get(c, 1)))) if max(parts.values()) > 1 else None
    start = F.array(*(F.lit(v) for v in first))
    of = lambda c: (start[c] + F.pmod(F.xxhash64("node"), width[c]).cast("int")) if width is not None else start[c]
    every = lambda c: F.sequence(start[c], start[c] + width[c] - 1) if width is not None else F.array(start[c])
    placed = routed.select("node", of(F.col("home")).alias("home"), of(F.col("second")).alias("second"), F.flatten(F.transform("near", every)).alias("near"))
    nodes = materialize(classes.join(placed, "node"), "placed")
    dealt = nodes.select("node", "embedding", "n", "home", F.explode(F.array_distinct(F.array("home", "second"))).alias("shard"))
    built = dealt.groupBy("shard").applyInPandas(_build, "node bigint, nbrs array<bigint>, homes array<int>, sims array<float>")
    united = built.groupBy("node").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("nbrs", "homes", "sims")))
    graph = materialize(dealt.join(united, "node"), "graph")
    asked = nodes.select("node", "embedding", F.explode("near").alias("shard"), F.col("near").alias("visited"), F.array().cast("array<bigint>").alias("starts"))
    found = None
    while True:
        got = materialize(_ask(asked, graph, threshold), "found")
        found = got if found is None else found.unionByName(got)
        ways = got.where("kind = 2").groupBy(F.col("a").alias("node"), "shard").agg(F.collect_set("b").alias("starts"))
        if ways.isEmpty():
            break
        been = asked.select("node", "visited").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("visited"))).alias("been"))
        going = ways.join(been, "node").where(~F.array_contains("been", F.col("shard")))
        all_ = going.groupBy("node").agg(F.collect_list("shard").alias("more"))
        going = going.join(all_, "node").select("node", "shard", "starts", F.concat("been", "more").alias("visited"))
        asked = materialize(going.join(nodes.select("node", "embedding"), "node").select("node", "embedding", "shard", "visited", "starts"), "asked")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("hits"))
    return materialize(counts, "hits"), found.where("kind = 1").select("a", "b").distinct()


def _ask(asked: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """One round; a shard with many queries is searched by several tasks."""
    sizes = asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("tasks"))
    dealt = asked.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("node"), "tasks").cast("int")).drop("tasks")
    copies = graph.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(_search(threshold), _FOUND)


def audit(classes: DataFrame, counts: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Share of the true links of ``queries`` linked vectors and as many others, chosen by hash, that were found."""
    chosen = classes.join(counts, "node", "left").orderBy(F.col("hits").isNull(), F.xxhash64("node", F.lit(1))).limit(queries)
    plain = classes.join(counts, "node", "left").orderBy(F.xxhash64("node", F.lit(2))).limit(queries)
    asked = chosen.unionByName(plain).dropDuplicates(["node"]).select("node", "embedding", F.coalesce("hits", F.lit(0)).alias("hits")).toPandas()
    units, ids = _units(asked["embedding"]), asked["node"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(len(ids), np.int64)
        for batch in batches:
            frame = batch.to_pandas()
            for lo in range(0, len(frame), 4096):
                part = frame.iloc[lo : lo + 4096]
                near = (units @ _units(part["embedding"]).T >= threshold) & (ids[:, None] != part["node"].to_numpy())
                hits += near @ part["n"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hits)], names=["node", "hits"])

    true = classes.select("node", "embedding", "n").mapInArrow(run, "node bigint, hits bigint").groupBy("node").agg(F.sum("hits").alias("hits")).toPandas().set_index("node")["hits"]
    total = int(true.sum())
    return 1.0 if not total else int(np.minimum(asked["hits"].to_numpy(), true.loc[ids].to_numpy()).sum()) / total


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, audit_recall)``, a row for each row of ``(vec_id, embedding)``.

    Equal vectors are one node with the number of their rows. Vectors that are null, empty, all
    zero, or hold null or non-finite entries are linked with nothing, and only vectors of one
    length with each other. Repeated ids give a row each; a component's id is its smallest id,
    null where all its ids are null, and such rows are kept. Other columns are ignored.
    ``audit_recall`` is the share of brute-force links that the audit found.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce(finite & F.exists("embedding", lambda c: c != 0), F.lit(False))
    lengths = [r[0] for r in rows.where(good).select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("audit_recall"))
    out = alone
    for d in lengths:
        own = rows.where(good & (F.size("embedding") == d))
        done = link(own, threshold)
        stars = components(done.edges)
        nodes = done.classes.join(done.counts, "node", "left").join(stars, "node", "left")
        nodes = materialize(nodes.select("embedding", "n", "vec_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("root", "node").alias("root")), "nodes")
        low = nodes.groupBy("root").agg(F.min("vec_id").alias("component_id"))
        classes = nodes.join(low, "root").select("embedding", (F.col("hits") + F.col("n") - 1).alias("n_links"), "component_id")
        whole = spread_join(own, classes, ["embedding"], nodes.select("embedding", "n"), ["vec_id"])
        out = out.unionByName(whole.select("vec_id", "n_links", "component_id", F.lit(done.recall).alias("audit_recall")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "audit_recall")
