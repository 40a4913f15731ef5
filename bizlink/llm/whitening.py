"""Embedding whitening over distinct vectors (operator 13).

Vectors are scaled to integers and grouped, so that identical ones are fitted and whitened
once. A fit weight of each distinct vector is one, or the number of its rows. Sums are exact
integers; the covariance is a weighted product of centred blocks, one small matrix a task,
added up by Spark. Only these matrices reach the driver: they grow with the square of the
dimension and not with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlink.llm.common import materialize, spread_join

SCALE, COMPONENTS = 256, 4
#: Sums and squares up to this size are exact in numpy; larger ones are done in Python integers.
_SAFE = 1 << 62


def scaled_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` with x the floor of ``scale`` times each entry, as longs.

    Rows whose vector is null or holds a null or non-finite entry are dropped; so are entries
    beyond the range of a long. A vector shorter than the longest counts as padded with
    zeros, so that no row is lost; an empty vector is one of zeros.
    """
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 63))
    whole = whole.where(F.forall("v", fits)).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    top = whole.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if top[0] != top[1]:
        whole = whole.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(top[0]) - F.size("x"))))
    return whole


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), wide)


def _sums(wide: int):
    """Per task the number of vectors, their weight and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0, [0] * wide
        for batch in batches:
            x, w = _matrix(batch.column(0), wide), batch.column(1).to_numpy()
            if not len(w):
                continue
            weight += int(w.sum())
            if float(np.abs(x).max(initial=0)) * float(w.sum()) < _SAFE:
                part = (x * w[:, None]).sum(axis=0).tolist()
            else:
                part = (x.astype(object) * w[:, None].astype(object)).sum(axis=0).tolist()
            total = [a + b for a, b in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, wide), pa.int32()), pa.array([str(weight), *map(str, total)])], names=["dim", "total"])

    return run


def _blocks(wide: int, sums: list[int], n: int):
    """Per task the weighted product of the centred vectors, a row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((wide, wide))
        for batch in batches:
            centred = _centred(_matrix(batch.column(0), wide), sums, n)
            out += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(wide), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["dim", "row"])

    return run


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - sums/n; whole means are taken off as integers, so that large offsets cost no digits."""
    if float(np.abs(x).max(initial=0)) > 2**52:
        whole = [s // n for s in sums]
        x = (x.astype(object) - np.array(whole, object)).astype(float)
        return x - np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    return x - np.array([s / n for s in sums])


def _deviation(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Sum of (n x - S)^2 over the dimensions, exact; null where it doesn't fit a long."""
    most = max(float(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0)) * 2
    if most * most * max(x.shape[1], 1) < _SAFE:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    found = (d * d).sum(axis=1).tolist() if x.shape[1] else [0] * len(x)
    return [v if v < 1 << 63 else None for v in found]


def _identity_error(done: DataFrame, columns: list[Column]) -> float:
    """Largest entry of the weighted covariance of the columns minus the identity."""
    means = done.agg(F.sum("w").cast("double").alias("n"), *((F.sum(F.col("w") * c) / F.sum("w")).alias(f"m{i}") for i, c in enumerate(columns))).first()
    off = [c - F.lit(means[f"m{i}"]) for i, c in enumerate(columns)]
    entries = [F.abs(F.sum(F.col("w") * off[i] * off[j]) / F.lit(means["n"]) - F.lit(float(i == j))) for i in range(len(off)) for j in range(i + 1)]
    return max(done.agg(*(e.alias(f"e{k}") for k, e in enumerate(entries))).first())


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, by_rows: bool = False) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for
    each row of ``vectors`` that :func:`scaled_vectors` keeps and each component.

    The fit list has each distinct vector once, or with ``by_rows`` as often as it has rows.
    Components fall by eigenvalue; the largest entry of each is positive. One whose eigenvalue
    is zero up to rounding has whitened null and doesn't count in ``identity_error``;
    ``explained`` is null where all vectors are the same. There are fewer components where the
    vectors have fewer dimensions. ``deviation`` is null beyond the range of a long. Repeated
    rows and ids give a row each, other columns are ignored, and an empty table gives none.
    """
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = scaled_vectors(vectors, scale)
    fit = materialize(rows.groupBy("x").agg(F.count("*").alias("rows")), "distinct-vectors")
    weight = F.col("rows") if by_rows else F.lit(1).cast("long")
    weighted = fit.select("x", weight.alias("w"))
    head = fit.select(F.size("x").alias("wide")).head()
    if not head or not head["wide"]:
        return spark.createDataFrame([], schema)
    wide = head["wide"]
    sums = {r["dim"]: int(r["total"]) for r in weighted.mapInArrow(_sums(wide), "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n, sums = sums.pop(-1), [sums[i] for i in range(wide)]
    cells = weighted.mapInArrow(_blocks(wide, sums, n), "dim int, row array<double>").select("dim", F.posexplode("row").alias("at", "v"))
    cov = np.zeros((wide, wide))
    for r in cells.groupBy("dim", "at").agg(F.sum("v").alias("v")).toLocalIterator():
        cov[r["dim"], r["at"]] = r["v"] / n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, wide)]
    values, axes = values[order], axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    trace = float(np.trace(cov))
    real = [bool(v > max(trace, 0) * wide * np.finfo(float).eps) for v in values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), wide)
            w = _centred(x, sums, n) @ axes
            w = np.divide(w, np.sqrt(np.where(real, values, 1.0)))
            lists = pa.array([[v if ok else None for v, ok in zip(r, real, strict=True)] for r in w.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_deviation(x, sums, n), pa.int64()), lists], names=["x", "rows", "deviation", "w"])

    done = materialize(fit.select("x", "rows").mapInArrow(project, "x array<bigint>, rows bigint, deviation bigint, w array<double>"), "whitened")
    used = [F.col("white")[i] for i, ok in enumerate(real) if ok]
    error = _identity_error(done.select(weight.alias("w"), F.col("w").alias("white")), used) if used else 0.0
    joined = spread_join(rows, done.drop("rows"), ["x"], fit.select("x", F.col("rows").alias("n")), ["vec_id"])
    share = F.create_map(*(v for i, e in enumerate(values.tolist()) for v in (F.lit(i + 1), F.lit(e / trace if trace > 0 else None).cast("double"))))
    flat = joined.select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.posexplode("w").alias("at", "whitened"))
    component = (F.col("at") + 1).cast("int")
    return flat.select("vec_id", component.alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[component].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
