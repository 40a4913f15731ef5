"""What the operators of this package share: scratch tables, task counts, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlink.scratch import materialize, scratch_path

__all__ = ["materialize", "scratch_path", "materialize_buckets", "spread_join", "fresh", "n_tasks", "units", "text_of", "same_row", "read"]


def materialize_buckets(df: DataFrame, tag: str, keys: list[str], buckets: int) -> DataFrame:
    """Like :func:`materialize`, with rows bucketed by ``keys``, so that a later join or grouping
    on them moves only its other side. Rows that lie by the keys already, as after a join on
    them, give a file for each bucket."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, tag)).bucketBy(buckets, *keys).saveAsTable(name)
    table = spark.table(name)
    # The name was needed for the buckets only; the files, at a path of their own, stay.
    spark.sql(f"DROP TABLE {name}")
    return table


#: A key of more rows than this, and than the ``HOT_KEYS``-th part of all, is spread over tasks.
HOT_ROWS, HOT_KEYS = 1000, 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined on ``keys`` with the one row that ``right`` has of each key, hot keys spread.

    ``counts`` is a written table of the keys with the number ``n`` of their rows in ``left``. Keys
    above the limits are fewer than ``HOT_KEYS`` whatever the data, so they are broadcast to mark
    their rows; those rows are dealt out by the columns ``by`` too, and the right rows of
    these keys are repeated for every part. Nothing else moves twice.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(*keys, F.lit(True).alias("__hot"))
    if hot.isEmpty():
        return left.join(right, keys, how)
    parts = n_tasks(left)
    marked = left.join(F.broadcast(hot), keys, "left")
    marked = marked.withColumn("__part", F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(every)).drop("__hot")
    return marked.join(repeated, [*keys, "__part"], how).drop("__part")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_tasks(df: DataFrame) -> int:
    """Partitions for an explicit shuffle: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def units(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part has ``most`` bytes of the text column at most, or one row."""
    for batch in batches:
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = int(size[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_of(df: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(df["text"], F.lit(""))


def same_row(a: DataFrame, b: DataFrame, *cols: str) -> Column:
    """Null-safe equality of the named columns."""
    out = F.lit(True)
    for c in cols:
        out = out & a[c].eqNullSafe(b[c])
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
