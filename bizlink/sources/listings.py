"""Landed listings: a registry of loaders, gathered into one frame of fixed schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: The canonical columns of a listing with their types, in order.
LISTING_SCHEMA = (
    "name string, address string, phone string, website string, category string, description string, hours string, price_level string, plus_code string, latitude double, longitude double, "
    "google_rating double, google_review_count int, google_is_open boolean, has_google_maps boolean, google_maps_url string, hotfrog_url string, social_facebook string, social_instagram string, "
    "social_twitter string, social_linkedin string, source_url string"
)
_FIELDS = [tuple(f.strip().split(" ")) for f in LISTING_SCHEMA.split(",")]


def canonical(df: DataFrame, keep: tuple[str, ...] = ("source", "ord")) -> DataFrame:
    """Any frame with some listing columns to all of them; what is absent is null."""
    have = set(df.columns)
    extra = [c for c in df.columns if c in keep or c not in {n for n, _ in _FIELDS}]
    return df.select(*extra, *((F.col(n).try_cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in _FIELDS))


class Registry:
    """Loaders by source name. A source that is switched off isn't read; one whose landing
    place is missing gives no rows instead of failing the run."""

    def __init__(self, loaders: dict[str, Callable[[], DataFrame]], enabled: list[str] | None = None):
        self.loaders = loaders
        self.enabled = list(loaders) if enabled is None else enabled

    def gather(self, spark: SparkSession, only: list[str] | None = None, exclude: DataFrame | Column | None = None, on_progress: str | None = None) -> DataFrame:
        """All chosen sources in one frame. ``exclude`` is a predicate, or a frame of
        ``phone7``/``name_norm`` keys to drop; ``on_progress`` names an observed row count."""
        from bizlink.operators.outreach import suppress_delivered

        out = None
        for name in self.enabled:
            if only is not None and name not in only:
                continue
            try:
                one = canonical(self.loaders[name]()).withColumn("source", F.lit(name))
            except AnalysisException:
                continue
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            out = spark.createDataFrame([], f"source string, ord int, {LISTING_SCHEMA}")
        if isinstance(exclude, Column):
            out = out.where(~F.coalesce(exclude, F.lit(False)))
        elif exclude is not None:
            out = suppress_delivered(out, exclude)
        return out.observe(on_progress, F.count("*").alias("rows")) if on_progress else out


def from_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = LISTING_SCHEMA) -> DataFrame:
    """Landed files with the schema given, never inferred; JSON and CSV rows that don't parse
    come as nulls."""
    reader = spark.read.schema(schema)
    return reader.parquet(path) if fmt == "parquet" else reader.options(mode="PERMISSIVE", header="true").format(fmt).load(path)
