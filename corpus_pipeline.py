"""The corpus pipeline: five stages over ``documents``, each written and read again.

Columns other than ``doc_id`` and ``text`` may be there or not and pass through to the last
stage; an empty table stays empty. What becomes of nulls, empty texts, ties and repeated rows
is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlink.llm import bpe, decontam, linededup, quality, simhash
from bizlink.llm.common import materialize, read
from bizlink.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or repetition rules reject go: null, empty and very short texts
    among them. Rows are judged one by one, so repeated rows stay or go together."""
    return quality.repetition(docs, only_kept=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of three lines or fifty words go; ``n_chars``, where there is one,
    follows the text. The first place by doc_id (nulls first), text hash and line stays; rows
    that repeat id and text stay alike; a text of repeats only becomes empty, a null stays."""
    done = linededup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the smallest doc_id, of equal ids the smallest
    text hash, of repeated rows one. Empty and null texts are one group."""
    return simhash.keep_representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a test item occurs go; null and empty texts stay."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, decoded again as a check; a row for each row,
    nulls as empty texts."""
    return bpe.digest_documents(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: BPE has no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
