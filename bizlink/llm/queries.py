"""The registered queries of this package and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlink.llm import bpe, decontam, dialogue, linededup, pii, quality, sharding, simhash, suffix, tokens_out, toxicity, vecgraph, whitening
from bizlink.llm.common import read, scratch_path

#: The vocabulary of the production queries; every operator takes the path as a parameter.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Key of the registered query; in production a secret of the owner's, never stored with the data.
SURROGATE_KEY = b"registered-query"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens_out.write_token_files(read(spark, sf_dir, "documents"), VOCABULARY, path)
    return tokens_out.token_digests(spark, path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.repetition(docs).drop("text")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read(spark, sf_dir, "documents"), VOCABULARY)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.dedup_lines(docs, counts=True)
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, SURROGATE_KEY)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_substrings(read(spark, sf_dir, "documents"))


def op11_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecgraph.near_duplicates(read(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_conversations(read(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_quality_rules, op3_bpe_round_trip, op4_line_dedup, op5_pii_surrogates, op6_toxicity, op7_simhash_groups, op8_slot_sharding, op9_decontamination, op10_suffix_dedup, op11_embedding_groups, op12_conversation_repair, op13_embedding_whitening)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = """
WITH l AS (SELECT doc_id, pos, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS w FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
n AS (SELECT *, sum(CAST(w AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l),
s AS (SELECT doc_id, k, line, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3, nw, lead(nw, 1) OVER o AS nw2 FROM (
  SELECT doc_id, k, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw FROM n WHERE w) WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
u AS (SELECT doc_id, k, 1 AS m, line AS a, NULL AS b, NULL AS c FROM s WHERE nw >= 50
  UNION ALL SELECT doc_id, k, 2, line, l2, NULL FROM s WHERE l2 IS NOT NULL AND nw + nw2 >= 50
  UNION ALL SELECT doc_id, k, 3, line, l2, l3 FROM s WHERE l3 IS NOT NULL),
r AS (SELECT doc_id, k, m, row_number() OVER (PARTITION BY m, a, b, c ORDER BY doc_id, k) AS rn FROM u),
g AS (SELECT DISTINCT doc_id, k + i AS k FROM (SELECT doc_id, k, unnest(range(m)) AS i FROM r WHERE rn > 1)),
f AS (SELECT n.doc_id, n.pos, n.line, n.w, CASE WHEN n.w THEN g.k IS NOT NULL END AS d FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.k = g.k AND n.w),
h AS (SELECT *, CASE WHEN w THEN d ELSE coalesce(max(d) OVER (PARTITION BY doc_id), false)
  AND coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), true)
  AND coalesce(first_value(d IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), true) END AS gone FROM f)
SELECT doc_id, count(*) FILTER (w) AS n_lines, count(*) FILTER (w AND d) AS n_deleted, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM h GROUP BY doc_id
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i + 1:i + m], ' ') AS t FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i + 1:i + m], ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.t = bw.t),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hit) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN q ON d.doc_id = q.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express over whole tables; the tests hold the others
    to brute-force versions."""
    return {"op4_line_dedup": OP4_SQL, "op9_decontamination": OP9_SQL}
