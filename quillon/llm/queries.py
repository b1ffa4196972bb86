"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.decontam import contamination
from quillon.llm.language_model import score_texts
from quillon.llm.line_dedup import deduplicated_lines, removed_by_document
from quillon.llm.mixing import mix_sources
from quillon.llm.near_dup import near_duplicates
from quillon.llm.quality import quality_rules, train_quality
from quillon.llm.scratch import shared_dir
from quillon.llm.secrets import made_findings, scan_secrets, train_forest
from quillon.llm.sharding import shard_rows
from quillon.llm.token_ids import read_token_ids, token_digests, write_token_ids
from quillon.llm.toxicity import score_toxicity, train_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), num=85).select("doc_id", "n_shingles", "component_id", "kept")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(_documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(read_token_ids(spark, out))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_rules(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir), train_forest(made_findings(spark)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return score_toxicity(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return removed_by_document(docs, deduplicated_lines(docs))


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_source_mix": op2_source_mix,
        "op3_token_ids": op3_token_ids,
        "op4_line_quality": op4_line_quality,
        "op5_backoff_scores": op5_backoff_scores,
        "op6_secret_scan": op6_secret_scan,
        "op7_toxicity": op7_toxicity,
        "op8_decontaminate": op8_decontaminate,
        "op9_line_dedup": op9_line_dedup,
        "op10_minimax_shards": op10_minimax_shards,
    }


_NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT x AS doc_id, coalesce(n, 0) AS n_shingles, component_id, x = component_id AS kept FROM least LEFT JOIN sizes ON doc_id = x
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express: links by counting all shared shingles, components by recursion."""
    return {"op1_minhash_dedup": _NEAR_DUPLICATES}
