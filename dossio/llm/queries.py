"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossio.llm import decontaminate, html_extract, line_dedup, lz_fingerprint, mixing, quality, secret_scan, simhash_dedup, token_files, toxicity
from dossio.llm.common import table


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = decontaminate.index_blocks(table(spark, sf_dir, "benchmark"))
    found = decontaminate.scan(table(spark, sf_dir, "documents"), blocks)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, table(spark, sf_dir, "documents"), token_files.default_tokenizer())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lz_fingerprint": op1_lz_fingerprint,
    "op2_decontamination": op2_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_token_files": op7_token_files,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
        iw AS (SELECT item_id, w, least({decontaminate.SIZE}, len(w)) AS n, unnest(range(1, len(w) - least({decontaminate.SIZE}, len(w)) + 2)) AS k FROM i WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM iw),
        lens AS (SELECT DISTINCT n FROM win),
        dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n),
        hit AS (SELECT doc_id, k, n, item_id FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM dk) JOIN win USING (n, g)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
        nam AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {decontaminate.RATIO} * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN nam USING (doc_id)""",
    "op3_secret_scan": secret_scan.oracle(),
    "op4_line_dedup": line_dedup.ORACLE,
}
