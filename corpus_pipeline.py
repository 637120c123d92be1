"""A training corpus in five stages, each of which takes what the one before it kept.

Quality classifier, SimHash near-dedup, benchmark decontamination, mixing to target weights, token files.
A stage's rows are written as Parquet in the shared folder and read again by the next.

Defined results, beside those of the operators: a null or empty text is scored like any other, is a copy of every
other text without words, and has no words to mix, so none reaches the token files; of equal rows one stays after
near-dedup (ties go to the smallest id, null ids last, then to the text's and the row's hash); the mix may take a
document several times, and each is a document of the token files; unlike texts that share an id are documents of
their own; empty tables of documents, labels or benchmark give empty or unfiltered stages; other columns, whatever
their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossio.llm import decontaminate, mixing, quality, simhash_dedup, token_files
from dossio.llm.common import scratch_uri, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among them, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash_dedup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.drop_documents(docs, decontaminate.index_blocks(table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's budget takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_files(spark, docs, token_files.default_tokenizer())


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("token_files", tokens)]

#: A trained classifier and a tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = scratch_uri(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(to := f"{root}/{k}-{name}")
        docs = spark.read.parquet(to)
    return docs
