"""Batch report over page evidence: ``python -m dossio.report EVIDENCE OUT`` parses it and writes records and a summary.

EVIDENCE is a folder of page evidence as Parquet; OUT gets the evidence package, ``records`` (a JSON row a
document), ``summary`` (one row) and, beside what Spark writes, nothing else; the markdown goes to standard output.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossio.config import load
from dossio.operators import jobs
from dossio.plans import documents
from dossio.shipping import ship
from dossio.sources import evidence, sinks

COLUMNS = ("doc_id", "n_tables", "min_confidence", "max_confidence", "n_review", "n_continued", "n_low_confidence")


def records(parsed: documents.Parsed) -> DataFrame:
    """Regression figures of each document with tables, beside its counters."""
    figures = jobs.record(parsed.tables.select("doc_id", "confidence", "review_required", "is_continuation"))
    return parsed.documents.drop("text", "facts").join(figures, "doc_id", "left")


def summary(rows: DataFrame) -> DataFrame:
    return jobs.summary(rows.select(F.col("raw_table_candidates").alias("raw_tables"), F.col("accepted_table_candidates").alias("accepted_tables")))


def lines(rows: DataFrame) -> DataFrame:
    """(ordinal, line): a markdown table, a row a document."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in COLUMNS])
    return rows.select(F.col("doc_id").cast("string").alias("ordinal"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def run(spark: SparkSession, path: str, out: str, settings: str | None = None) -> str:
    """Parses, writes, and returns the report as markdown."""
    ship(spark)
    parsed = documents.parse(evidence.read(spark, path), load(settings))
    rows = records(parsed)
    sinks.write_package(parsed, out)
    rows.write.mode("overwrite").json(f"{out}/records")
    summary(rows).write.mode("overwrite").json(f"{out}/summary")
    head = "| " + " | ".join(COLUMNS) + " |"
    return sinks.markdown(lines(rows), "Parsing report").replace("\n\n", f"\n\n{head}\n|{'---|' * len(COLUMNS)}\n", 1)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    args.add_argument("evidence")
    args.add_argument("out")
    args.add_argument("--settings")
    a = args.parse_args()
    spark = SparkSession.builder.getOrCreate()
    print(run(spark, a.evidence, a.out, a.settings))


if __name__ == "__main__":
    main()
