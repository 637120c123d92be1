"""The evidence package: run folders, artifacts by document, results and logs, written by Spark."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossio.functions import cast as C

EXCERPT = 2000


def run_id(job_id: str, stamp: str) -> str:
    return f"run_{stamp}_{job_id[:8]}"


def create_run(spark: SparkSession, root: str, run: str, files: DataFrame, versions: dict[str, str]) -> str:
    """Writes the manifest: a row with versions, inputs and status; returns the run's folder."""
    at = f"{root.rstrip('/')}/run_id={run}"
    inputs = files.agg(F.array_sort(F.collect_list(F.struct("file_id", "filename"))).alias("inputs"))
    row = inputs.select(F.lit(run).alias("run"), F.lit("running").alias("status"), F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]).alias("versions"), "inputs", F.lit(None).cast("string").alias("error"), C.utc_now().alias("at"))
    row.write.mode("overwrite").json(f"{at}/manifest/step=0")
    return at


def finish_run(spark: SparkSession, at: str, status: str, error: str | None = None) -> None:
    """Adds the manifest row of the end; the last step is the state."""
    first = spark.read.json(f"{at}/manifest/step=0")
    first.withColumn("status", F.lit(status)).withColumn("error", F.lit(error).cast("string")).withColumn("at", C.utc_now()).write.mode("overwrite").json(f"{at}/manifest/step=1")


def append_log(spark: SparkSession, at: str, message: str, level: str = "INFO") -> None:
    line = F.concat(C.utc_now(), F.lit(f" | {level} | {message}")).alias("value")
    spark.range(1).select(line).coalesce(1).write.mode("append").text(f"{at}/log")


def write_documents(docs: DataFrame, at: str) -> None:
    """Document artifacts by bucket and document: excerpt, counts and facts."""
    out = docs.select(C.bucket(F.col("suffix"), F.col("source_type")).alias("bucket"), "doc_id", "filename", "source_type", F.left("text", F.lit(EXCERPT)).alias("text_excerpt"), F.length("text").alias("text_length"), "n_images", "n_tables", "facts")
    out.write.mode("overwrite").partitionBy("bucket").json(f"{at}/documents")


def write_tables(tables: DataFrame, at: str) -> None:
    """Table artifacts; the key is (doc_id, table_id), so documents don't collide."""
    tables.write.mode("overwrite").partitionBy("doc_id").json(f"{at}/tables")


def write_images(images: DataFrame, at: str) -> None:
    """Image artifacts, a row each, by document."""
    images.write.mode("overwrite").partitionBy("doc_id").json(f"{at}/images")


def write_blocks(nodes: DataFrame, at: str) -> None:
    """The document's tree: a row for each page with its text, image and table nodes in reading order."""
    nodes.write.mode("overwrite").partitionBy("doc_id").json(f"{at}/blocks")


def write_package(parsed, at: str) -> None:
    """All artifacts of parsed documents (plans/documents.py): documents, tables, images, blocks."""
    from dossio.operators import jobs
    from dossio.plans import documents

    d = parsed.documents
    named = d.select("doc_id", F.lit(".pdf").alias("suffix"), F.col("doc_id").cast("string").alias("filename"), "source_type", "text", F.col("image_count").alias("n_images"), F.col("table_count").alias("n_tables"), "facts")
    write_documents(named, at)
    write_tables(documents.table_json(parsed.tables), at)
    write_images(parsed.images, at)
    write_blocks(jobs.document_nodes(parsed.texts, parsed.images, parsed.tables.drop("text")), at)


def write_outputs(result: DataFrame, audit: DataFrame, at: str) -> None:
    result.write.mode("overwrite").json(f"{at}/outputs/compliance_result")
    audit.write.mode("overwrite").json(f"{at}/outputs/audit_log")


def markdown(lines: DataFrame, title: str, order: str = "ordinal") -> str:
    """A small report as text; for results of a bounded number of lines."""
    return "\n".join([f"# {title}", "", *[r["line"] for r in lines.orderBy(order).select("line").toLocalIterator()]])


def dependency_fingerprint(parts: dict[str, bytes]) -> str:
    """SHA-256 over name NUL content NUL, in order of names."""
    h = hashlib.sha256()
    for name in sorted(parts):
        h.update(name.encode() + b"\x00" + parts[name] + b"\x00")
    return h.hexdigest()
