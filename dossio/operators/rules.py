"""Registered rules over documents, with risks and proposals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossio.functions import text as T

SOURCES = ("regulation", "guideline", "internal")


@dataclass(frozen=True)
class Rule:
    """``evaluate`` gives a struct(status, message) from a document's row; status is pass, fail, warn or na."""

    rule_id: str
    category: str
    evaluate: Callable[[DataFrame], Column]


def outcome(ok: Column, message: str, otherwise: str = "fail") -> Column:
    return F.struct(F.when(ok, "pass").otherwise(otherwise).alias("status"), F.lit(message).alias("message"))


def run_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each document and rule, in order: doc_id, ordinal, rule_id, category, status, message."""
    if not rules:
        return docs.select("doc_id", F.lit(0).alias("ordinal"), *[F.lit("").alias(c) for c in ("rule_id", "category", "status", "message")]).where("false")
    made = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), r.evaluate(docs)["status"].alias("status"), r.evaluate(docs)["message"].alias("message")) for r in rules])
    return docs.select("doc_id", F.posexplode(made).alias("i", "r")).select("doc_id", (F.col("i") + 1).alias("ordinal"), "r.*")


def risks(results: DataFrame) -> DataFrame:
    """Failed and warned rules, numbered by their place among all results of the document."""
    return results.where(F.col("status").isin("fail", "warn")).select("doc_id", F.format_string("RISK-%03d", "ordinal").alias("risk_id"), F.lit("medium").alias("severity"), F.col("message").alias("reason"))


def without_exemptions(results: DataFrame, exemptions: DataFrame) -> DataFrame:
    """Results whose rule the profile (profile, rule_id) doesn't exempt."""
    return results.join(exemptions, ["profile", "rule_id"], "left_anti")


def proposals(findings: DataFrame, order: list) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return findings.withColumn("proposal_id", F.format_string("PROP-%03d", n))


def rerank(results: DataFrame, order: str = "ordinal") -> DataFrame:
    """By score, highest first; a missing score is 0; ties keep their order."""
    return results.orderBy(F.coalesce("score", F.lit(0.0)).desc(), F.col(order).asc())


def retrieve(queries: DataFrame) -> DataFrame:
    """One placeholder hit with score 0 for each query of an allowed source."""
    return queries.where(F.col("source").isin(*SOURCES)).select("query", "source", F.lit(0.0).alias("score"))


def tag_source(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("source_label", F.lit(label))


def format_response(df: DataFrame) -> DataFrame:
    """status, summary, findings, evidence, with defaults where they are missing."""
    get = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c) if c in df.columns else F.lit(d).alias(c)
    return df.select(get("status", "unknown"), get("summary", ""), get("findings", ""), get("evidence", ""))


def layout(text: Column) -> Column:
    """The text as a block list, empty for a blank text."""
    return F.when(F.coalesce(T.strip(text), F.lit("")) != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def module_buckets(index: Column) -> Column:
    """The five module lists of a map, empty where missing."""
    none = F.array().cast("array<string>")
    return F.struct(*[F.coalesce(F.element_at(index, f"module_{k}"), none).alias(f"module_{k}") for k in range(1, 6)])


def index_manifest(names: DataFrame) -> DataFrame:
    return names.agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("files"))


def generate(prompt: Column) -> Column:
    """Deterministic stand-in for a text generator: the first 200 characters."""
    return F.concat(F.lit("[generated] "), F.left(prompt, F.lit(200)))


def explain_risk(statement: Column) -> Column:
    return generate(F.concat(F.lit("Explain risk: "), T.sanitize_prompt(statement)))


def agent_results(payload: DataFrame) -> DataFrame:
    """What the stub agents give for each module payload."""
    cmc = F.struct(F.lit("cmc").alias("agent"), F.lit("not_implemented").alias("status"))
    return payload.withColumn("agents", F.array(cmc))


def versions(rules: str, schema: str, engine: str) -> Column:
    return F.struct(F.lit(rules).alias("rules"), F.lit(schema).alias("schema"), F.lit(engine).alias("engine"))
