"""Queries of the document operators over the driver's tables, each with the SQL it must agree with.

The tables hold no PDFs, so evidence is rendered from them: parts as labelled texts, order lines as boxes,
grids and tables, document lines as text blocks.  Every query runs over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossio.functions import cast as C
from dossio.functions import geom as G
from dossio.functions import text as T
from dossio.operators import facts, images, jobs, repairs, rules, stitch, tables, text_blocks, words
from dossio.shared import shared_folder
from dossio.shipping import ship
from dossio.sources import files
from dossio.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


#: Lines of an order in a total order (line numbers repeat).
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
SQL_LINES = "ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS no FROM lineitem)"


def order_lines(spark, sf_dir) -> DataFrame:
    """Order lines with ``no``, their place in the order from 1."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return read(spark, sf_dir, "lineitem").withColumn("no", F.row_number().over(w))


# --- evidence rendered from the tables ---------------------------------------------------------------


def part_documents(spark, sf_dir) -> DataFrame:
    """A labelled document for each part, in five modules."""
    p = read(spark, sf_dir, "part")
    lines = [("Drug Name", "p_name"), ("剂型", "p_type"), ("Batch No.", "p_partkey"), ("Manufacturing Site", "p_brand"), ("规格", "p_size")]
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in lines])
    return p.select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").cast("int").alias("idx"), F.concat(F.lit("m"), (F.col("p_size") % 5 + 1).cast("string"), F.lit("-part.pdf")).alias("filename"), text.alias("text"))


PART_FACTS = """facts AS (SELECT p_partkey AS doc_id, 'M' || (p_size % 5 + 1) AS module, unnest([
    {'f': 'drug_name', 'v': p_name}, {'f': 'dosage_form', 'v': p_type}, {'f': 'batch_number', 'v': CAST(p_partkey AS VARCHAR)},
    {'f': 'manufacturing_site', 'v': p_brand}, {'f': 'strength', 'v': CAST(p_size AS VARCHAR)}]) AS x FROM part)"""


def line_boxes(spark, sf_dir) -> DataFrame:
    """A box for each order line: doc_id (order), page 1, ordinal, bbox."""
    line = order_lines(spark, sf_dir)
    x, y = F.col("l_partkey") % 400 * 1.0, F.col("l_suppkey") % 60 * 10.0
    return line.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("no").alias("ordinal"), G.box(x, y, x + F.col("l_quantity") * 4, y + 10 + F.col("no") * 8).alias("bbox"), "l_returnflag", "l_partkey")


BOXES = SQL_LINES + """, b AS (SELECT l_orderkey AS doc_id, no AS o, l_returnflag AS flag, l_partkey, CAST(l_partkey % 400 AS DOUBLE) AS x0, l_suppkey % 60 * 10.0::DOUBLE AS y0,
    CAST(l_partkey % 400 AS DOUBLE) + l_quantity * 4 AS x1, l_suppkey % 60 * 10.0::DOUBLE + 10 + no * 8 AS y1 FROM ln)"""
INTERSECTION = "(greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0.0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / greatest(1.0, least(greatest(0.0, a.x1 - a.x0) * greatest(0.0, a.y1 - a.y0), greatest(0.0, c.x1 - c.x0) * greatest(0.0, c.y1 - c.y0))))"
H_OVERLAP = "(greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) / greatest(1.0, least(a.x1 - a.x0, c.x1 - c.x0)))"
V_OVERLAP = "(greatest(0.0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / greatest(1.0, least(a.y1 - a.y0, c.y1 - c.y0)))"


def sql_shared(a: str, b: str) -> str:
    """Shared area of two boxes over the smaller one, in SQL."""
    return f"(greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) / greatest(1.0, least(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0), ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0))))"


def sql_along(a: str, b: str, lo: str = "y0", hi: str = "y1") -> str:
    return f"(greatest(0.0, least({a}.{hi}, {b}.{hi}) - greatest({a}.{lo}, {b}.{lo})) / greatest(1.0, least({a}.{hi} - {a}.{lo}, {b}.{hi} - {b}.{lo})))"


def document_lines(spark, sf_dir) -> DataFrame:
    """Lines of documents as blocks: doc_id is the source, page the document, 20 points a line."""
    d = read(spark, sf_dir, "documents")
    lines = d.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    y = F.col("i") * 20.0 + 10
    return lines.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.col("i").alias("ordinal"), G.box(F.lit(50), y, F.lit(550), y + 10).alias("bbox"), "text", F.lit(10.0).alias("font_size"), F.lit("text-layer").alias("source"))


def order_grids(spark, sf_dir) -> DataFrame:
    """A grid for each order: a row a line of quantity, flag, status and a date on every other line."""
    line = order_lines(spark, sf_dir)
    cells = F.array(F.col("l_quantity").cast("int").cast("string"), F.nullif(F.col("l_returnflag"), F.lit("N")), F.col("l_linestatus"), F.when(F.col("no") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")))
    return line.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("no", cells.alias("c")))), lambda x: x["c"]).alias("grid"))


CELLS = SQL_LINES + """, g AS (SELECT l_orderkey AS doc_id, no AS row, unnest(range(1, 5)) AS col, unnest([CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), nullif(l_returnflag, 'N'), l_linestatus,
    CASE WHEN no % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END]) AS t FROM ln)"""


def order_tables(spark, sf_dir) -> DataFrame:
    """Orders as tables of their customer's document, a page a month."""
    o = read(spark, sf_dir, "orders")
    page = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    x, y = F.col("o_orderkey") % 50 * 1.0, F.col("o_orderkey") % 7 * 100.0
    cols = (F.col("o_orderkey") % 5 + 2).cast("int")
    return o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("table_id"), page.alias("page"), G.box(x, y, x + 400, y + 90).alias("bbox"), F.lit(800.0).alias("page_height"), G.column_signature(cols).alias("column_signature"), cols.alias("col_count"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("section_hint"), F.lit(False).alias("glossary"), F.lit(None).cast("string").alias("hint_id"), F.array(F.lit("same")).alias("header"), F.lit(None).cast("string").alias("preceding_text"), "o_orderkey", "o_totalprice")


TABLES = """t AS (SELECT o_custkey AS doc_id, 't' || o_orderkey AS table_id, o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) AS page, CAST(o_orderkey % 50 AS DOUBLE) AS x0, o_orderkey % 7 * 100.0::DOUBLE AS y0,
    o_orderkey % 50 + 400.0::DOUBLE AS x1, o_orderkey % 7 * 100.0::DOUBLE + 90 AS y1, o_orderkey % 5 + 2 AS n FROM orders)"""
#: A signature's centres, and the share of the first's near the second's.
SIGNATURE = "list_transform(range(0, {0}), lambda i: round_even((i + 0.5) / {0}, 3))"
SIMILARITY = "(len(list_filter({0}, lambda x: len(list_filter({1}, lambda y: abs(x - y) <= 0.07)) > 0)) / greatest(len({0}), len({1}))::DOUBLE)"


# --- facts --------------------------------------------------------------------------------------------


@query(f"""WITH {PART_FACTS},
    last AS (SELECT module, x.f AS fact, arg_max(x.v, doc_id) AS value FROM facts GROUP BY ALL),
    grid AS (SELECT module, fact FROM (SELECT DISTINCT module FROM last), (SELECT DISTINCT fact FROM last))
    SELECT fact, module, coalesce(value, '') AS value, count(DISTINCT nullif(value, '')) OVER (PARTITION BY fact) <= 1 AS is_consistent FROM grid LEFT JOIN last USING (module, fact)""")
def consistency_rows(spark, sf_dir):
    rows = facts.consistency(part_documents(spark, sf_dir))
    return rows.select("fact", F.explode("module_values").alias("m"), "is_consistent").select("fact", "m.module", "m.value", "is_consistent")


@query("SELECT p_partkey AS doc_id, p_name AS drug_name, p_type AS dosage_form, CAST(p_partkey AS VARCHAR) AS batch_number, p_brand AS manufacturing_site, CAST(p_size AS VARCHAR) AS strength FROM part")
def fact_extract_roundtrip(spark, sf_dir):
    d = part_documents(spark, sf_dir).withColumn("f", T.extract_facts(F.col("text")))
    return d.select("doc_id", *[F.element_at("f", k).alias(k) for k in ("drug_name", "dosage_form", "batch_number", "manufacturing_site", "strength")])


MODULE_FACTS = "f AS (SELECT 'module_' || (o_custkey % 5 + 1) AS module, 'fact_' || (o_orderkey % 97) AS fact, max(o_orderpriority) AS value FROM orders GROUP BY ALL)"


@query(f"WITH {MODULE_FACTS} SELECT f.module, fact, b.value AS expected, f.value AS actual FROM f JOIN (SELECT fact, value FROM f WHERE module = 'module_3') b USING (fact) WHERE f.value <> b.value")
def cross_module_mismatch(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    f = o.groupBy(F.concat(F.lit("module_"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("module"), F.concat(F.lit("fact_"), (F.col("o_orderkey") % 97).cast("string")).alias("fact")).agg(F.max("o_orderpriority").alias("value"))
    return facts.cross_module(f)


def _figure_inputs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("int").alias("idx"), F.concat("source", F.lit(".docx")).alias("filename"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Strength: 5 mg\nBatch No. ： B-7\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"), F.when(F.col("lang") == "en", "word").when(F.col("lang") == "de", "pdf").otherwise("presentation").alias("source_type"), F.when(F.col("doc_id") % 3 == 0, 2).cast("int").alias("page_count"), F.lit(4).alias("n_pages"), F.lit(5).alias("n_slides"), (F.col("doc_id") % 100).cast("int").alias("n_paragraphs"), F.lit(1).alias("n_images"), F.lit(2).alias("n_tables"), F.col("lang").alias("parser_hint"))
    return d, read(spark, sf_dir, "pages"), facts.consistency(part_documents(spark, sf_dir))


@query(f"""WITH {PART_FACTS}, last AS (SELECT module, x.f AS fact, arg_max(x.v, doc_id) AS value FROM facts GROUP BY ALL),
    k AS (SELECT count(*) AS total, count(*) FILTER (n <= 1) AS ok FROM (SELECT fact, count(DISTINCT value) AS n FROM last GROUP BY fact)),
    x AS (SELECT *, doc_id % 4 = 0 AS facts FROM documents), y AS (SELECT * REPLACE (CASE WHEN facts THEN 'Strength: 5 mg' || chr(10) || 'Batch No. ： B-7' || chr(10) || text ELSE text END AS text) FROM x),
    d AS (SELECT count(*) AS n, count(*) FILTER (facts) AS with_facts, sum(length(text)) AS chars, sum(len(regexp_extract_all(text, '\\S+'))) AS tokens, sum(CASE WHEN doc_id % 3 = 0 THEN 2 WHEN lang = 'de' THEN 4 WHEN lang <> 'en' THEN 5
        WHEN doc_id % 100 > 0 THEN greatest(1, round_even((doc_id % 100) / 24.0, 0)) ELSE 0 END) AS pages FROM y)
    SELECT CAST(d.n AS BIGINT) AS parsed_count, CAST(chars AS BIGINT) AS total_characters, CAST(tokens AS BIGINT) AS total_tokens, CAST(d.n AS BIGINT) AS total_images, CAST(2 * d.n AS BIGINT) AS total_tables, CAST(pages AS BIGINT) AS estimated_pages,
        CAST(2 * with_facts AS BIGINT) AS captured_facts, CAST(total AS BIGINT) AS consistency_total, CAST(ok AS BIGINT) AS consistency_passed, (SELECT count(*) FROM pages) AS total_files,
        round(100.0 * d.n / (SELECT count(*) FROM pages), 6) AS parse_success_rate, round(100.0 * ok / total, 6) AS consistency_rate, round(least(100.0, 40.0 * chars / (d.n * 5000) + 35.0 * 2 * with_facts / (5 * d.n) + 25.0 * ok / total), 6) AS quality_score FROM d, k""")
def key_figures(spark, sf_dir):
    got = facts.key_figures(*_figure_inputs(spark, sf_dir))
    whole = ["parsed_count", "total_characters", "total_tokens", "total_images", "total_tables", "estimated_pages", "captured_facts", "consistency_total", "consistency_passed", "total_files"]
    return got.select(*[F.col(c).cast("bigint").alias(c) for c in whole], *[r6(F.col(c)).alias(c) for c in ("parse_success_rate", "consistency_rate", "quality_score")])


@query("SELECT lang AS parser_hint, count(*) AS n FROM documents GROUP BY lang")
def parser_distribution(spark, sf_dir):
    return facts.parser_distribution(_figure_inputs(spark, sf_dir)[0])


@query(f"""WITH {PART_FACTS}, last AS (SELECT module, x.f AS fact, arg_max(x.v, doc_id) AS value FROM facts GROUP BY ALL),
    k AS (SELECT fact, count(DISTINCT value) AS n, row_number() OVER (ORDER BY fact) AS i FROM last GROUP BY fact)
    SELECT 'FIH' AS submission_profile, 'CONSISTENCY-' || lpad(CAST(i AS VARCHAR), 3, '0') AS risk_id, 'medium' AS severity, 'Fact `' || fact || '` has cross-document mismatch' AS reason FROM k WHERE n > 1""")
def compliance_risks(spark, sf_dir):
    d, f, rows = _figure_inputs(spark, sf_dir)
    result = facts.compliance_result(facts.key_figures(d, f, rows), rows, jobs.PROFILE, "completed")
    return result.select("submission_profile", F.explode("risks").alias("r")).select("submission_profile", "r.risk_id", "r.severity", "r.reason")


@query("""SELECT n_nationkey AS rule_id, CASE WHEN r_name IS NULL THEN 'unknown' ELSE r_name || '@' || CAST(r_regionkey AS VARCHAR) END AS anchor, CASE WHEN r_name IS NULL THEN 'No citation found' ELSE lower(r_name) END AS snippet
    FROM nation LEFT JOIN region ON n_nationkey = r_regionkey""")
def rule_citations(spark, sf_dir):
    meta = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rule_id"), F.lit(1).alias("ordinal"), F.col("r_name").alias("source_regulation"), F.col("r_regionkey").cast("string").alias("source_version"), F.lower("r_name").alias("title"))
    return facts.citations(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule_id")), meta)


DOC_RULES = [
    rules.Rule("LEN", "hard", lambda d: rules.outcome(F.length(d["text"]) >= 500, "text is short")),
    rules.Rule("LANG", "soft", lambda d: rules.outcome(d["lang"] == "en", "not in English", "warn")),
    rules.Rule("LINES", "hard", lambda d: rules.outcome(F.size(F.split(d["text"], "\n")) > 1, "one line only")),
]


@query("""WITH r AS (SELECT doc_id, unnest([{'i': 1, 'ok': length(text) >= 500, 'm': 'text is short'}, {'i': 2, 'ok': lang = 'en', 'm': 'not in English'}, {'i': 3, 'ok': contains(text, chr(10)), 'm': 'one line only'}]) AS x FROM documents)
    SELECT doc_id, 'RISK-00' || x.i AS risk_id, 'medium' AS severity, x.m AS reason FROM r WHERE NOT x.ok""")
def rule_risks(spark, sf_dir):
    return rules.risks(rules.run_rules(read(spark, sf_dir, "documents"), DOC_RULES))


@query("SELECT lang AS profile, doc_id FROM documents WHERE lang NOT IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) < (SELECT count(*) / 5 FROM documents))")
def rule_exemptions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("profile"), F.lit("R").alias("rule_id"), "doc_id")
    n = d.agg(F.floor(F.count("*") / 5).alias("fifth"), (F.count("*") / 5).alias("share"))
    rare = d.groupBy("profile", "rule_id").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("k") < F.col("share"))  # one row
    return rules.without_exemptions(d, rare.select("profile", "rule_id")).select("profile", "doc_id")


# --- text ---------------------------------------------------------------------------------------------


@query("SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS tokens, count(*) AS n_docs FROM documents GROUP BY source")
def doc_text_metrics(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.sum(F.length("text")).cast("bigint").alias("chars"), F.sum(T.token_count(F.col("text"))).cast("bigint").alias("tokens"), F.count("*").alias("n_docs"))


SQL_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
SQL_COMPACT = "regexp_replace(lower(" + SQL_CLEAN + "), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


@query(f"""WITH l AS (SELECT source AS doc_id, doc_id AS page, unnest(range(0, len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS text FROM documents),
    m AS (SELECT *, ordinal * 20 + 20 <= 88 OR ordinal * 20 + 10 >= 712 AS band, regexp_replace({SQL_COMPACT.format('text')}, '\\d+', '', 'g') AS sig, {SQL_CLEAN.format('text')} AS t FROM l),
    n AS (SELECT doc_id, sig FROM m WHERE band AND length(sig) >= 3 GROUP BY ALL HAVING count(*) >= 2)
    SELECT doc_id, page, CAST(ordinal AS INTEGER) AS ordinal, text FROM m WHERE NOT (band AND ((length(sig) >= 3 AND (doc_id, sig) IN (SELECT (doc_id, sig) FROM n)) OR regexp_full_match(t, '\\d{{1,4}}(\\s*/\\s*\\d{{1,4}})?')
        OR regexp_full_match(t, '\\d{{1,4}}\\s*-\\s*\\d{{1,4}}') OR regexp_full_match(t, '(?i)[ivxlcdm]+') OR regexp_full_match(t, '\\p{{L}}') OR regexp_full_match(t, '\\p{{L}}{{1,2}}')))""")
def header_footer_filter(spark, sf_dir):
    blocks = document_lines(spark, sf_dir).withColumn("page_height", F.lit(800.0))
    return text_blocks.drop_running(blocks).select("doc_id", "page", "ordinal", "text")


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS i, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l) WHERE p IS NULL OR p <> line""")
def consecutive_line_dedup(spark, sf_dir):
    lines = T.distinct_runs(F.split("text", "\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("i", "line"))


@query("""SELECT doc_id, round(1e-9 + CASE WHEN length(text) = 0 THEN 0.0 ELSE 0.45 * len(regexp_extract_all(text, '[^\\n]')) / length(text) + 0.55 * len(regexp_extract_all(text, '[\\p{L}\\p{N},.:;!?()\\[\\]{}+\\-/_，。；：、（）《》“”‘’！？]')) / length(text) END, 4) AS quality, length(text) = 0 AS is_mojibake FROM documents""")
def quality_mojibake(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.round(T.text_quality(t) + 1e-9, 4).alias("quality"), T.is_mojibake(t).alias("is_mojibake"))


@query("""SELECT page_id, CASE WHEN contains(u, 'm1') OR contains(u, 'module1') THEN 'M1' WHEN contains(u, 'm2') OR contains(u, 'module2') THEN 'M2' WHEN contains(u, 'm3') OR contains(u, 'module3') OR contains(u, '3.2') THEN 'M3'
    WHEN contains(u, 'm4') OR contains(u, 'module4') THEN 'M4' WHEN contains(u, 'm5') OR contains(u, 'module5') THEN 'M5' ELSE 'DOC-' || (page_id + 1) END AS label, regexp_replace(url, '[^\\p{L}\\p{N}_.\\-]', '_', 'g') AS filename FROM (SELECT *, lower(url) AS u FROM pages)""")
def module_file_label(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.module_label(F.col("url"), F.col("page_id")).alias("label"), T.safe_filename(F.col("url")).alias("filename"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents)
    SELECT w AS token, count(*) AS n, CASE WHEN regexp_full_match(w, '[xX]\\d{6,}') THEN 'application_id' WHEN regexp_full_match(w, '\\d{4}') THEN 'sequence_code' WHEN regexp_full_match(w, '\\d{2}') THEN 'short_sequence_code'
        WHEN regexp_full_match(w, '[mM]\\d{1,2}') THEN 'module_code' WHEN lower(w) IN ('cn', 'us', 'eu', 'jp', 'kr', 'au', 'ca', 'uk') THEN 'region_code' WHEN lower(w) IN ('dtd', 'util', 'style') THEN 'folder_key' END AS kind FROM w GROUP BY w""")
def key_token_kinds(spark, sf_dir):
    tokens = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("kind", T.classify_key(F.col("token")))


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), s AS (SELECT doc_id, trim(t) AS t FROM l)"


@query(f"""WITH {LINES}, w AS (SELECT doc_id, least(1.0, CASE WHEN regexp_matches(t, '^\\s*(?:\\d+\\.\\s+|[（(]?\\d+[)）])') THEN 0.75 ELSE 0.0 END + CASE WHEN regexp_matches(t, '(?i)\\bV\\d+(?:\\.\\d+){{1,3}}\\b') THEN 0.45 ELSE 0.0 END
        + CASE WHEN contains(lower(t), 'ich') THEN 0.35 ELSE 0.0 END + CASE WHEN regexp_matches(lower(t), 'specification|document|technical|change request') THEN 0.25 ELSE 0.0 END) AS ref,
        CASE WHEN regexp_matches(t, '[.·…]{{4,}}\\s*\\d{{1,3}}\\s*$') OR regexp_matches(t, '^\\s*\\d+(?:\\.\\d+){{1,4}}\\s+\\S+\\s+\\d{{1,3}}\\s*$') THEN 1.0 ELSE 0.0 END AS toc, t FROM s)
    SELECT doc_id, round(avg(toc), 6) AS toc_ratio, round(coalesce(sum(ref) FILTER (t <> '') / nullif(count(*) FILTER (t <> ''), 0), 0.0), 6) AS reference_ratio FROM w GROUP BY doc_id""")
def contents_reference_ratio(spark, sf_dir):
    lines = F.split("text", "\n")
    return read(spark, sf_dir, "documents").select("doc_id", r6(tables.contents_ratio(lines)).alias("toc_ratio"), r6(tables.reference_ratio(lines)).alias("reference_ratio"))


@query()
def preview_texts(spark, sf_dir):
    lines = read(spark, sf_dir, "pages").select("page_id", T.preview_lines(F.col("html")).alias("lines"))
    return lines.select("page_id", T.preview(F.col("lines")).alias("preview"))


@query("""WITH l AS (SELECT page_id, unnest(range(0, len(string_split(html, chr(10))))) AS i, unnest(string_split(html, chr(10))) AS line FROM pages)
    SELECT page_id, '/raw[' || i || ']' AS pointer, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM l WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''""")
def raw_xml_fallback(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit(".xml").alias("suffix"), F.encode("html", "UTF-8").alias("content"))
    units = files.decode(p).select("path", F.explode("units").alias("u"))
    return units.select(F.col("path").cast("bigint").alias("page_id"), "u.pointer", "u.text")


# --- boxes --------------------------------------------------------------------------------------------


@query(f"""WITH {BOXES} SELECT a.doc_id, a.o AS left_no, c.o AS right_no, round({INTERSECTION}, 6) AS shared, round({H_OVERLAP}, 6) AS across, round({V_OVERLAP}, 6) AS along,
    round(greatest(0.0, a.x1 - a.x0) * greatest(0.0, a.y1 - a.y0), 6) AS area, round((greatest(a.x1, c.x1) - least(a.x0, c.x0)) * (greatest(a.y1, c.y1) - least(a.y0, c.y0)), 6) AS union_area FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.o + 1 = c.o""")
def box_ratios(spark, sf_dir):
    b = line_boxes(spark, sf_dir)
    a, c = b.alias("a"), b.alias("c")
    both = a.join(c, (F.col("a.doc_id") == F.col("c.doc_id")) & (F.col("a.ordinal") + 1 == F.col("c.ordinal")))
    p, q = F.col("a.bbox"), F.col("c.bbox")
    return both.select("a.doc_id", F.col("a.ordinal").cast("bigint").alias("left_no"), F.col("c.ordinal").cast("bigint").alias("right_no"), r6(G.intersection_ratio(p, q)).alias("shared"), r6(G.horizontal_overlap(p, q)).alias("across"), r6(G.vertical_overlap(p, q)).alias("along"), r6(G.area(p)).alias("area"), r6(G.area(G.union(p, q))).alias("union_area"))


@query(f"""WITH {BOXES} SELECT a.doc_id, a.o AS ordinal FROM b a WHERE a.flag <> 'R' AND NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = a.doc_id AND c.flag = 'R' AND ({INTERSECTION} >= 0.42
    OR ((a.x0 + a.x1) / 2 BETWEEN c.x0 AND c.x1 AND (a.y0 + a.y1) / 2 BETWEEN c.y0 AND c.y1 AND {INTERSECTION} >= 0.2)))""")
def table_text_suppression(spark, sf_dir):
    b = line_boxes(spark, sf_dir)
    return text_blocks.drop_table_text(b.where("l_returnflag <> 'R'"), b.where("l_returnflag = 'R'")).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"))


@query(f"""WITH {BOXES}, t AS (SELECT b.*, p_name AS text FROM b JOIN part ON p_partkey = l_partkey WHERE flag <> 'R'),
    m AS (SELECT a.doc_id, a.o, c.text, row_number() OVER (PARTITION BY a.doc_id, a.o ORDER BY NOT regexp_matches(lower(regexp_replace(c.text, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')), 'figure|fig|图|表|chart|illustration'), abs(c.y0 - a.y1), c.y0 < a.y1, c.o) AS k
        FROM b a JOIN t c ON a.doc_id = c.doc_id AND a.flag = 'R' AND {H_OVERLAP} >= 0.15 WHERE NOT (c.y1 <= 110 OR c.y0 >= 890) OR NOT ((c.y1 - c.y0 <= 35 AND length(regexp_replace(c.text, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) <= 3)))
    SELECT b.doc_id, b.o AS ordinal, 'Figure ' || row_number() OVER (PARTITION BY b.doc_id ORDER BY b.o) AS figure_ref, coalesce(m.text, '') AS title FROM b LEFT JOIN m ON m.doc_id = b.doc_id AND m.o = b.o AND k = 1 WHERE flag = 'R'""")
def figure_titles(spark, sf_dir):
    b = line_boxes(spark, sf_dir)
    img = b.where("l_returnflag = 'R'").withColumn("image_id", F.concat(F.lit("i"), F.col("ordinal").cast("string")))
    text = b.where("l_returnflag <> 'R'").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text")), "l_partkey")
    pages = b.select("doc_id", "page", F.lit(1000.0).alias("height")).distinct()
    return images.figure_titles(img.select("doc_id", "page", "ordinal", "image_id", "bbox"), text, pages).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "figure_ref", "title")


@query(f"""WITH RECURSIVE {BOXES}, w AS (SELECT b.doc_id, x0, y0, x1, y1, p_name AS t, regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS c, row_number() OVER (PARTITION BY b.doc_id ORDER BY y0, x0, o) AS i, count(*) OVER (PARTITION BY b.doc_id) AS n FROM b JOIN part ON p_partkey = l_partkey),
    tol AS (SELECT doc_id, greatest(2.5, median(greatest(1.0, y1 - y0)) * 0.45) AS tol FROM w GROUP BY doc_id),
    m AS (SELECT doc_id, i, n, 0 AS k, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 't': t, 'c': c}} AS a FROM w WHERE i = 1
        UNION ALL SELECT m.doc_id, w.i, m.n, CASE WHEN g.joins THEN m.k ELSE m.k + 1 END, CASE WHEN g.joins THEN {{'x0': least(m.a.x0, w.x0), 'y0': least(m.a.y0, w.y0), 'x1': greatest(m.a.x1, w.x1), 'y1': greatest(m.a.y1, w.y1), 't': m.a.t || ' ' || w.t, 'c': m.a.c || w.c}} ELSE {{'x0': w.x0, 'y0': w.y0, 'x1': w.x1, 'y1': w.y1, 't': w.t, 'c': w.c}} END
        FROM m JOIN w ON w.doc_id = m.doc_id AND w.i = m.i + 1 JOIN tol ON tol.doc_id = w.doc_id, LATERAL (SELECT length(m.a.t) <= 64 AND length(w.t) <= 64 AND (abs((m.a.y0 + m.a.y1 - w.y0 - w.y1) / 2) <= tol OR {sql_along('m.a', 'w')} >= 0.6)
            AND (w.x0 - m.a.x1 >= -2.5 OR ({sql_along('m.a', 'w')} >= 0.6 AND {sql_along('m.a', 'w', 'x0', 'x1')} >= 0.18)) AND w.x0 - m.a.x1 <= greatest(27.0, least(greatest(1.0, m.a.y1 - m.a.y0), greatest(1.0, w.y1 - w.y0)) * 2.4) AS joins) g),
    one AS (SELECT doc_id, n, arg_max(a, i) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY arg_max(a, i).y0, arg_max(a, i).x0, k) AS i, count(*) OVER (PARTITION BY doc_id) AS blocks FROM m GROUP BY doc_id, n, k),
    d AS (SELECT doc_id, i, [a] AS kept FROM one WHERE i = 1
        UNION ALL SELECT d.doc_id, one.i, CASE WHEN h.slot IS NULL THEN list_append(d.kept, one.a) ELSE list_transform(d.kept, lambda q, j: CASE WHEN j = h.slot AND length(one.a.c) > length(q.c) THEN one.a ELSE q END) END
        FROM d JOIN one ON one.doc_id = d.doc_id AND one.i = d.i + 1, LATERAL (SELECT list_min(list_filter(list_transform(d.kept, lambda q, j: CASE WHEN {sql_shared('one.a', 'q')} >= 0.72 AND (contains(q.c, one.a.c) OR contains(one.a.c, q.c)) THEN j END), lambda z: z IS NOT NULL)) AS slot) h),
    e AS (SELECT d.doc_id, unnest(kept) AS a, unnest(range(1, len(kept) + 1)) AS i FROM d JOIN one ON one.doc_id = d.doc_id AND one.i = d.i WHERE d.i = blocks),
    z AS (SELECT doc_id, i, [a] AS kept FROM e WHERE i = 1
        UNION ALL SELECT z.doc_id, e.i, CASE WHEN h.slot IS NULL THEN list_append(z.kept, e.a) ELSE list_transform(z.kept, lambda q, j: CASE WHEN j = h.slot THEN
            {{'x0': CASE WHEN e.a.y1 - e.a.y0 < (q.y1 - q.y0) * 0.85 THEN e.a.x0 ELSE q.x0 END, 'y0': CASE WHEN e.a.y1 - e.a.y0 < (q.y1 - q.y0) * 0.85 THEN e.a.y0 ELSE q.y0 END, 'x1': CASE WHEN e.a.y1 - e.a.y0 < (q.y1 - q.y0) * 0.85 THEN e.a.x1 ELSE q.x1 END, 'y1': CASE WHEN e.a.y1 - e.a.y0 < (q.y1 - q.y0) * 0.85 THEN e.a.y1 ELSE q.y1 END, 't': CASE WHEN length(e.a.t) > length(q.t) THEN e.a.t ELSE q.t END, 'c': q.c}} ELSE q END) END
        FROM z JOIN e ON e.doc_id = z.doc_id AND e.i = z.i + 1, LATERAL (SELECT list_min(list_filter(list_transform(z.kept, lambda q, j: CASE WHEN q.c = e.a.c AND {sql_along('q', 'e.a')} >= 0.6 THEN j END), lambda v: v IS NOT NULL)) AS slot) h),
    last AS (SELECT doc_id, max(i) AS i FROM e GROUP BY doc_id), size AS (SELECT DISTINCT doc_id, n FROM w)
    SELECT doc_id, 1 AS page, printf('txt_p1_%03d', k) AS block_id, q.t AS text, CAST(n - m AS INTEGER) AS n_merged FROM (SELECT z.doc_id, unnest(kept) AS q, unnest(range(1, len(kept) + 1)) AS k, len(kept) AS m FROM z JOIN last USING (doc_id, i)) JOIN size USING (doc_id)""")
def merged_text_blocks(spark, sf_dir):
    b = line_boxes(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text")), "l_partkey")
    pages = b.select("doc_id", "page", F.lit(600.0).alias("width")).distinct()
    made = text_blocks.merge_blocks(b.select("doc_id", "page", "ordinal", "bbox", "text", F.lit(10.0).alias("font_size"), F.lit("text-layer").alias("source")), pages)
    return made.select("doc_id", "page", "block_id", "text", "n_merged")


@query(f"""WITH RECURSIVE {BOXES}, i AS (SELECT doc_id, x0, y0, x1, y1, row_number() OVER (PARTITION BY doc_id ORDER BY (x1 - x0) * (y1 - y0) DESC, o DESC) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM b),
    f AS (SELECT doc_id, k, n, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM i WHERE k = 1
        UNION ALL SELECT f.doc_id, i.k, f.n, CASE WHEN len(list_filter(f.kept, lambda q: {sql_shared('q', 'i')} >= 0.9 AND greatest(1.0, (q.x1 - q.x0) * (q.y1 - q.y0), (i.x1 - i.x0) * (i.y1 - i.y0)) / greatest(1.0, least((q.x1 - q.x0) * (q.y1 - q.y0), (i.x1 - i.x0) * (i.y1 - i.y0))) <= 1.4
            AND abs(q.x0 + q.x1 - i.x0 - i.x1) / 2 + abs(q.y0 + q.y1 - i.y0 - i.y1) / 2 <= 12)) > 0 THEN f.kept ELSE list_append(f.kept, {{'x0': i.x0, 'y0': i.y0, 'x1': i.x1, 'y1': i.y1}}) END FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k + 1),
    l AS (SELECT doc_id, unnest(kept) AS q, unnest(range(0, len(kept))) AS j, n - len(kept) AS gone FROM f WHERE k = n)
    SELECT doc_id, printf('img_p1_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY q.y0, q.x0, j)) AS image_id, CAST(gone AS INTEGER) AS n_removed FROM l""")
def deduplicated_images(spark, sf_dir):
    b = line_boxes(spark, sf_dir).withColumn("image_id", F.format_string("img_p1_%03d", "ordinal"))
    return images.dedup_images(b.select("doc_id", "page", "image_id", "bbox")).select("doc_id", "image_id", "n_removed")


@query(f"""WITH {SQL_LINES}, w AS (SELECT l_orderkey AS doc_id, no AS o, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_suppkey % 6 * 7 AS DOUBLE) AS y0, l_suppkey % 6 * 7 + 10.0 AS y1, 'w' || l_partkey AS t FROM ln),
    m AS (SELECT *, (y0 + y1) / 2 AS yc, abs((y0 + y1) / 2 - lag((y0 + y1) / 2) OVER (PARTITION BY doc_id ORDER BY (y0 + y1) / 2, x0, o)) > 4.8 AS fresh FROM w),
    n AS (SELECT *, sum(coalesce(CAST(fresh AS INTEGER), 0)) OVER (PARTITION BY doc_id ORDER BY yc, x0, o ROWS UNBOUNDED PRECEDING) AS line FROM m),
    l AS (SELECT doc_id, line, string_agg(t, ' ' ORDER BY x0, o) AS t FROM n GROUP BY ALL) SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY doc_id""")
def words_to_lines(spark, sf_dir):
    line = order_lines(spark, sf_dir)
    x, y = F.col("l_partkey") % 400 * 1.0, F.col("l_suppkey") % 6 * 7.0
    w = line.select(F.col("l_orderkey").alias("doc_id"), F.col("no").alias("ordinal"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 10).alias("y1"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"))
    return words.lines_of_words(w, ["doc_id"])


# --- grids and tables ---------------------------------------------------------------------------------


@query(f"""WITH {CELLS}, n AS (SELECT doc_id, count(*) AS slots, count(t) AS filled, count(DISTINCT row) AS rows, count(*) FILTER (regexp_matches(t, '\\d')) AS digits FROM g GROUP BY doc_id)
    SELECT doc_id, round(least(1.0, 0.4 * filled / slots + 0.35 + 0.25 * digits / greatest(1, filled)), 6) AS structure_score, round(least(1.0, 0.45 * filled / slots + 0.35 + 0.2 * digits / greatest(1, filled)), 6) AS emitted_score FROM n""")
def grid_scores(spark, sf_dir):
    g = order_grids(spark, sf_dir).withColumn("cells", C.cells_of(F.col("grid")))
    n = tables.counts(F.col("grid"), F.col("cells"))
    rows = F.size("grid")
    slots = rows * 4
    return g.select("doc_id", r6(tables.structure_score(n["filled"], slots, n["aligned"], rows, n["digits"])).alias("structure_score"), r6(tables.emitted_score(n["filled"], slots, n["aligned"], rows, n["digits"], F.size("cells"))).alias("emitted_score"))


@query(f"WITH {CELLS} SELECT doc_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, t AS text FROM g WHERE t IS NOT NULL")
def grid_cells(spark, sf_dir):
    return order_grids(spark, sf_dir).select("doc_id", F.explode(C.cells_of(F.col("grid"))).alias("c")).select("doc_id", "c.*")


@query(f"WITH {CELLS} SELECT doc_id, string_agg(line, chr(10) ORDER BY row) AS text FROM (SELECT doc_id, row, string_agg(coalesce(t, 'null'), ' | ' ORDER BY col) AS line FROM g GROUP BY ALL) GROUP BY doc_id")
def grid_row_texts(spark, sf_dir):
    return order_grids(spark, sf_dir).select("doc_id", F.array_join(T.row_texts(F.col("grid")), "\n").alias("text"))


@query(f"""WITH {CELLS} SELECT doc_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CASE WHEN row <= 1 THEN 'HEADER' ELSE 'DATA' END AS state FROM g WHERE t IS NOT NULL""")
def cell_states(spark, sf_dir):
    cells = order_grids(spark, sf_dir).select("doc_id", F.explode(C.cells_of(F.col("grid"))).alias("c"))
    return cells.select("doc_id", "c.row", "c.col", tables.cell_state(F.col("c.text"), F.col("c.row"), F.lit(0))["state"].alias("state"))


@query(f"""WITH {CELLS}, f AS (SELECT doc_id, col, count(DISTINCT row) AS k FROM g WHERE t IS NOT NULL GROUP BY ALL), r AS (SELECT doc_id, max(k) AS widest FROM (SELECT doc_id, row, count(t) AS k FROM g GROUP BY ALL) GROUP BY doc_id),
    u AS (SELECT doc_id, count(*) FILTER (p IS NULL OR col > p + 1) AS runs FROM (SELECT *, lag(col) OVER (PARTITION BY doc_id ORDER BY col) AS p FROM f) GROUP BY doc_id)
    SELECT doc_id, CAST(CASE WHEN runs = widest OR runs >= 2 THEN runs ELSE greatest(widest, 1) END AS INTEGER) AS col_count, CASE WHEN runs = widest OR runs >= 2 THEN 'content_clusters' ELSE 'max_content_cols' END AS strategy FROM u JOIN r USING (doc_id)""")
def logical_columns(spark, sf_dir):
    g = order_grids(spark, sf_dir).withColumn("p", F.transform("grid", lambda r: G.filled(r)))
    n = tables.column_count(F.col("p"), F.lit(4), F.lit(None).cast("int"))
    return g.select("doc_id", n.alias("n")).select("doc_id", F.col("n.n").alias("col_count"), "n.strategy")


@query(f"""WITH n AS (SELECT DISTINCT p_size % 12 + 1 AS n FROM part), s AS (SELECT n, {SIGNATURE.format('n')} AS sig FROM n)
    SELECT CAST(a.n AS INTEGER) AS a, CAST(b.n AS INTEGER) AS b, round({SIMILARITY.format('a.sig', 'b.sig')}, 6) AS similarity FROM s a, s b""")
def signature_similarity(spark, sf_dir):
    n = read(spark, sf_dir, "part").select((F.col("p_size") % 12 + 1).cast("int").alias("a")).distinct()
    pairs = n.select("a", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("b")).join(n.select(F.col("a").alias("b")), "b", "left_semi")  # 12 counts at most
    return pairs.select("a", "b", r6(G.column_similarity(G.column_signature(F.col("a")), G.column_signature(F.col("b")))).alias("similarity"))


@query(f"""WITH {TABLES}, o AS (SELECT *, row_number() OVER w AS seq, lag(table_id) OVER w AS p_id, lag(page) OVER w AS p_page, lag(y1) OVER w AS p_y1, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, lag(n) OVER w AS p_n FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page, y0, table_id)),
    k AS (SELECT *, greatest(0.0, least(x1, p_x1) - greatest(x0, p_x0)) / 400.0 AS over, {SIGNATURE.format('p_n')} AS ps, {SIGNATURE.format('n')} AS cs FROM o WHERE p_page + 1 = page),
    s AS (SELECT *, {SIMILARITY.format('ps', 'cs')} AS sim FROM k)
    SELECT doc_id, table_id, p_id AS continued_from, round_even(sim, 3) AS similarity, round_even(over, 3) AS overlap FROM s
    WHERE over >= 0.35 AND sim >= 0.28 AND ((p_y1 >= 576 AND y0 <= 224) OR sim >= 0.82) AND NOT (sim < 0.5 AND over < 0.55)""")
def stitched_tables(spark, sf_dir):
    linked = stitch.stitch(order_tables(spark, sf_dir)).where("continued_from IS NOT NULL")
    return linked.select("doc_id", "table_id", "continued_from", "similarity", "overlap")


@query(f"""WITH {TABLES}, c AS (SELECT a.doc_id, a.table_id, c.n, c.o_orderkey, row_number() OVER (PARTITION BY a.doc_id, a.table_id ORDER BY c.o_orderkey DESC) AS k FROM t a JOIN t c ON c.doc_id = a.doc_id AND c.page + 1 = a.page
        WHERE c.y1 >= 576 OR (a.y0 <= 224 AND greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) / 400.0 >= 0.5))
    SELECT t.doc_id, t.table_id, CAST(c.n AS INTEGER) AS parent_cols FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.table_id = t.table_id AND k = 1""")
def parent_tables(spark, sf_dir):
    t = order_tables(spark, sf_dir).withColumn("ordinal", F.col("o_orderkey")).withColumn("near_top", F.col("bbox")[1] <= 224).withColumn("near_bottom", F.col("bbox")[3] >= 576)
    return tables.parents(t, t).select("doc_id", "table_id", "parent_cols")


@query(f"WITH {TABLES} SELECT doc_id, table_id AS old_id, 'tbl_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, o_orderkey) AS VARCHAR), 3, '0') AS table_id FROM t")
def renumbered_tables(spark, sf_dir):
    t = order_tables(spark, sf_dir).withColumn("old_id", F.col("table_id"))
    return stitch.renumber(t, ["page", F.col("bbox")[1], "o_orderkey"]).select("doc_id", "old_id", "table_id")


VALID = """SELECT o_orderkey, o_orderkey % 9 AS r, o_orderkey % 5 + 1 AS c, (o_orderkey % 101) / 100.0::DOUBLE AS s, o_orderkey % 3 = 0 AS titled, o_orderkey % 4 = 0 AS hinted, o_orderkey % 7 = 0 AS goes, o_orderkey % 13 = 0 AS toc, (o_orderkey % 11) / 10.0::DOUBLE AS lines, (o_orderkey % 17) / 40.0::DOUBLE AS ct, (o_orderkey % 19) / 20.0::DOUBLE AS rf FROM orders"""


@query(f"""SELECT o_orderkey, CASE WHEN toc OR ct >= 0.38 THEN false WHEN NOT titled AND NOT goes AND rf >= 0.75 THEN false WHEN NOT titled AND NOT goes AND NOT hinted AND lines < 0.3 AND rf >= 0.42 THEN false
    WHEN NOT titled AND NOT goes AND lines < 0.2 AND c >= 4 AND r <= 8 AND rf >= 0.25 THEN false WHEN titled AND c = 1 THEN r >= 4 AND s >= 0.15 WHEN titled THEN s >= 0.25 AND r >= 2 AND c >= 2
    WHEN goes AND r >= 2 AND c >= 2 AND s >= 0.15 THEN true WHEN goes AND r >= 3 AND c >= 2 THEN s >= 0.12 WHEN goes THEN r >= 4 AND s >= 0.15 WHEN hinted THEN r >= 4 AND c >= 2 AND s >= 0.55
    WHEN lines >= 0.45 THEN r >= 4 AND c >= 2 AND s >= 0.56 ELSE (r >= 5 AND c >= 3 AND s >= 0.85 AND ct <= 0.15) OR (r >= 6 AND c >= 2 AND s >= 0.85 AND ct <= 0.1) OR (r >= 4 AND c >= 2 AND s >= 0.7 AND ct <= 0.2) END AS is_valid FROM ({VALID})""")
def table_validity(spark, sf_dir):
    k = F.col("o_orderkey")
    flag = lambda n: k % n == 0
    text = lambda n: F.when(flag(n), "参数表")
    ok = tables.is_valid(k % 9, k % 5 + 1, k % 101 / 100.0, text(3), text(4), flag(7), F.lit(False), flag(13), k % 11 / 10.0, k % 17 / 40.0, k % 19 / 20.0)
    return read(spark, sf_dir, "orders").select("o_orderkey", ok.alias("is_valid"))


@query(f"""WITH v AS (SELECT *, 0.6 + o_orderkey % 4 / 10.0 AS idc, (o_orderkey % 23) / 22.0::DOUBLE AS sim, (o_orderkey % 29) / 28.0::DOUBLE AS fl FROM ({VALID})),
    x AS (SELECT *, list_filter([idc, s, CASE WHEN goes AND sim >= 0.5 THEN sim END, CASE WHEN hinted THEN 0.8 END, fl], lambda z: z IS NOT NULL) AS fs, (CASE WHEN idc < 0.6 THEN 1 ELSE 0 END) + (CASE WHEN s < 0.3 THEN 1 ELSE 0 END) + (CASE WHEN goes AND sim < 0.5 THEN 1 ELSE 0 END) + (CASE WHEN fl < 0.3 THEN 1 ELSE 0 END) + (CASE WHEN toc OR ct >= 0.38 THEN 1 ELSE 0 END) AS flags FROM v)
    SELECT o_orderkey, round(least(1.0, list_sum(fs) / len(fs)), 6) AS confidence, CAST(flags AS INTEGER) AS n_flags, flags >= 2 OR list_sum(fs) / len(fs) < 0.5 OR s < 0.3 OR (goes AND sim < 0.5) OR toc OR ct >= 0.38 AS review_required FROM x""")
def table_confidence(spark, sf_dir):
    k = F.col("o_orderkey")
    flag = lambda n: k % n == 0
    c = tables.confidence(0.6 + k % 4 / 10.0, k % 101 / 100.0, flag(7), k % 23 / 22.0, flag(4), k % 29 / 28.0, F.lit(True), flag(13), k % 17 / 40.0)
    return read(spark, sf_dir, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", r6(F.col("c.confidence")).alias("confidence"), F.size("c.risk_flags").alias("n_flags"), "c.review_required")


@query("""WITH t AS (SELECT o_custkey AS doc_id, (o_orderkey % 101) / 100.0::DOUBLE AS c, o_orderkey % 5 = 0 AS v, o_orderkey % 3 = 0 AS k FROM orders)
    SELECT doc_id, count(*) AS n_tables, round_even(min(c), 3) AS min_confidence, round_even(max(c), 3) AS max_confidence, count(*) FILTER (v) AS n_review, count(*) FILTER (k) AS n_continued, count(*) FILTER (c < 0.75) AS n_low_confidence FROM t GROUP BY doc_id""")
def regression_records(spark, sf_dir):
    k = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (k % 101 / 100.0).alias("confidence"), (k % 5 == 0).alias("review_required"), (k % 3 == 0).alias("is_continuation"))
    return jobs.record(t).drop("avg_confidence")


@query("SELECT count(*) AS documents, CAST(sum(c) AS BIGINT) AS raw_tables, CAST(sum(a) AS BIGINT) AS accepted_tables, round_even(sum(a) / sum(c)::DOUBLE, 4) AS acceptance_rate FROM (SELECT o_custkey, count(*) AS c, count(*) FILTER (o_orderkey % 3 > 0) AS a FROM orders GROUP BY o_custkey)")
def regression_summary(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return jobs.summary(o.groupBy("o_custkey").agg(F.count("*").alias("raw_tables"), F.count_if(F.col("o_orderkey") % 3 > 0).alias("accepted_tables")))


@query(f"""WITH {BOXES}, v AS (SELECT doc_id, (x0 + x1) / 2 AS x FROM b WHERE flag <> 'R'), g AS (SELECT doc_id, x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) AS gap FROM v),
    m AS (SELECT doc_id, avg(gap) AS mean, stddev_pop(gap) AS sd FROM g GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (flag = 'R') AS h FROM b GROUP BY doc_id)
    SELECT doc_id, round(0.6 * least(1.0, lines / 10.0) + 0.4 * CASE WHEN h = 0 OR mean IS NULL OR mean <= 0 THEN 0 ELSE greatest(0.0, 1 - sd / mean) END, 6) AS score FROM n LEFT JOIN m USING (doc_id)""")
def drawing_grid_score(spark, sf_dir):
    b = line_boxes(spark, sf_dir)
    xs = F.collect_list(F.when(F.col("l_returnflag") != "R", G.x_center(F.col("bbox"))))
    hs = F.collect_list(F.when(F.col("l_returnflag") == "R", G.y_center(F.col("bbox"))))
    return b.groupBy("doc_id").agg(hs.alias("h"), xs.alias("v")).select("doc_id", r6(tables.grid_score(F.col("h"), F.col("v"), F.lit(1.0))).alias("score"))


@query(f"""WITH RECURSIVE {TABLES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, table_id) AS i FROM t),
    f AS (SELECT doc_id, page, i, table_id, 1 AS k, x0, y0, x1, y1, 1 AS rows, n FROM o WHERE i = 1
        UNION ALL SELECT o.doc_id, o.page, o.i, o.table_id, CASE WHEN g.joins THEN f.k ELSE f.k + 1 END, CASE WHEN g.joins THEN least(f.x0, o.x0) ELSE o.x0 END, CASE WHEN g.joins THEN f.y0 ELSE o.y0 END, CASE WHEN g.joins THEN greatest(f.x1, o.x1) ELSE o.x1 END, CASE WHEN g.joins THEN greatest(f.y1, o.y1) ELSE o.y1 END, CASE WHEN g.joins THEN f.rows + 1 ELSE 1 END, CASE WHEN g.joins THEN f.n ELSE o.n END
        FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.i = f.i + 1, LATERAL (SELECT (o.y0 - f.y1) / ((f.y1 - f.y0) / f.rows) BETWEEN -0.1 AND 0.35 AND greatest(0.0, least(f.x1, o.x1) - greatest(f.x0, o.x0)) / least(f.x1 - f.x0, o.x1 - o.x0) >= 0.5 AND {SIMILARITY.format(SIGNATURE.format('f.n'), SIGNATURE.format('o.n'))} >= 0.68 AS joins) g)
    SELECT doc_id, page, table_id, CAST(rows AS INTEGER) AS row_count, CAST(sum(rows - 1) OVER (PARTITION BY doc_id, page) AS INTEGER) AS n_merged, coalesce(merged, '') AS merged_from FROM (SELECT doc_id, page, k, arg_min(table_id, i) AS table_id, count(*) AS rows, string_agg(CASE WHEN i > low THEN table_id END, ',' ORDER BY i) AS merged FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, page, k) AS low FROM f) GROUP BY doc_id, page, k)""")
def merged_fragments(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    grid = F.array(F.array(F.lit("a"), F.lit("b")))
    more = t.select("doc_id", "page", "table_id", "bbox", F.lit(1).alias("row_count"), "col_count", "column_signature", "header", "title", "preceding_text", F.lit(None).cast("array<double>").alias("preceding_bbox"), F.lit(0.0).alias("toc_row_ratio"), F.lit(0.5).alias("structure_score"), F.lit(False).alias("near_top"), F.lit(False).alias("near_bottom"), grid.alias("grid"), C.cells_of(grid).alias("cells"))
    return stitch.merge_same_page(more).select("doc_id", "page", "table_id", "row_count", "n_merged", F.array_join("merged_from", ",").alias("merged_from"))


@query(f"""WITH {SQL_LINES}, r AS (SELECT l_orderkey AS doc_id, no AS n, CASE WHEN no % 2 = 1 THEN 'us-' WHEN no % 4 = 2 THEN 'form' || l_partkey || '.xml' ELSE 'x' || l_partkey || '.pdf' END AS f FROM ln),
    s AS (SELECT *, lead(f) OVER w AS nx, lag(f) OVER w AS pv, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id) AS k, sum(CASE WHEN f LIKE '%.%' THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id) AS score FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY n))
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, CASE WHEN k >= 3 AND f = 'us-' AND nx LIKE '%.%' THEN f || nx WHEN k >= 3 AND f LIKE '%.%' AND pv = 'us-' THEN NULL ELSE f END AS name FROM s""")
def filename_repairs(spark, sf_dir):
    line, n = order_lines(spark, sf_dir), F.col("no")
    part = F.col("l_partkey").cast("string")
    name = F.when(n % 2 == 1, "us-").when(n % 4 == 2, F.concat(F.lit("form"), part, F.lit(".xml"))).otherwise(F.concat(F.lit("x"), part, F.lit(".pdf")))
    grids = line.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("no", name.alias("f")))), lambda x: F.array(x["f"], F.lit(None).cast("string"))).alias("grid"))
    fixed = repairs.merge_filenames(F.col("grid"), F.lit(2))
    return grids.select("doc_id", F.posexplode(fixed).alias("i", "r")).select("doc_id", "i", F.get("r", F.lit(0)).alias("name"))


@query(f"""WITH {SQL_LINES}, r AS (SELECT l_orderkey AS doc_id, no AS n, CASE WHEN l_returnflag = 'N' THEN 'note ' || l_partkey ELSE strftime(l_shipdate, '%d-%b-%y') || ' lot ' || l_partkey END AS t, l_returnflag <> 'N' AS dated FROM ln),
    k AS (SELECT *, count(*) FILTER (dated) OVER (PARTITION BY doc_id) >= 3 AS go, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM r)
    SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN go AND dated THEN split_part(t, ' ', 1) END AS date, CASE WHEN go AND dated THEN 'lot ' || split_part(t, ' ', 3) ELSE t END AS rest FROM k""")
def date_splits(spark, sf_dir):
    line = order_lines(spark, sf_dir)
    part = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("note "), part)).otherwise(F.concat(F.date_format("l_shipdate", "dd-MMM-yy"), F.lit(" lot "), part))
    body = F.transform(F.array_sort(F.collect_list(F.struct("no", text.alias("t")))), lambda x: F.array(F.lit(None).cast("string"), x["t"]))
    grids = line.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.array(F.array(F.lit(None).cast("string"), F.lit("Event"))), body).alias("grid"))
    return grids.select("doc_id", F.posexplode(stitch.split_dates(F.col("grid"))).alias("i", "r")).where("i > 0").select("doc_id", "i", F.get("r", F.lit(0)).alias("date"), F.get("r", F.lit(1)).alias("rest"))


# --- jobs and streams ---------------------------------------------------------------------------------


@query("""WITH f AS (SELECT user_id AS job_id, value > 20 AS ok FROM events), n AS (SELECT job_id, count(*) AS total, count(*) FILTER (NOT ok) AS failed FROM f GROUP BY job_id)
    SELECT job_id, total, failed, 100 AS progress, CASE WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM n""")
def job_statuses(spark, sf_dir):
    return jobs.job_status(read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.col("value") > 20).alias("ok")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' | ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' | ' || event_type || ' ' || user_id AS line FROM events")
def event_log_stream(spark, sf_dir):
    """The events as a stream (every file there is, once) into an append-only log, read back."""
    batch = read(spark, sf_dir, "events")
    root = f"{shared_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/event[s].parquet")
    intake.append_log(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT doc_id, line FROM (SELECT doc_id, '| ' || source || '.docx | ' || CASE WHEN lang = 'en' THEN 'WORD' WHEN lang = 'de' THEN 'PDF' ELSE 'PRESENTATION' END || ' | ' || CAST(CASE WHEN doc_id % 3 = 0 THEN 2 WHEN lang = 'de' THEN 4 WHEN lang <> 'en' THEN 5 WHEN doc_id % 100 > 0 THEN greatest(1, CAST(round_even((doc_id % 100) / 24.0, 0) AS INTEGER)) ELSE 0 END AS VARCHAR) || ' | 1 | 2 | ' || length(text) + CASE WHEN doc_id % 4 = 0 THEN 31 ELSE 0 END || ' | ' || lang || ' |' AS line FROM documents)")
def inventory_markdown(spark, sf_dir):
    d = _figure_inputs(spark, sf_dir)[0]
    return jobs.inventory_lines(d).select(F.col("idx").cast("bigint").alias("doc_id"), "line")


@query("SELECT source AS doc_id, doc_id AS page, CAST(len(string_split(text, chr(10))) AS BIGINT) AS block_count, text FROM documents")
def page_texts(spark, sf_dir):
    return jobs.page_texts(document_lines(spark, sf_dir))


@query("WITH w AS (SELECT user_id AS doc_id, count(*) AS n, count(*) FILTER (value < 48.5) AS l, count(*) FILTER (value > 51.5) AS r, count(*) FILTER (abs(value - 50) <= 1.5) AS g FROM events GROUP BY user_id) SELECT doc_id, 1 AS page, n >= 120 AND abs(l - r) / greatest(1, l + r)::DOUBLE <= 0.3 AND g / n::DOUBLE <= 0.3 AS two_column FROM w")
def two_column_pages(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    w = e.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").alias("ordinal"), F.col("value").alias("x0"), F.col("value").alias("x1"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"), F.col("event_type").alias("text"))
    return words.two_column_pages(w, w.select("doc_id", "page", F.lit(100.0).alias("width")).distinct())


@query(f"""WITH {SQL_LINES}, {TABLES}, r AS (SELECT l_orderkey, no, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS a, concat_ws(' ', nullif(l_returnflag, 'N'), l_linestatus) AS b, strftime(l_shipdate, '%Y-%m-%d') AS c FROM ln),
    g AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, string_agg(a || ' | ' || b || ' | ' || c, chr(10) ORDER BY no) AS text FROM r GROUP BY 1),
    e AS (SELECT t.* EXCLUDE (n), g.n, text, y0 <= 224 AS top, y1 >= 576 AS bottom, o_orderkey % 2 = 0 AS titled FROM t JOIN g USING (o_orderkey) WHERE g.n >= 2),
    ti AS (SELECT doc_id, page, o_orderkey AS o, x0, y0 - 20 AS y0, x1, y0 - 8 AS y1, 'Table ' || o_orderkey || ' lines' AS t FROM t JOIN g USING (o_orderkey) WHERE o_orderkey % 2 = 0),
    ctx AS (SELECT e.table_id, arg_min(ti.t, ti.o) FILTER (e.y0 - ti.y1 BETWEEN -8 AND 160 AND greatest(0.0, least(e.x1, ti.x1) - greatest(e.x0, ti.x0)) / 400.0 >= 0.12) AS title, least(1.0, count(*) FILTER (ti.x0 BETWEEN e.x0 AND e.x1 AND ti.y0 BETWEEN e.y0 AND e.y1) / 8.0) AS lines FROM e JOIN ti USING (doc_id, page) GROUP BY 1),
    par AS (SELECT e.table_id, count(*) > 0 AS parent FROM e JOIN e p ON p.doc_id = e.doc_id AND p.page + 1 = e.page AND p.bottom AND p.o_orderkey BETWEEN e.o_orderkey - 10 AND e.o_orderkey - 1 GROUP BY 1),
    k AS (SELECT e.*, title, coalesce(lines, 0.0) AS lines, coalesce(parent, false) AS parent, least(1.0, 0.4 * (n - 1) / n + 0.35 + 0.25 * 2 / 3) AS score FROM e LEFT JOIN ctx USING (table_id) LEFT JOIN par USING (table_id)),
    i AS (SELECT *, CASE WHEN n <= 3 THEN 'FRAGMENT' ELSE 'NEW_TABLE' END AS identity, CASE WHEN n <= 3 THEN 0.6 ELSE 0.8 END AS idc FROM k),
    v AS (SELECT *, CASE WHEN title IS NOT NULL THEN score >= 0.25 WHEN lines >= 0.45 THEN n >= 4 AND score >= 0.56 ELSE (n >= 5 AND score >= 0.85) OR (n >= 6 AND score >= 0.85) OR (n >= 4 AND score >= 0.7) END AS ok FROM i)
    SELECT doc_id, table_id, 3 AS col_count, CAST(n AS INTEGER) AS row_count, identity, round((idc + score + 1.0) / 3, 6) AS confidence, 0 AS n_flags, false AS review_required, text FROM v WHERE ok""")
def judged_tables(spark, sf_dir):
    """Order lines as ruled evidence, normalized, put in context and judged; the accepted tables."""
    line = order_lines(spark, sf_dir)
    text = [F.col("l_quantity").cast("int").cast("string"), F.lit(""), F.nullif(F.col("l_returnflag"), F.lit("N")), F.col("l_linestatus"), F.lit(None).cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")]
    cells = F.array(*[F.struct(F.lit(k).alias("physical_col"), t.alias("text")) for k, t in enumerate(text)])
    rows = F.transform(F.array_sort(F.collect_list(F.struct("no", cells.alias("cells")))), lambda r: F.struct(r["no"].alias("physical_row"), r["cells"].alias("cells")))
    grids = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rows.alias("rows"))
    t = order_tables(spark, sf_dir).drop("col_count", "title", "section_hint", "header", "column_signature").join(grids, "o_orderkey").withColumn("physical_cols", F.lit(6))
    none = {"parent_cols": F.lit(None).cast("int"), "parent_header": F.lit(None).cast("array<string>"), "parent_bbox": F.lit(None).cast("array<double>")}
    made = tables.normalize(tables.near_edges(t).withColumns(none))
    titles = t.where(F.col("o_orderkey") % 2 == 0).select("doc_id", "page", F.col("o_orderkey").alias("ordinal"), F.array(F.col("bbox")[0], F.col("bbox")[1] - 20, F.col("bbox")[2], F.col("bbox")[1] - 8).alias("bbox"), F.concat(F.lit("Table "), F.col("o_orderkey").cast("string"), F.lit(" lines")).alias("text"))
    placed = tables.context(made, titles, titles.select("doc_id", "page", "bbox")).withColumn("seq", F.col("o_orderkey"))
    judged = tables.judge(tables.identity_parents(placed))
    return judged.select("doc_id", "table_id", "col_count", "row_count", "identity", r6(F.col("confidence")).alias("confidence"), F.size("risk_flags").alias("n_flags"), "review_required", F.array_join("row_texts", "\n").alias("text"))


@query(f"""WITH RECURSIVE {BOXES}, w AS (SELECT b.*, p_name AS t, regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS c FROM b JOIN part ON p_partkey = l_partkey),
    x AS (SELECT doc_id, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'c': c}} ORDER BY o) AS texts FROM w WHERE flag <> 'R' GROUP BY doc_id), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM w WHERE flag = 'R'),
    f AS (SELECT DISTINCT i.doc_id, 0 AS k, coalesce(texts, []) AS texts, CAST([] AS VARCHAR[]) AS kept, 0 AS n FROM i LEFT JOIN x USING (doc_id)
        UNION ALL SELECT f.doc_id, i.k, CASE WHEN NOT g.there AND g.turns THEN list_append(f.texts, {{'x0': i.x0, 'y0': i.y0, 'x1': i.x1, 'y1': i.y1, 'c': i.c}}) ELSE f.texts END, CASE WHEN g.there OR g.turns THEN f.kept ELSE list_append(f.kept, printf('img_p1_%03d', i.o)) END, f.n + CASE WHEN g.there OR g.turns THEN 1 ELSE 0 END
        FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k + 1, LATERAL (SELECT length(i.t) >= 2 AND NOT regexp_matches(i.c, 'figure|fig|图|表|chart|illustration') AND len(list_filter(f.texts, lambda q: {sql_shared('q', 'i')} >= 0.55 AND q.c <> '' AND i.c <> '' AND (contains(q.c, i.c) OR contains(i.c, q.c)))) > 0 AS there,
            length(i.t) >= 2 AND NOT regexp_matches(i.c, 'figure|fig|图|表|chart|illustration') AND (i.x1 - i.x0) * (i.y1 - i.y0) / 480000.0 <= 0.24 AS turns) g)
    SELECT f.doc_id, 1 AS page, array_to_string(kept, ',') AS kept, CAST(len(texts) AS INTEGER) AS n_texts, n FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k WHERE f.k = total""")
def demoted_images(spark, sf_dir):
    """Boxes of returned lines as images with recovered text; those that are text become blocks."""
    b = line_boxes(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text")), "l_partkey")
    img = b.where("l_returnflag = 'R'").select("doc_id", "page", "ordinal", F.format_string("img_p1_%03d", "ordinal").alias("image_id"), "bbox", "text", F.lit(0.9).alias("confidence"), F.lit("word-cluster").alias("source"), F.lit(False).alias("has_path"))
    txt = b.where("l_returnflag <> 'R'").select("doc_id", "page", "ordinal", "bbox", "text", F.lit("text-layer").alias("source"))
    got = images.demote_textual_images(img, txt, b.select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).distinct())
    return got.select("doc_id", "page", F.array_join("kept", ",").alias("kept"), F.size("texts").alias("n_texts"), "n")
