"""Queries of single operators over the driver's tables, several operators of a kind in each, with their SQL.

The ids beside a query are those of the operator inventory.  Texts that reach every branch are rendered from
the parts' names by templates; boxes, words and grids from order lines.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossio.functions import cast as C
from dossio.functions import geom as G
from dossio.functions import text as T
from dossio.operators import facts, images, jobs, repairs, rules, stitch, tables, text_blocks, words
from dossio.plans.queries import BOXES, CELLS, PART_FACTS, SQL_LINES, TABLES, _figure_inputs, line_boxes, order_grids, order_lines, order_tables, part_documents, query, r6, read

TEMPLATES = (
    "@", "(AB-1.2)", "（x_9/z）", "(too long for a code to be one of them)", "合计 12", "Total of @", "总 7", "* @", "12) @", "note: @", "说明:@", "glossary", "Glossary of @",
    "3.2.1 @表", "1 规格表", "表 4 Doses", "术语表 @", "• @", "[x] @", "第一句。 第二句！@", "done;", "end：", "药品 @", "  padded  @ ", "2.1", "2.1 药品", "2.1 Scope of", "2.1 Scope of this",
)


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SAMPLES = f"t AS (SELECT p_partkey, p_size, replace([{', '.join(map(sql_text, TEMPLATES))}][p_partkey % {len(TEMPLATES)} + 1], '@', p_name) AS t FROM part)"
WHITE = "[\\s\\x1c-\\x1f]"
HAN = "[\\x{4E00}-\\x{9FFF}]"


def samples(spark, sf_dir):
    """A text for each part, by template."""
    p = read(spark, sf_dir, "part")
    template = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("p_partkey") % len(TEMPLATES) + 1).cast("int"))
    return p.select("p_partkey", "p_size", F.replace(template, F.lit("@"), F.col("p_name")).alias("t"))


# --- texts


@query(f"""WITH {SAMPLES} SELECT p_partkey, regexp_matches(trim(t), '^[•\\-·●◆()（）\\[\\]]') AS starts, regexp_matches(trim(t), '[。！？；:：]$') AS ends, regexp_matches(t, '{HAN}') AS cjk, CAST(len(regexp_extract_all(t, '{HAN}')) AS INTEGER) AS n_cjk,
    regexp_full_match(trim(t), '[（(][A-Za-z0-9.\\-_/]{{2,28}}[)）]') AS code, regexp_matches(lower(t), '^(?:合计|总计|小计|共计|平均|mean|total|sum)|[总共计]\\s*\\d+') AS aggregate,
    regexp_matches(trim(t), '^(?:[*†‡§¶]|\\d+\\))') OR regexp_matches(lower(t), '^(?:注|说明|备注|note):') AS annotation, contains(lower(t), 'glossary') OR contains(t, '术语表') OR contains(t, '词汇表') AS glossary,
    regexp_matches(trim(t), '^\\d+(?:\\.\\d+)*\\s*[\\x{{4E00}}-\\x{{9FFF}}A-Za-z]{{1,20}}表$') OR regexp_matches(trim(t), '^表\\s*[0-9A-Za-z一二三四五六七八九十零〇.\\-]+') OR contains(t, '术语表') AS heading,
    regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS compact FROM t""")
def text_predicates(spark, sf_dir):
    """FLT-04 FLT-05 FLT-22 FLT-25 FLT-26 FLT-27 FLT-29 STR-02 STR-10 STR-23 STR-26."""
    t = F.col("t")
    return samples(spark, sf_dir).select(
        "p_partkey", T.starts_with_break(t).alias("starts"), T.ends_with_break(t).alias("ends"), T.has_cjk(t).alias("cjk"), T.cjk_count(t).alias("n_cjk"), T.is_parenthetical(t).alias("code"), T.is_aggregate(t).alias("aggregate"),
        T.is_annotation(t).alias("annotation"), T.is_glossary_hint(t).alias("glossary"), T.is_heading(t).alias("heading"), T.compact_text(t).alias("compact"),
    )


@query(f"""WITH {SAMPLES}, w AS (SELECT p_partkey, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM t),
    n AS (SELECT *, len(w) AS n, regexp_full_match(w[1], '\\d+(?:\\.\\d+){{1,4}}') AS numbered FROM w)
    SELECT p_partkey, coalesce(CASE WHEN n = 1 THEN numbered WHEN n = 2 AND numbered AND length(w[2]) <= 12 AND regexp_matches(w[2], '[\\x{{4E00}}-\\x{{9FFF}}A-Za-z]') THEN true WHEN n BETWEEN 1 AND 3 THEN regexp_full_match(array_to_string(w, ' '), '\\d+(?:\\.\\d+){{1,4}}\\s+\\S+') ELSE false END, false) AS tail,
        array_to_string(w, ' | ') AS row FROM n""")
def section_tails(spark, sf_dir):
    """FLT-23 STR-09."""
    w = F.filter(F.split("t", " "), lambda x: x != "")
    return samples(spark, sf_dir).select("p_partkey", T.is_section_tail(w).alias("tail"), T.row_text(w).alias("row"))


@query(f"""WITH {SAMPLES}, p AS (SELECT a.p_partkey, a.t AS l, b.t AS r FROM t a JOIN t b ON a.p_partkey + 1 = b.p_partkey),
    c AS (SELECT *, regexp_replace(lower(l), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS cl, regexp_replace(lower(r), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS cr FROM p)
    SELECT p_partkey, CASE WHEN (regexp_matches(right(l, 1), '{HAN}') AND regexp_matches(left(r, 1), '{HAN}')) OR regexp_matches(l, '[-(（/／]$') OR regexp_matches(r, '^[)）\\]】%％]') THEN l || r ELSE l || ' ' || r END AS joined, cl <> '' AND cr <> '' AND contains(cl, cr) AS holds,
        regexp_replace(lower(trim(l)), '\\s+', ' ', 'g') = regexp_replace(lower(trim(r)), '\\s+', ' ', 'g') AS compatible FROM c""")
def fragment_joins(spark, sf_dir):
    """STR-04 STR-05 FLT-30: a text and the next part's."""
    t = samples(spark, sf_dir)
    both = t.join(t.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("r")), "p_partkey")
    left, right = F.col("t"), F.col("r")
    return both.select("p_partkey", T.join_fragments(left, right).alias("joined"), T.contains_text(left, right).alias("holds"), T.titles_compatible(left, right).alias("compatible"))


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS i, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''""")
def document_paragraphs(spark, sf_dir):
    """STR-27."""
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(T.paragraphs_of(F.col("text"))).alias("p")).select("doc_id", F.col("p.index").alias("i"), F.col("p.text").alias("line"))


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
    c AS (SELECT doc_id, i, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c WHERE line <> '')
    SELECT d.doc_id, coalesce(p, '') AS preview FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS p FROM n WHERE k <= 80 GROUP BY doc_id) USING (doc_id)""")
def normalized_previews(spark, sf_dir):
    """SRT-05."""
    return read(spark, sf_dir, "documents").select("doc_id", T.normalized_preview(F.col("text")).alias("preview"))


SENTENCES = ("第一句。第二句！ third one", "甲 乙 丙 丁 。 尾", "（ 内 ） ， 外", "；；，x", ",lead", "plain text", "问？答；完")
POLISHED = ("第一句。\n第二句！\nthird one", "甲乙 丙丁。\n尾", "（内）， 外", "x", "lead", "plain text", "问？\n答；\n完")


@query(f"SELECT p_partkey, [{', '.join(map(sql_text, POLISHED))}][p_partkey % {len(POLISHED)} + 1] AS shown FROM part")
def display_previews(spark, sf_dir):
    """STR-15 STR-21, against what each text must become."""
    said = F.element_at(F.array(*[F.lit(t) for t in SENTENCES]), (F.col("p_partkey") % len(SENTENCES) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.display_lines(said).alias("shown"))


NOISY = (
    "<p class=x>药品 名称</p>说明", 'unhidewhenused="false" 内容 zh-cn 一二', "&lt;b&gt;粗体内容&lt;/b&gt;", "普通表格 标题 1 字符 中华人民共和国药典", "Author: someone", "2020-01-01T00:00:00Z 12345", "12 : 30 / 5", "true and false", "en-US 12 pages", "a.files/b here",
    "ns:a ns:b text", "one two three four five six seven eight 12", "tel 12345678", "Plain English line", "Longprefix99 药品说明 abcdefgh 用法", "前言标题 总则 正文内容",
)
CLEANED = ("药品名称说明", "内容一二", "粗体内容", "中华人民共和国药典", None, None, None, "and", "12 pages", "here", None, None, None, "Plain English line", "药品说明用法", "总则正文内容")


@query(f"SELECT p_partkey, coalesce([{', '.join('NULL' if t is None else sql_text(t) for t in CLEANED)}][p_partkey % {len(CLEANED)} + 1], '') AS line FROM part")
def preview_line_cases(spark, sf_dir):
    """FLT-35 STR-14 STR-16 STR-17, against what each line must become; noise lines give none."""
    raw = F.element_at(F.array(*[F.lit(t) for t in NOISY]), (F.col("p_partkey") % len(NOISY) + 1).cast("int"))
    lines = read(spark, sf_dir, "part").select("p_partkey", T.preview_lines(raw).alias("lines"))
    return lines.select("p_partkey", F.array_join("lines", "|").alias("line"))


@query("""SELECT p_partkey, p_partkey % 4 AS kind, CASE p_partkey % 4 WHEN 0 THEN 'page ' || p_size || ' ' || p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type || ' ' || p_name ELSE p_name END AS preview FROM part""")
def preview_of_sources(spark, sf_dir):
    """STR-18 STR-19 STR-20: by source type, pages, paragraphs, slides or the text."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "Word", "presentation", "xml")]), (k + 1).cast("int"))
    pages, slides = F.array(F.concat(F.lit("page "), F.col("p_size").cast("string")), name), F.array("p_type", "p_name")
    chunks = read(spark, sf_dir, "part").select("p_partkey", k.alias("kind"), T.preview_chunks(kind, pages, F.array("p_brand"), slides, name).alias("chunks"))
    lines = chunks.select("p_partkey", "kind", T.preview_lines(F.array_join("chunks", "\n")).alias("lines"))
    return lines.select("p_partkey", "kind", T.preview(F.col("lines")).alias("preview"))


@query(f"""WITH {SAMPLES} SELECT p_partkey, trim(t) AS prompt, '[generated] ' || left(t, 200) AS generated, '[generated] Explain risk: ' || trim(t) AS explained, CAST(CASE WHEN trim(t) = '' THEN 0 ELSE 1 END AS INTEGER) AS blocks FROM t""")
def generated_texts(spark, sf_dir):
    """FLT-37 FLT-41 UDF-16 UDF-17."""
    t = F.col("t")
    return samples(spark, sf_dir).select("p_partkey", T.sanitize_prompt(t).alias("prompt"), rules.generate(t).alias("generated"), rules.explain_risk(t).alias("explained"), F.size(rules.layout(t)).alias("blocks"))


@query("""WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey, l_quantity, l_returnflag FROM lineitem), t AS (SELECT doc_id, [{'x0': 10.0, 'x1': 30.0, 't': '药'}, {'x0': 30.0 + max(l_quantity) % 4, 'x1': 60.0, 't': '品' || max(l_partkey)}, {'x0': 60.0 + min(l_quantity) % 3, 'x1': 90.0, 't': min(l_returnflag)}] AS ts FROM w GROUP BY doc_id)
    SELECT doc_id, ts[1].t || CASE WHEN ts[2].x0 - 30 > 1.5 THEN ' ' ELSE '' END || ts[2].t || CASE WHEN ts[3].x0 - 60 > 1.5 THEN ' ' ELSE '' END || ts[3].t AS text FROM t""")
def smart_joins(spark, sf_dir):
    """STR-29: a space over a wide gap only."""
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"), F.max("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    one = lambda a, b, t: F.struct(a.cast("double").alias("x0"), F.lit(b).alias("x1"), t.alias("text"))
    tokens = F.array(one(F.lit(10.0), 30.0, F.lit("药")), one(30.0 + F.col("hi") % 4, 60.0, F.concat(F.lit("品"), F.col("p").cast("string"))), one(60.0 + F.col("lo") % 3, 90.0, F.col("f")))
    return g.select("doc_id", T.smart_join(tokens).alias("text"))


# --- casts and labels


@query("""WITH e AS (SELECT event_id, user_id, value, ['1', 'true', 'Yes', 'on', '0', 'FALSE', 'no', 'off', 'maybe', ''][event_id % 10 + 1] AS flag, ['12', '7.5', 'x', '', '-3', '1e3'][event_id % 6 + 1] AS num, '/in/run/' || user_id || ['.pdf', '.DOCX', '.xml', '.txt', '.ppt', ''][event_id % 6 + 1] AS path,
        ['pdf', 'word', 'presentation', 'xml'][event_id % 4 + 1] AS kind FROM events), s AS (SELECT *, lower(regexp_extract(path, '\\.[^./]+$')) AS suffix FROM e)
    SELECT event_id, coalesce(try_cast(nullif(num, '') AS DOUBLE), -1.0) AS f, coalesce(CASE WHEN regexp_full_match(num, '-?\\d+') THEN try_cast(num AS INTEGER) END, -1) AS i, CASE WHEN lower(flag) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(flag) IN ('0', 'false', 'no', 'off') THEN false ELSE event_id % 2 = 0 END AS b,
        suffix, suffix IN ('.pdf', '.docx', '.doc', '.pptx', '.ppt', '.xml') AS supported, regexp_replace(path, '^/in/run/', '') AS relative,
        CASE WHEN suffix = '.pdf' THEN 'pdf' WHEN suffix IN ('.docx', '.doc') THEN 'word' WHEN suffix IN ('.ppt', '.pptx') THEN 'ppt' WHEN suffix = '.xml' THEN 'ectd' WHEN kind = 'pdf' THEN 'pdf' WHEN kind = 'word' THEN 'word' WHEN kind = 'presentation' THEN 'ppt' ELSE 'ectd' END AS bucket FROM s""")
def casts_and_labels(spark, sf_dir):
    """CST-02 CST-03 CST-04 CST-05 CST-06 SRC-02."""
    e = read(spark, sf_dir, "events")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
    flag, num, kind = pick("1", "true", "Yes", "on", "0", "FALSE", "no", "off", "maybe", ""), pick("12", "7.5", "x", "", "-3", "1e3"), pick("pdf", "word", "presentation", "xml")
    path = F.concat(F.lit("/in/run/"), F.col("user_id").cast("string"), pick(".pdf", ".DOCX", ".xml", ".txt", ".ppt", ""))
    b = F.when(F.col("event_id") % 2 == 0, C.to_bool(flag, True)).otherwise(C.to_bool(flag, False))
    return e.select("event_id", C.to_float(num, -1.0).alias("f"), C.to_int(F.when(num.rlike(r"^-?\d+$"), num), -1).alias("i"), b.alias("b"), C.suffix(path).alias("suffix"), C.is_supported(path).alias("supported"), C.relative_path(path, "/in/run").alias("relative"), C.bucket(C.suffix(path), kind).alias("bucket"))


@query(f"""WITH {CELLS}, h AS (SELECT doc_id, string_agg(coalesce(nullif(trim(t), ''), 'Column ' || col), '|' ORDER BY col) AS header, nullif(coalesce(string_agg(nullif(trim(t), ''), '|' ORDER BY col), ''), '') AS candidates FROM g WHERE row = 1 GROUP BY doc_id) SELECT * FROM h""")
def grid_headers(spark, sf_dir):
    """CST-08 CST-09."""
    first = F.transform(F.get("grid", F.lit(0)), lambda c: F.coalesce(c, F.lit("")))
    return order_grids(spark, sf_dir).select("doc_id", F.array_join(C.header_of(F.col("grid")), "|").alias("header"), F.array_join(C.header_from_candidates(first), "|").alias("candidates"))


@query("SELECT n_nationkey, '{\"name\":\"' || n_name || '\"' || CASE WHEN n_regionkey > 1 THEN ',\"region\":' || n_regionkey ELSE '' END || '}' AS j, sha256(n_name || chr(0) || n_regionkey || chr(0) || 'x' || chr(0) || 'y' || chr(0)) AS fingerprint FROM nation")
def json_records(spark, sf_dir):
    """SRC-34 CST-12 CTL-11."""
    made = F.struct(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("region"))
    names, contents = F.array("n_name", F.lit("x")), F.array(F.col("n_regionkey").cast("string"), F.lit("y"))
    return read(spark, sf_dir, "nation").select("n_nationkey", C.to_json(made).alias("j"), C.fingerprint(names, contents).alias("fingerprint"))


# --- geometry

PAIR = BOXES + ", p AS (SELECT a.doc_id, a.o AS no, a.x0, a.y0, a.x1, a.y1, c.x0 AS u0, c.y0 AS v0, c.x1 AS u1, c.y1 AS v1 FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.o + 1 = c.o)"


def neighbours(spark, sf_dir):
    """Boxes p and q of each order line and the next."""
    b = line_boxes(spark, sf_dir).select("doc_id", "ordinal", "bbox")
    return b.select("doc_id", F.col("ordinal").cast("bigint").alias("no"), F.col("bbox").alias("p")).join(b.select("doc_id", (F.col("ordinal") - 1).cast("bigint").alias("no"), F.col("bbox").alias("q")), ["doc_id", "no"])


@query(f"""WITH {PAIR}, s AS (SELECT *, greatest(0, least(x1, u1) - greatest(x0, u0)) AS sw, greatest(0, least(y1, v1) - greatest(y0, v0)) AS sh FROM p)
    SELECT doc_id, no, CASE WHEN least((x1 - x0) * (y1 - y0), (u1 - u0) * (v1 - v0)) <= 0 THEN 0.0 ELSE round(sw * sh / least((x1 - x0) * (y1 - y0), (u1 - u0) * (v1 - v0)), 6) END AS shared, round(sh / least(y1 - y0, v1 - v0), 6) AS along, CASE WHEN v1 - v0 < (y1 - y0) * 0.85 THEN v0 ELSE y0 END AS compact_y0,
        x0 >= u0 - 10 AND y0 >= v0 - 10 AND x1 <= u1 + 10 AND y1 <= v1 + 10 AS inside, (x0 + x1) / 2 BETWEEN u0 AND u1 AND (y0 + y1) / 2 BETWEEN v0 AND v1 AS centred, sw * sh / greatest(1.0, least((x1 - x0) * (y1 - y0), (u1 - u0) * (v1 - v0))) >= 0.2 AS path, round((y1 - y0) / (no + 1), 6) AS row_height,
        least(x0, u0) AS l, greatest(y1, v1) AS bottom, true AS near, CASE WHEN round_even(x0 / 3, 2) = 0 THEN 0.0 ELSE round_even(x0 / 3, 2) END AS rounded FROM s""")
def box_relations(spark, sf_dir):
    """GEO-01 GEO-07 GEO-09 GEO-11 GEO-16 GEO-22 FLT-08 FLT-12 FLT-13."""
    p, q = F.col("p"), F.col("q")
    return neighbours(spark, sf_dir).select(
        "doc_id", "no", r6(G.strict_area_overlap(p, q)).alias("shared"), r6(G.strict_vertical_overlap(p, q)).alias("along"), G.compact_choice(p, q)[1].alias("compact_y0"), G.within(p, q, 10).alias("inside"), G.center_inside(p, q).alias("centred"),
        G.any_path(F.array(q), p).alias("path"), r6(G.row_height(p, F.col("no") + 1)).alias("row_height"), G.union_all(F.array(p, q))[0].alias("l"), G.union_all(F.array(p, q))[3].alias("bottom"), G.close(p, q).alias("near"), G.rounded(F.transform(p, lambda v: v / 3))[0].alias("rounded"),
    )


@query("""WITH d AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey, l_suppkey, l_extendedprice AS e, CAST(l_quantity AS DOUBLE) AS w, CAST(l_linenumber * 2 AS DOUBLE) AS h, l_returnflag AS f FROM lineitem)
    SELECT doc_id, n, l_partkey, l_suppkey, e, w > h * 3 AND h < 5 AS across, h > w * 3 AND w < 5 AS down, NOT (w > h * 3 AND h < 5) AND NOT (h > w * 3 AND w < 5) AND w > 5 AND h > 5 AS box,
        CASE f WHEN 'A' THEN 'line' WHEN 'R' THEN 'rectangle' ELSE CASE WHEN w < 5 OR h < 5 THEN 'line' ELSE 'unknown' END END AS kind, greatest(0.0, w - h) AS clamped FROM d""")
def drawing_kinds(spark, sf_dir):
    """GEO-10 GEO-12 GEO-20 FLT-14 FLT-15 FLT-16."""
    w, h = F.col("l_quantity").cast("double"), (F.col("l_linenumber") * 2).cast("double")
    items = F.when(F.col("l_returnflag") == "A", F.array(F.lit("x"), F.lit("l"))).when(F.col("l_returnflag") == "R", F.array(F.lit("re"), F.lit("l"))).otherwise(F.array(F.lit("x")))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("e"), G.is_horizontal_line(w, h).alias("across"), G.is_vertical_line(w, h).alias("down"), G.is_rectangle(w, h).alias("box"), G.drawing_kind(items, w, h).alias("kind"), G.clamped(w - h).alias("clamped"))


@query(f"""WITH {SQL_LINES}, l AS (SELECT l_orderkey AS doc_id, list(CAST(l_partkey % 5 AS VARCHAR) ORDER BY no) AS a, list(CAST(l_suppkey % 5 AS VARCHAR) ORDER BY no) AS b, list(DISTINCT CAST(l_partkey % 300 AS DOUBLE)) AS c FROM ln GROUP BY l_orderkey),
    n AS (SELECT *, list_sort(c) AS s FROM l)
    SELECT doc_id, round(len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(len(list_distinct(a)), len(list_distinct(b)))::DOUBLE, 6) AS similarity, (SELECT i FROM (SELECT unnest(s) AS x, unnest(range(0, len(s))) AS i) WHERE abs(120.0 - x) <= 50 ORDER BY abs(120.0 - x), i LIMIT 1) AS nearest, CAST(len(a) AS INTEGER) AS filled FROM n""")
def header_similarities(spark, sf_dir):
    """SET-03 SET-04 WIN-09 GEO-21."""
    g = order_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list((F.col("l_partkey") % 5).cast("string")).alias("a"), F.collect_list((F.col("l_suppkey") % 5).cast("string")).alias("b"), F.sort_array(F.collect_set((F.col("l_partkey") % 300).cast("double"))).alias("c"))
    return g.select("doc_id", r6(G.header_similarity(F.col("a"), F.col("b"))).alias("similarity"), G.nearest(F.col("c"), F.lit(120.0)).cast("bigint").alias("nearest"), G.filled_count(F.col("a")).alias("filled"))


@query("WITH n AS (SELECT DISTINCT p_size % 12 + 1 AS n FROM part) SELECT CAST(n AS INTEGER) AS n, left(sha1(array_to_string(list_transform(range(0, n), lambda i: printf('%.3f', round_even((i + 0.5) / n, 3))), ',')), 16) AS h FROM n")
def column_hashes(spark, sf_dir):
    """GEO-15."""
    n = read(spark, sf_dir, "part").select((F.col("p_size") % 12 + 1).cast("int").alias("n")).distinct()
    return n.select("n", G.column_hash(G.column_signature(F.col("n"))).alias("h"))


# --- words

SQL_WORDS = SQL_LINES + ", w AS (SELECT l_orderkey AS doc_id, no AS o, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_suppkey % 6 * 7 AS DOUBLE) AS y0, l_partkey % 400 + 30.0 AS x1, l_suppkey % 6 * 7 + 10.0 AS y1, 'w' || l_partkey AS t FROM ln)"


def order_words(spark, sf_dir):
    """Order lines as words of one page."""
    x, y = F.col("l_partkey") % 400 * 1.0, F.col("l_suppkey") % 6 * 7.0
    return order_lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("no").alias("ordinal"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 10).alias("y1"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"))


@query(f"""WITH {SQL_WORDS}, b AS (SELECT doc_id, 'b' || o AS box, x0 - 40 AS u0, y0 - 4 AS v0, x1 + 40 AS u1, y1 AS v1 FROM w WHERE o = 1)
    SELECT w.doc_id, box, w.o, (x0 + x1) / 2 AS xc, y1 - y0 AS height FROM w JOIN b USING (doc_id) WHERE greatest(0, least(x1, u1 + 1.6) - greatest(x0, u0 - 1.6)) * greatest(0, least(y1, v1 + 1.6) - greatest(y0, v0 - 1.6)) / greatest(1.0, least(300.0, (u1 - u0 + 3.2) * (v1 - v0 + 3.2))) >= 0.25""")
def words_of_boxes(spark, sf_dir):
    """JOIN-06 GEO-18."""
    w = order_words(spark, sf_dir)
    boxes = w.where("ordinal = 1").select("doc_id", "page", F.lit("b1").alias("box_id"), F.array(F.col("x0") - 40, F.col("y0") - 4, F.col("x1") + 40, F.col("y1")).alias("bbox"))
    return words.word_columns(words.words_in_boxes(w, boxes)).select("doc_id", F.col("box_id").alias("box"), F.col("ordinal").cast("bigint").alias("o"), "xc", "height")


@query(f"""WITH {SQL_WORDS}, c AS (SELECT doc_id, (x0 + x1) / 2 AS x FROM w), g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) <= 22.5 THEN 0 ELSE 1 END AS fresh FROM c), n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM g),
    m AS (SELECT doc_id, k, avg(x) AS center FROM n GROUP BY ALL) SELECT doc_id, CAST(k - 1 AS INTEGER) AS i, round(center, 6) AS center FROM m""")
def word_columns_of_orders(spark, sf_dir):
    """WIN-08."""
    held = order_words(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text")).alias("w"))
    return held.select("doc_id", F.posexplode(words.column_centers(F.col("w"))).alias("i", "center")).select("doc_id", "i", r6(F.col("center")).alias("center"))


@query(f"""WITH RECURSIVE {SQL_WORDS}, s AS (SELECT doc_id, (y0 + y1) / 2 AS y, x0, row_number() OVER (PARTITION BY doc_id ORDER BY (y0 + y1) / 2, x0, o) AS i FROM w),
    f AS (SELECT doc_id, i, [{{'y': y, 'n': 1}}] AS rows FROM s WHERE i = 1
        UNION ALL SELECT s.doc_id, s.i, CASE WHEN len(list_filter(f.rows, lambda r: abs(r.y - s.y) <= 5.5)) = 0 THEN list_append(f.rows, {{'y': s.y, 'n': 1}}) ELSE
            list_transform(f.rows, lambda r, k: CASE WHEN k = list_min(list_filter(list_transform(f.rows, lambda q, j: CASE WHEN abs(q.y - s.y) <= 5.5 THEN j END), lambda z: z IS NOT NULL)) THEN {{'y': (r.y * r.n + s.y) / (r.n + 1), 'n': r.n + 1}} ELSE r END) END
        FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
    SELECT doc_id, CAST(len(rows) AS INTEGER) AS n_rows, round(rows[1].y, 6) AS first_y, CAST(list_max(list_transform(rows, lambda r: r.n)) AS INTEGER) AS widest FROM f WHERE i = (SELECT max(i) FROM s WHERE s.doc_id = f.doc_id)""")
def word_rows(spark, sf_dir):
    """WIN-06: rows by a running mean, the first that is near."""
    held = order_words(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text")).alias("w"))
    made = held.select("doc_id", words.rows_fold(F.col("w")).alias("r"))
    return made.select("doc_id", F.size("r").alias("n_rows"), r6(F.get("r", F.lit(0))["y"]).alias("first_y"), F.array_max(F.transform("r", lambda r: r["n"])).alias("widest"))


@query(f"""WITH {CELLS}, r AS (SELECT doc_id, row, count(t) AS k FROM g GROUP BY ALL), m AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, k, count(*) AS n FROM r WHERE k >= 2 GROUP BY doc_id, k) GROUP BY doc_id),
    a AS (SELECT doc_id, count(DISTINCT row) AS rows, count(t) AS total, count(DISTINCT col) FILTER (t IS NOT NULL) AS used FROM g GROUP BY doc_id), b AS (SELECT doc_id, count(*) FILTER (k >= 2) AS multi FROM r GROUP BY doc_id),
    s AS (SELECT a.doc_id, rows, 0.3 * least(1.0, rows / 8.0) + 0.2 + 0.2 * total / (rows * 4.0) + 0.15 * multi / rows + 0.1 * coalesce(n / nullif(multi, 0)::DOUBLE, 0) + 0.05 * used / 4.0 AS score FROM a JOIN b USING (doc_id) LEFT JOIN m ON m.doc_id = a.doc_id)
    SELECT doc_id, round(score, 6) AS strength, rows >= 3 AND score >= CASE WHEN doc_id % 2 = 0 THEN 0.72 ELSE 0.45 END AS accepted FROM s""")
def tabular_strengths(spark, sf_dir):
    """AGG-19 FLT-18."""
    g = order_grids(spark, sf_dir).withColumn("s", words.tabular_strength(F.col("grid")))
    return g.select("doc_id", r6(F.col("s")).alias("strength"), words.accept_supplemental(F.size("grid"), F.lit(4), F.col("s"), F.col("doc_id") % 2 == 0).alias("accepted"))


@query(f"""WITH {BOXES} SELECT a.doc_id, a.o FROM b a WHERE a.flag = 'A' AND NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = a.doc_id AND c.flag = 'N' AND greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) >= 0.3)""")
def distinct_candidates(spark, sf_dir):
    """FLT-17."""
    b = line_boxes(spark, sf_dir)
    return words.distinct_from(b.where("l_returnflag = 'A'"), b.where("l_returnflag = 'N'")).select("doc_id", F.col("ordinal").cast("bigint").alias("o"))


@query(f"""WITH {SQL_WORDS}, e AS (SELECT doc_id, min(y0) AS top FROM w GROUP BY doc_id), h AS (SELECT doc_id, x0, x1, t, o FROM w JOIN e USING (doc_id) WHERE abs(y0 - top) <= 8 AND x0 <= 300),
    g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER v <= 15 THEN 0 ELSE 1 END AS fresh FROM h WINDOW v AS (PARTITION BY doc_id ORDER BY x0, o)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY x0, o ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT doc_id, string_agg(c, '|' ORDER BY k) AS heads FROM (SELECT doc_id, k, string_agg(t, ' ' ORDER BY x0, o) AS c FROM n GROUP BY ALL) GROUP BY doc_id""")
def header_candidate_texts(spark, sf_dir):
    """WIN-10."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("x0", "y0", "x1", "y1", "text").alias("w")))), lambda o: o["w"])
    held = order_words(spark, sf_dir).groupBy("doc_id").agg(order.alias("w"), F.min("y0").alias("top"))
    heads = words.header_candidates(F.col("w"), F.array(F.lit(0.0), F.col("top"), F.lit(300.0), F.col("top") + 50))
    return held.select("doc_id", F.array_join(heads, "|").alias("heads")).where("heads <> ''")


# --- page evidence

SPAN_TEXT = "'w' || l_partkey"
EVIDENCE = SQL_LINES + ", e AS (SELECT l_orderkey AS doc_id, no, l_partkey % 400 + 0.125 AS x0, no * 20.0 AS y0, l_quantity AS q, l_returnflag AS f, 'w' || l_partkey AS a, l_linestatus || ' ' AS b FROM ln)"


def page_evidence(spark, sf_dir):
    """Orders as page evidence: a block for each line, of text (two spans) or an image (returned lines); its box as a drawing and its spans as words."""
    c = F.col
    line = order_lines(spark, sf_dir)
    x, y = c("l_partkey") % 400 + 0.125, c("no") * 20.0
    box = G.box(x, y, x + 60, y + 12)
    a, b = F.concat(F.lit("w"), c("l_partkey").cast("string")), F.concat("l_linestatus", F.lit(" "))
    span = lambda t, size: F.struct(t.alias("text"), size.cast("double").alias("size"), box.alias("bbox"))
    lines = F.array(F.struct(box.alias("bbox"), F.array(span(a, c("l_quantity")), span(b, F.lit(0))).alias("spans")))
    block = F.struct("no", F.struct(F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("type"), box.alias("bbox"), lines.alias("lines")).alias("block"))
    word = F.struct("no", F.struct(x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 12).alias("y1"), F.when(c("no") % 3 == 0, " ").otherwise(a).alias("text")).alias("w"))
    drawing = F.struct("no", F.struct(box.alias("rect"), F.array(F.lit("re")).alias("items")).alias("d"))
    inner = lambda part, name: F.transform(F.array_sort(F.collect_list(part)), lambda o: o[name])
    return line.groupBy(c("l_orderkey").alias("doc_id")).agg(inner(block, "block").alias("blocks"), inner(word, "w").alias("words"), inner(drawing, "d").alias("drawings")).withColumn("page", F.lit(1))


@query(f"""WITH {EVIDENCE}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k FROM e WHERE f <> 'R') SELECT doc_id, CAST(k AS INTEGER) AS ordinal, printf('txt_p1_%03d', k) AS block_id, trim(a || b) AS text, CAST(q AS DOUBLE) AS font_size, round_even(x0, 2) AS x0 FROM t""")
def scanned_lines(spark, sf_dir):
    """SRC-05 SRC-13: a block a line, its size the median of those above 0."""
    return text_blocks.scan_lines(page_evidence(spark, sf_dir)).select("doc_id", "ordinal", "block_id", "text", "font_size", F.col("bbox")[0].alias("x0"))


@query(f"""WITH {EVIDENCE} SELECT doc_id, 'image' AS kind, printf('img_p1_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY no)) AS name, y0 FROM e WHERE f = 'R'
    UNION ALL SELECT doc_id, 'context', a || ' ' || b, y0 FROM e WHERE f <> 'R' UNION ALL SELECT doc_id, 'drawing', 're', y0 FROM e UNION ALL SELECT doc_id, 'word', a, y0 FROM e WHERE no % 3 <> 0""")
def scanned_items(spark, sf_dir):
    """SRC-06 SRC-07 SRC-08 SRC-09 SRC-10 SRC-11 SRC-14 SRC-15."""
    e = page_evidence(spark, sf_dir)
    part = lambda df, kind, name, y0: df.select("doc_id", F.lit(kind).alias("kind"), name.alias("name"), y0.alias("y0"))
    made = part(text_blocks.scan_images(e), "image", F.col("image_id"), F.col("bbox")[1])
    made = made.unionByName(part(text_blocks.scan_context_blocks(e), "context", F.col("text"), F.col("bbox")[1]))
    made = made.unionByName(part(text_blocks.scan_drawings(e), "drawing", F.get("items", F.lit(0)), F.col("bbox")[1]))
    return made.unionByName(part(text_blocks.scan_words(e), "word", F.col("text"), F.col("y0")))


@query(f"""WITH {BOXES} SELECT a.doc_id, a.o, CAST(count(c.o) AS INTEGER) AS inside FROM b a LEFT JOIN b c ON c.doc_id = a.doc_id AND c.x0 >= a.x0 - 60 AND c.y0 >= a.y0 - 60 AND c.x1 <= a.x1 + 60 AND c.y1 <= a.y1 + 60 GROUP BY a.doc_id, a.o""")
def items_in_region(spark, sf_dir):
    """FLT-13: the boxes of an order within one of them and a margin."""
    b = line_boxes(spark, sf_dir)
    held = b.groupBy("doc_id").agg(F.collect_list(F.struct("bbox")).alias("items"))
    return b.join(held, "doc_id").select("doc_id", F.col("ordinal").cast("bigint").alias("o"), F.size(tables.in_region(F.col("items"), F.col("bbox"), 60.0)).alias("inside"))


RECOVERED = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE '' END AS text, CASE p_partkey % 5 WHEN 0 THEN 0.98 WHEN 1 THEN 0.9 WHEN 2 THEN greatest(p_size % 10 / 10.0, CASE WHEN p_size % 2 = 0 THEN 0.7 ELSE 0.6 END) ELSE 0.0 END AS confidence, CASE p_partkey % 5 WHEN 0 THEN 'text-layer' WHEN 1 THEN 'word-cluster' WHEN 2 THEN 'ocr' ELSE 'none' END AS source, p_size % 2 = 0 AS path, (p_size % 30) / 100.0 AS ratio FROM part"


@query(f"""WITH r AS ({RECOVERED}), g AS (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS c, CASE WHEN source IN ('text-layer', 'word-cluster') THEN 0.86 WHEN source = 'ocr' THEN CASE WHEN path THEN 0.9 ELSE 0.93 END ELSE 0.95 END AS gate FROM r)
    SELECT p_partkey, text, round(CAST(confidence AS DOUBLE), 6) AS confidence, source, length(text) >= 2 AND NOT regexp_matches(c, 'figure|fig|图|表|chart|illustration') AND ((confidence >= gate AND ratio <= 0.24) OR (path AND confidence >= 0.78 AND ratio <= 0.28) OR (length(c) BETWEEN 2 AND 20 AND confidence >= 0.84 AND ratio <= 0.08)) AS converts FROM g""")
def recovered_texts(spark, sf_dir):
    """TBL-24 TBL-25 JOIN-04: a region's text layer, words or OCR (the engine is a parameter; here it gives nothing but for one kind), and whether it is text."""
    c, k = F.col, F.col("p_partkey") % 5
    p = images.ocr_regions(read(spark, sf_dir, "part").withColumns({"bbox": G.box(F.lit(0), F.lit(0), F.lit(20), F.lit(20)), "image": F.lit(b"")}))
    ocr, sure = F.when(k == 2, c("p_type")).otherwise(c("ocr_text")), F.when(k == 2, c("p_size") % 10 / 10.0).otherwise(c("ocr_confidence"))
    path = c("p_size") % 2 == 0
    got = p.withColumn("r", images.recover_text(F.when(k == 0, c("p_name")).otherwise("x"), F.when(k == 1, c("p_brand")).otherwise(""), ocr, sure, path))
    return got.select("p_partkey", "r.text", r6(c("r.confidence")).alias("confidence"), "r.source", images.should_convert(c("r.text"), c("r.confidence"), c("r.source"), path, c("p_size") % 30 / 100.0).alias("converts"))


# --- grids and tables


@query(f"""WITH {CELLS}, f AS (SELECT DISTINCT doc_id, col FROM g WHERE t IS NOT NULL), w AS (SELECT doc_id, max(k) AS widest FROM (SELECT doc_id, row, count(t) AS k FROM g GROUP BY ALL) GROUP BY doc_id),
    u AS (SELECT doc_id, count(*) AS runs FROM (SELECT *, lag(col) OVER (PARTITION BY doc_id ORDER BY col) AS p FROM f) WHERE p IS NULL OR col > p + 1 GROUP BY doc_id)
    SELECT doc_id, CAST(runs AS INTEGER) AS n, round(least(1.0, runs / greatest(1, widest)::DOUBLE), 6) AS confidence FROM u JOIN w USING (doc_id)""")
def column_runs(spark, sf_dir):
    """WIN-12."""
    p = order_grids(spark, sf_dir).withColumn("p", F.transform("grid", lambda r: G.filled(r)))
    return p.select("doc_id", tables.column_clustering(F.col("p"), F.lit(4)).alias("c")).select("doc_id", F.col("c.logical_col_count").alias("n"), r6(F.col("c.confidence")).alias("confidence"))


@query(f"""WITH {CELLS}, u AS (SELECT doc_id, col, list(row) AS rows FROM g WHERE t IS NOT NULL GROUP BY ALL), p AS (SELECT *, lag(rows) OVER (PARTITION BY doc_id ORDER BY col) AS before FROM u),
    b AS (SELECT doc_id, count(*) FILTER (before IS NULL OR len(list_intersect(rows, before)) / len(list_distinct(list_concat(rows, before)))::DOUBLE < 0.5) AS n FROM p GROUP BY doc_id), r AS (SELECT doc_id, count(DISTINCT row) AS rows FROM g GROUP BY doc_id)
    SELECT doc_id, CAST(n AS INTEGER) AS n, round(least(1.0, rows / 5.0), 6) AS confidence FROM b JOIN r USING (doc_id)""")
def column_company(spark, sf_dir):
    """AGG-20: neighbouring columns that are filled together in half of the rows are one."""
    p = order_grids(spark, sf_dir).withColumn("p", F.transform("grid", lambda r: G.filled(r)))
    return p.select("doc_id", tables.content_distribution(F.col("p"), F.lit(4)).alias("c")).select("doc_id", F.col("c.logical_col_count").alias("n"), r6(F.col("c.confidence")).alias("confidence"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 5 + 2 AS n, o_orderkey % 4 + 2 AS p, CAST(o_orderkey % 50 AS DOUBLE) AS x0, o_orderkey % 50 + 400.0 AS x1, CAST(o_orderkey % 90 AS DOUBLE) AS u0, o_orderkey % 90 + 350.0 AS u1, o_orderkey % 3 = 0 AS placed FROM orders),
    c AS (SELECT *, unnest(range(0, p)) AS k FROM t), m AS (SELECT o_orderkey, n, p, x0, x1, k, CASE WHEN placed THEN greatest(CASE WHEN x0 - u0 > (u1 - u0) / n * 0.2 THEN 1 ELSE 0 END, greatest(0, least(n - 1, floor((x0 + (k + 0.5) * (x1 - x0) / p - u0) / (u1 - u0) * n)))) ELSE least(floor((k + 0.5) / p * n), n - 1) END AS slot FROM c)
    SELECT o_orderkey, CAST(slot AS INTEGER) AS logical, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS physical, round(avg(x0 + (k + 0.5) * (x1 - x0) / p), 6) AS center FROM m GROUP BY ALL""")
def mapped_columns(spark, sf_dir):
    """WIN-13 WIN-14 WIN-15: physical columns to logical ones by the parent's box or in proportion, and the columns of each."""
    k = F.col("o_orderkey")
    n, p = (k % 5 + 2).cast("int"), (k % 4 + 2).cast("int")
    box, parent = G.box(k % 50, F.lit(0), k % 50 + 400, F.lit(9)), G.box(k % 90, F.lit(0), k % 90 + 350, F.lit(9))
    none = F.array().cast("array<array<int>>")
    m = read(spark, sf_dir, "orders").withColumn("m", tables.column_mapping(p, n, none, box, F.when(k % 3 == 0, parent)))
    each = m.select("o_orderkey", F.posexplode(tables.column_clusters(F.col("m"), n, box, p)).alias("logical", "c"))
    return each.where("c.center_x IS NOT NULL").select("o_orderkey", "logical", F.array_join("c.physical_cols", ",").alias("physical"), r6(F.col("c.center_x")).alias("center"))


@query(f"""WITH {CELLS}, e AS (SELECT doc_id, string_agg(CAST(row AS VARCHAR), ',' ORDER BY row) AS empty FROM (SELECT doc_id, row FROM g WHERE col IN (2, 4) GROUP BY ALL HAVING count(t) = 0) GROUP BY doc_id),
    c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) SELECT c.doc_id, coalesce(empty, '') AS empty, CAST(n AS INTEGER) AS n_cells FROM c LEFT JOIN e USING (doc_id)""")
def empty_rows_and_places(spark, sf_dir):
    """AGG-24 SET-01 SET-02 SRT-04: rows without text in the even columns; cells given twice count once, in order."""
    g = order_grids(spark, sf_dir)
    cells = F.flatten(F.transform("grid", lambda r, i: F.transform(r, lambda c, j: F.struct((i + 1).alias("logical_row"), (j + 1).alias("col"), c.alias("text")))))
    once = tables.distinct_cells(F.concat(F.reverse(cells), cells))
    even = F.transform("grid", lambda r: F.array(F.get(r, F.lit(1)), F.get(r, F.lit(3))))
    in_order = F.forall(once, lambda c: c["col"].between(1, 4))
    return g.select("doc_id", F.array_join(tables.empty_rows(even), ",").alias("empty"), F.when(in_order, F.size(once)).alias("n_cells"))


@query(f"""WITH {SQL_LINES}, r AS (SELECT l_orderkey AS doc_id, no, l_partkey % 3 AS k, 'name ' || l_partkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY no) AS i FROM ln)
    SELECT doc_id, string_agg(t || CASE WHEN k = 0 THEN '夹' ELSE '' END, chr(10) ORDER BY no) AS names FROM r GROUP BY doc_id""")
def torn_rows(spark, sf_dir):
    """WIN-19: a row that holds a torn-off last character and repeats the text above goes into the row above."""
    line, k = order_lines(spark, sf_dir), F.col("l_partkey") % 3
    none = F.lit(None).cast("string")
    text = F.concat(F.lit("name "), F.col("l_partkey").cast("string"))
    rows = F.when(k == 0, F.array(F.array(F.lit("m"), none, text), F.array(none, F.lit("夹"), text))).otherwise(F.array(F.array(F.lit("m"), none, text)))
    grids = line.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", rows.alias("r")))), lambda x: x["r"])).alias("grid"))
    return grids.select("doc_id", F.array_join(F.transform(tables.merge_split_rows(F.col("grid")), lambda r: F.get(r, F.lit(2))), "\n").alias("names"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Name|Dose|' || p_brand WHEN p_partkey % 3 = 1 THEN 'Name Dose||' || p_brand ELSE p_name || '||' || p_brand END AS first,
    CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'Column 1' WHEN 2 THEN 'old' ELSE 'old' END AS reset FROM (SELECT *, p_name FROM part)""")
def aligned_headers(spark, sf_dir):
    """WIN-22 TBL-22: a first row that holds the header's texts in one cell is set to the header; a blocked table's header comes from candidates or its grid."""
    c, k = F.col, F.col("p_partkey")
    none = F.lit(None).cast("string")
    first = F.when(k % 3 == 0, F.array(F.lit("Name Dose"), none, c("p_brand"))).when(k % 3 == 1, F.array(F.lit("Name Dose"), none, c("p_brand"))).otherwise(F.array(c("p_name"), none, c("p_brand")))
    header = F.when(k % 3 == 0, F.array(F.lit("Name"), F.lit("Dose"))).otherwise(F.array(F.lit("Size"), F.lit("Shape")))
    grid = stitch.align_header(F.array(first), header)
    candidates = F.when(k % 4 == 0, F.array(c("p_type"), F.lit(" "))).otherwise(F.array(F.lit("")))
    reset = stitch.reset_header(F.array(F.lit("old")), candidates, F.array(F.array(none)), k % 4 < 2)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.get(grid, F.lit(0)), "|", "").alias("first"), F.get(reset, F.lit(0)).alias("reset"))


@query("""WITH c AS (SELECT p_partkey, '1.1 Scope ' || p_size AS a, '2 ' || p_name || ' .... 12' AS b, '1.2 Long name ' || p_size || ' 7' AS c, p_name || ' .. 5' AS d, p_name AS e FROM part)
    SELECT p_partkey, round((CASE WHEN regexp_matches(a, '\\s\\d{1,3}$') THEN 0.75 ELSE 0.0 END + 1.0 + 0.75 + 0.65 + 0.0) / 5, 6) AS weighted, round((1.0 + CASE WHEN regexp_matches(a, '^\\s*\\d+(?:\\.\\d+){1,4}\\s+\\S+\\s+\\d{1,3}\\s*$') THEN 1 ELSE 0 END) / 5, 6) AS plain FROM c""")
def contents_ratios(spark, sf_dir):
    """AGG-15 AGG-16: rows of a table of contents, by weight and by count."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    rows = F.array(F.concat(F.lit("1.1 Scope "), size), F.concat(F.lit("2 "), name, F.lit(" .... 12")), F.concat(F.lit("1.2 Long name "), size, F.lit(" 7")), F.concat(name, F.lit(" .. 5")), name)
    return read(spark, sf_dir, "part").select("p_partkey", r6(tables.weighted_contents_ratio(rows)).alias("weighted"), r6(tables.contents_ratio(rows)).alias("plain"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'near_page_top' END, CASE WHEN o_orderkey % 3 = 0 THEN 'parent_candidate_found' END, CASE WHEN o_orderkey % 5 < 3 AND o_orderkey % 7 > 0 THEN 'has_explicit_header' ELSE 'no_explicit_header' END, CASE WHEN o_orderkey % 11 = 0 THEN 'marked_as_continuation' END) AS signals,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND NOT (o_orderkey % 5 < 3 AND o_orderkey % 7 > 0) THEN 'CONTINUATION' WHEN o_orderkey % 13 = 0 THEN 'CONTINUATION' WHEN o_orderkey % 6 >= 3 AND o_orderkey % 9 <= 3 THEN 'FRAGMENT' ELSE 'NEW_TABLE' END AS identity FROM orders""")
def identities(spark, sf_dir):
    """JOIN-10: a table's identity and what spoke for it."""
    k = F.col("o_orderkey")
    flag = lambda n: k % n == 0
    parent = F.when(flag(3), F.lit("p"))
    signals = tables.identity_signals(flag(2), parent, flag(7), k % 5 < 3, flag(11))
    who = tables.identity(flag(2), parent, flag(7), k % 5 < 3, flag(13), k % 9, k % 6)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(signals, ",").alias("signals"), who["identity"].alias("identity"))


@query(f"""WITH {TABLES}, b AS (SELECT doc_id, page, o_orderkey AS o, x0 AS u0, y0 - 30 AS v0, x1 AS u1, y0 - 12 AS v1, CASE o_orderkey % 4 WHEN 0 THEN 'Table ' || o_orderkey || ' of orders' WHEN 1 THEN 'Glossary of it' WHEN 2 THEN 'Contents' ELSE 'A paragraph of order ' || o_orderkey END AS t FROM t),
    m AS (SELECT t.doc_id, t.page, t.table_id, b.o, b.t, t.y0 - v1 AS gap, greatest(0.0, least(x1, u1) - greatest(x0, u0)) / 400.0 AS over, v0, length(b.t) AS n FROM t JOIN b USING (doc_id, page)),
    g AS (SELECT table_id, arg_min(t, o) FILTER (regexp_matches(t, '^Table ') AND gap BETWEEN -8 AND 160 AND over >= 0.12) AS title, arg_min(t, o) FILTER (regexp_matches(t, 'Glossary') AND gap BETWEEN 0 AND 180 AND over >= 0.1) AS hint, bool_or(t = 'Contents' AND gap BETWEEN 0 AND 220) AS toc,
        arg_min(t, (gap, o)) FILTER (gap > 0 AND gap <= 32 AND v0 > 24 AND over >= 0.25 AND n >= 12) AS before FROM m GROUP BY table_id)
    SELECT table_id, title, hint, coalesce(toc, false) AS toc, before FROM t LEFT JOIN g USING (table_id)""")
def table_contexts(spark, sf_dir):
    """JOIN-08 JOIN-09 SRT-09: titles, hints, contents headings and preceding paragraphs of each table."""
    t, c = order_tables(spark, sf_dir), F.col
    k = c("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("Table "), k.cast("string"), F.lit(" of orders"))).when(k % 4 == 1, "Glossary of it").when(k % 4 == 2, "Contents").otherwise(F.concat(F.lit("A paragraph of order "), k.cast("string")))
    b = t.select("doc_id", "page", k.alias("ordinal"), F.array(c("bbox")[0], c("bbox")[1] - 30, c("bbox")[2], c("bbox")[1] - 12).alias("bbox"), text.alias("text"))
    made = tables.context(t.drop("title", "section_hint"), b, b.select("doc_id", "page", "bbox"))
    return made.select("table_id", "title", c("section_hint").alias("hint"), c("toc_context").alias("toc"), c("preceding_text_block.text").alias("before"))


@query(f"""WITH {SQL_LINES}, c AS (SELECT l_orderkey AS doc_id, no, CASE WHEN l_returnflag = 'N' AND no > 1 THEN '(N-' || l_partkey || ')' ELSE 'v' || l_partkey END AS t, l_returnflag = 'N' AND no > 1 AS up FROM ln),
    g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY no) AS head FROM c)
    SELECT doc_id, CAST(head AS INTEGER) AS k, string_agg(t, chr(10) ORDER BY no) AS text, CAST(count(*) AS INTEGER) AS rowspan, count(*) > 1 AS nested FROM g GROUP BY ALL""")
def merged_cells(spark, sf_dir):
    """WIN-20 TBL-18: short codes in brackets go on in the cell above; cells of several rows are nested."""
    text = F.when((F.col("l_returnflag") == "N") & (F.col("no") > 1), F.concat(F.lit("(N-"), F.col("l_partkey").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("v"), F.col("l_partkey").cast("string")))
    cell = F.struct(F.col("no").cast("int").alias("logical_row"), F.lit(1).alias("col"), text.alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"))
    held = order_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(cell).alias("cells"))
    made = held.select("doc_id", tables.merge_cells(F.col("cells")).alias("m"))
    return made.select("doc_id", F.size(tables.nested_regions(F.col("m"))).alias("spans"), F.posexplode("m").alias("k", "c")).select("doc_id", (F.col("k") + 1).alias("k"), "c.text", "c.rowspan", (F.col("c.rowspan") > 1).alias("nested"))


# --- repairs


@query("""WITH r AS (SELECT p_partkey, ['0001', 'x1234567', 'm3', 'cn', 'util', '12', 'plain'][p_partkey % 7 + 1] AS k, p_partkey % 7 AS kind, ['sequence of files', 'regional part', 'folder for it', 'chapter 1. of'][p_partkey % 4 + 1] AS said, p_partkey % 5 = 0 AS taken, p_partkey % 11 = 0 AS far FROM part)
    SELECT p_partkey, CASE WHEN taken THEN 'old' WHEN far THEN NULL WHEN kind IN (1, 2) OR (kind = 0 AND contains(said, 'sequence')) OR (kind = 3 AND contains(said, 'region')) OR (kind = 4 AND contains(said, 'folder')) OR (kind = 5 AND contains(said, '1.')) THEN k END AS key FROM r""")
def recovered_keys(spark, sf_dir):
    """TBL-08 TBL-11 UDF-09 UDF-10: a key in the first column's band fills a null first cell whose row speaks of its kind."""
    c, k = F.col, F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    none = F.lit(None).cast("string")
    grid = F.array(F.array(F.lit("Key"), F.lit("Name")), F.array(F.when(k % 5 == 0, "old"), pick("sequence of files", "regional part", "folder for it", "chapter 1. of")))
    box = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    rows = F.array(F.struct(box(0, 0, 100, 10).alias("bbox"), box(0, 0, 50, 10).alias("first_bbox")), F.struct(box(0, 10, 100, 20).alias("bbox"), F.lit(None).cast("array<double>").alias("first_bbox")))
    token = F.array(F.struct(pick("0001", "x1234567", "m3", "cn", "util", "12", "plain").alias("text"), F.when(k % 11 == 0, 80.0).otherwise(20.0).alias("x"), F.lit(15.0).alias("y")))
    got = repairs.recover_keys(grid, rows, token, box(0, 0, 100, 20), F.lit(2))
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.get(F.get(got, F.lit(1)), F.lit(0)), none).alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_brand ELSE 'is folder' END AS said, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '05' END AS middle, 'dtd' AS head FROM part""")
def described_listings(spark, sf_dir):
    """TBL-12 UDF-11: a directory listing's row of a two-digit key gets its words right of the middle; a head of several lines hands them down."""
    c, k = F.col, F.col("p_partkey")
    none = F.lit(None).cast("string")
    box = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    head = F.array(F.concat(F.lit("dtd\n"), c("p_type")), F.lit("00"), F.lit("first folder"))
    middle = F.when(k % 2 == 0, none).otherwise("05")
    gap = F.array(none, F.lit("01"), F.when(k % 3 == 0, none).otherwise("is folder"))
    grid = F.concat(F.array(gap, head, F.array(none, middle, F.lit("a folder"))), F.array_repeat(F.array(none, F.lit("09"), F.lit("a folder")), 6))
    rows = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(F.array(F.lit(0.0), i * 10.0, F.lit(100.0), i * 10.0 + 10).alias("bbox")))
    token = lambda t, x: F.struct(F.lit(float(x)).alias("x0"), F.lit(x + 8.0).alias("x1"), t.alias("text"), F.lit(x + 4.0).alias("x"), F.lit(5.0).alias("y"))
    spans = F.array(token(F.lit("left"), 10), token(c("p_name"), 60), token(c("p_brand"), 80))
    got = repairs.repair_listing(grid, rows, spans, F.filter(spans, lambda s: F.lit(False)), box(0, 0, 100, 90), F.lit(3), F.lit(5))
    cell = lambda i, j: F.get(F.get(c("g"), F.lit(i)), F.lit(j))
    return read(spark, sf_dir, "part").withColumn("g", got).select("p_partkey", cell(0, 2).alias("said"), cell(2, 1).alias("middle"), cell(1, 0).alias("head"))


@query("""SELECT p_partkey, 'A ' || p_name AS a, CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE 'B' END AS b, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS changed FROM part""")
def supplemented_grids(spark, sf_dir):
    """TBL-06 TBL-07 TBL-10: spans near each other, joined, fill the null cells at their place; neighbouring duplicates stay."""
    c = F.col
    box = G.box(*[F.lit(float(x)) for x in (0, 0, 100, 40)])
    grid = F.array(F.array(F.lit(None).cast("string"), F.lit("same")), F.array(F.lit("same"), F.when(c("p_partkey") % 2 == 0, "old")))
    span = lambda x0, y0, t: F.struct(F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x0 + 8.0).alias("x1"), F.lit(y0 + 10.0).alias("y1"), F.lit(9.0).alias("size"), t.alias("text"))
    cells = repairs.span_clusters(F.array(span(5.0, 5.0, F.lit("A")), span(14.0, 5.0, c("p_name")), span(70.0, 25.0, F.lit("B"))), box, F.lit(2))
    made = read(spark, sf_dir, "part").withColumn("before", repairs.keep_duplicates(grid)).withColumn("after", repairs.supplement(F.col("before"), cells, box, box, F.lit(2)))
    cell = lambda i, j: F.get(F.get(c("after"), F.lit(i)), F.lit(j))
    return made.select("p_partkey", cell(0, 0).alias("a"), cell(1, 1).alias("b"), repairs.changed_cells(c("before"), c("after")).alias("changed"))


@query("""SELECT p_partkey, 'us-' || p_partkey || '.xml' AS kept, 'us-' AS shadow, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS keys, CAST(2 AS INTEGER) AS names FROM part""")
def rule_runs(spark, sf_dir):
    """TBL-09 UDF-03 UDF-04 UDF-05 UDF-06 UDF-07 UDF-08 TBL-13 TBL-14: the default rules applied, and in a shadow run that reports only."""
    c, k = F.col, F.col("p_partkey")
    none = F.lit(None).cast("string")
    box = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    grid = F.array(F.array(F.lit("us-"), none), F.array(F.concat(k.cast("string"), F.lit(".xml")), none), F.array(F.lit("a.pdf"), none), F.array(none, F.lit("sequence")))
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.array(F.lit(0.0), i * 10.0, F.lit(100.0), i * 10.0 + 10).alias("bbox"), F.lit(None).cast("array<double>").alias("first_bbox")))
    tokens = F.array(F.struct(F.when(k % 2 == 0, "0007").otherwise("word").alias("text"), F.lit(10.0).alias("x"), F.lit(35.0).alias("y")))
    empty = F.array().cast("array<struct<x0:double,x1:double,text:string,x:double,y:double>>")
    run = lambda shadow: repairs.run_rules(c("g"), repairs.default_rules(rows, empty, empty, tokens, box(0, 0, 100, 40), F.lit(2), F.lit(2)), shadow)
    (kept, report), (shadow, _) = run(False), run(True)
    made = read(spark, sf_dir, "part").withColumn("g", grid).select("p_partkey", kept.alias("kept"), report.alias("report"), shadow.alias("shadow"))
    first = lambda g: F.get(F.get(g, F.lit(0)), F.lit(0))
    return made.select("p_partkey", first(c("kept")).alias("kept"), first(c("shadow")).alias("shadow"), c("report")[0]["changed"].alias("keys"), c("report")[2]["changed"].alias("names"))


@query("""WITH t AS (SELECT p_partkey, ['表 4 Doses', p_name || ' text', 'a b', 'c d', '2.1 Scope', ''] AS rows, p_partkey % 2 = 0 AS headed FROM part)
    SELECT p_partkey, CASE WHEN headed THEN p_name || ' text|a b|c d' ELSE 'x y|' || p_name || ' text|a b|c d' END AS rows FROM t JOIN part USING (p_partkey)""")
def pruned_rows(spark, sf_dir):
    """FLT-24: captions above and section headings below a table's rows go."""
    row = lambda t: F.struct(t.alias("text"), F.size(F.filter(F.split(t, " "), lambda x: x != "")).alias("n_words"), F.filter(F.split(t, " "), lambda x: x != "").alias("words"))
    first = F.when(F.col("p_partkey") % 2 == 0, "表 4 Doses").otherwise("x y")
    rows = F.array(*[row(t) for t in (first, F.concat(F.col("p_name"), F.lit(" text")), F.lit("a b"), F.lit("c d"), F.lit("2.1 Scope"), F.lit(""))])
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(words.prune_edges(rows), lambda r: r["text"]), "|").alias("rows"))


# --- rules, jobs and reports


@query("SELECT n_nationkey, ['regulation', 'guideline', 'internal'][n_nationkey % 4 + 1] AS source, 0.0::DOUBLE AS score, 'law' AS label, 'unknown' AS status, n_name AS summary, '' AS evidence FROM nation WHERE n_nationkey % 4 < 3")
def retrieved(spark, sf_dir):
    """FLT-38 FLT-39 FLT-40: placeholder hits of allowed sources, tagged, as responses with defaults."""
    source = F.element_at(F.array(*[F.lit(x) for x in ("regulation", "guideline", "internal", "web")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    hits = rules.tag_source(rules.retrieve(read(spark, sf_dir, "nation").select(F.concat_ws("|", "n_nationkey", "n_name").alias("query"), source.alias("source"))), "law")
    named = hits.withColumns({"key": F.split("query", r"\|")[0].cast("int"), "summary": F.split("query", r"\|")[1]})
    said = rules.format_response(named.select("summary", F.lit(None).cast("string").alias("status"))).select(F.col("summary").alias("said"), "status", "evidence")
    return named.join(said, F.col("summary") == F.col("said")).select(F.col("key").alias("n_nationkey"), "source", "score", F.col("source_label").alias("label"), "status", "summary", "evidence")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, o_orderkey) AS place, printf('PROP-%03d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS proposal FROM (SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 7) / 7.0::DOUBLE END AS score FROM orders)""")
def ranked_findings(spark, sf_dir):
    """SRT-01 UDF-15: by score, a missing one being 0, ties in their order; proposals numbered by document."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 7 / 7.0).alias("score"))
    place = F.row_number().over(Window.orderBy("_at")).cast("bigint")
    return rules.rerank(rules.proposals(o, ["o_orderkey"])).withColumn("_at", F.monotonically_increasing_id()).select("o_orderkey", place.alias("place"), F.col("proposal_id").alias("proposal"))


@query("""SELECT n_regionkey, count(*) FILTER (n_nationkey % 5 = 0) AS m1, count(*) FILTER (n_nationkey % 5 = 2) AS m3, string_agg(n_name, ',' ORDER BY n_name) AS files, 'cmc' AS agent, 'r1/s2/e3' AS versions FROM nation GROUP BY n_regionkey""")
def module_manifests(spark, sf_dir):
    """SRC-30 SRC-33 UDF-13 UDF-14 UDF-18: a map's module lists, a manifest of names, the stub agents and versions."""
    n = read(spark, sf_dir, "nation")
    named = n.groupBy("n_regionkey", F.concat(F.lit("module_"), (F.col("n_nationkey") % 5 + 1).cast("string")).alias("m")).agg(F.collect_list("n_name").alias("names"))
    maps = named.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("m", "names"))).alias("index")).withColumn("b", rules.module_buckets(F.col("index")))
    lists = None
    for k in range(5):
        one = rules.index_manifest(n.where(F.col("n_regionkey") == k).select(F.col("n_name").alias("name"))).withColumn("k", F.lit(k))
        lists = one if lists is None else lists.unionByName(one)
    v = rules.versions("r1", "s2", "e3")
    both = rules.agent_results(maps).join(lists, F.col("n_regionkey") == F.col("k"))
    return both.select("n_regionkey", F.size("b.module_1").cast("bigint").alias("m1"), F.size("b.module_3").cast("bigint").alias("m3"), "files", F.col("agents")[0]["agent"].alias("agent"), F.concat_ws("/", v["rules"], v["schema"], v["engine"]).alias("versions"))


JOBS = "j AS (SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (value > 20) AS ok, count(*) FILTER (value > 5) AS done FROM events GROUP BY user_id)"


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN done = 0 THEN 'queued' WHEN done < total THEN 'processing' WHEN ok = 0 THEN 'failed' WHEN ok < total THEN 'completed_with_warnings' ELSE 'completed' END AS status, CAST(CASE WHEN done = total THEN 100 ELSE 5 + floor(done / total::DOUBLE * 80) END AS INTEGER) AS progress FROM j WHERE done = total OR job_id = 7")
def ready_jobs(spark, sf_dir):
    """CTL-01 CTL-13 CTL-14 CTL-15 CTL-17: jobs whose results may be read, and one looked up."""
    v = F.col("value")
    all_jobs = jobs.job_status(read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.when(v > 5, v > 20).alias("ok")))
    return jobs.ready(all_jobs).unionByName(jobs.lookup(all_jobs, "7")).distinct().select("job_id", "status", "progress")


@query(f"""WITH {PART_FACTS}, d AS (SELECT count(*) AS n, sum(length(text) + CASE WHEN doc_id % 4 = 0 THEN 31 ELSE 0 END) AS chars, sum(len(regexp_extract_all(text, '\\S+')) + CASE WHEN doc_id % 4 = 0 THEN 7 ELSE 0 END) AS tokens FROM documents), f AS (SELECT count(*) AS files FROM pages)
    SELECT 1 AS ordinal, '| Estimated pages/slides | ' || CAST((SELECT sum(CASE WHEN doc_id % 3 = 0 THEN 2 WHEN lang = 'de' THEN 4 WHEN lang <> 'en' THEN 5 WHEN doc_id % 100 > 0 THEN greatest(1, round_even((doc_id % 100) / 24.0, 0)) ELSE 0 END) FROM documents)::BIGINT AS VARCHAR) || ' | Approximate payload scale |' AS line
    UNION ALL SELECT 2, '| Extracted images | ' || n || ' | Image block coverage in source documents |' FROM d UNION ALL SELECT 3, '| Structured tables | ' || 2 * n || ' | Table AST extraction coverage |' FROM d
    UNION ALL SELECT 4, '| Extracted text volume | ' || chars::BIGINT || ' chars / ' || tokens::BIGINT || ' tokens | Text capture throughput |' FROM d
    UNION ALL SELECT 0, '| Parse success rate | ' || printf('%.1f', 100.0 * n / files) || '% (' || n || '/' || files || ') | Parser execution completeness |' FROM d, f""")
def kpi_table(spark, sf_dir):
    """SRC-41 SRC-42: the lines of the table of key figures."""
    return jobs.kpi_lines(facts.key_figures(*_figure_inputs(spark, sf_dir))).where("ordinal < 5")


@query("""SELECT p_partkey - 1 AS idx, '## ' || 'm' || (p_size % 5 + 1) || '-part.pdf' || ' (' || ['PDF', 'WORD', 'XML'][p_partkey % 3 + 1] || ')' || chr(10) || chr(10) || CASE WHEN p_size % 4 > 0 THEN '- Estimated pages: ' || p_size % 4 || chr(10) ELSE '' END || '- Parser strategy: ' || p_brand || chr(10) || chr(10) || '### Atomic Facts' || chr(10)
    || '- **drug_name**: ' || p_name || chr(10) || '- **dosage_form**: ' || p_type || chr(10) || '- **batch_number**: ' || p_partkey || chr(10) || '- **manufacturing_site**: ' || p_brand || chr(10) || '- **strength**: ' || p_size
    || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || chr(10) || '### PDF Pages' || chr(10) || '- Page 1: ' || p_size || ' text blocks' || chr(10) || '- Page 2: 3 text blocks' ELSE '' END
    || chr(10) || chr(10) || '### Text Preview' || chr(10) || '```text' || chr(10) || 'Drug Name: ' || p_name || chr(10) || '剂型: ' || p_type || chr(10) || 'Batch No.: ' || p_partkey || chr(10) || 'Manufacturing Site: ' || p_brand || chr(10) || '规格: ' || p_size || chr(10) || '```' AS section FROM part""")
def document_sections(spark, sf_dir):
    """SRC-43 SRT-06 CTL-16: the full report's section of each document."""
    p = part_documents(spark, sf_dir).join(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), F.col("doc_id") == F.col("p_partkey"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "word", "xml")]), (F.col("doc_id") % 3 + 1).cast("int"))
    page = lambda n, k: F.struct(F.lit(n).alias("page_number"), k.alias("block_count"))
    d = p.select((F.col("doc_id") - 1).alias("idx"), "filename", kind.alias("source_type"), (F.col("p_size") % 4).alias("page_count"), F.col("p_brand").alias("parser_hint"), F.array(page(1, F.col("p_size")), page(2, F.lit(3))).alias("pages"), "text")
    return jobs.full_markdown(d)


@query(f"""WITH {BOXES} SELECT doc_id, CAST(o AS BIGINT) AS o FROM b WHERE doc_id = 1 AND o <= 60""")
def viewer_boxes(spark, sf_dir):
    """FLT-42: the boxes that the viewer draws of one document's page (the limit of 60 is the feature)."""
    b = line_boxes(spark, sf_dir).where("doc_id = 1")
    return jobs.page_boxes(b, 1).select("doc_id", F.col("ordinal").cast("bigint").alias("o"))


@query(f"""WITH {BOXES}, n AS (SELECT doc_id, string_agg(CASE flag WHEN 'R' THEN 'image:i' WHEN 'A' THEN 'table:t' ELSE 'text:b' END || o, ',' ORDER BY y0, x0, CASE flag WHEN 'R' THEN 'image' WHEN 'A' THEN 'table' ELSE 'text' END, o) AS nodes FROM b GROUP BY doc_id) SELECT * FROM n""")
def document_trees(spark, sf_dir):
    """SRT-03 SET-08: text, image and table nodes of a page in reading order."""
    b = line_boxes(spark, sf_dir)
    part = lambda flag, letter, ident: b.where(F.col("l_returnflag") == flag).select("doc_id", "page", "ordinal", "bbox", F.concat(F.lit(letter), F.col("ordinal").cast("string")).alias(ident))
    made = jobs.document_nodes(part("N", "b", "block_id"), part("R", "i", "image_id"), part("A", "t", "table_id"))
    return made.select("doc_id", F.array_join(F.transform("nodes", lambda n: F.concat_ws(":", n["kind"], n["id"])), ",").alias("nodes"))


@query("""WITH p AS (SELECT p_size AS doc_id, p_partkey AS page, 'Drug Name: ' || p_name AS t FROM part), d AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY page) AS text, arg_min(t, page) AS first FROM p GROUP BY doc_id) SELECT doc_id, text, replace(first, 'Drug Name: ', '') AS drug FROM d""")
def texts_of_documents(spark, sf_dir):
    """AGG-07 SRT-02 SRT-03: the pages' texts in order, and the facts in them."""
    pages = read(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("page"), F.concat(F.lit("Drug Name: "), F.col("p_name")).alias("text"))
    return jobs.document_texts(pages).select("doc_id", "text", F.element_at("facts", "drug_name").alias("drug"))


@query("SELECT CAST(min(p_partkey) - 1 AS INTEGER) AS idx, '/api/v1/files/f' || min(p_partkey) AS file_url, false AS rule_checks_enabled FROM part WHERE p_partkey % 3 = 0")
def workbench_view(spark, sf_dir):
    """CTL-02: the first PDF of the upload."""
    d = read(spark, sf_dir, "part").select((F.col("p_partkey") - 1).cast("int").alias("idx"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_id"), F.when(F.col("p_partkey") % 3 == 0, "pdf").otherwise("word").alias("source_type"))
    return jobs.workbench(d).select("idx", "file_url", "rule_checks_enabled")


@query("SELECT 'run1' AS run_id, 'job1' AS job_id, 'completed' AS status, 'parse: Parsed ' || (SELECT count(*) FROM documents) || ' document(s)' AS first, 3 AS n_events")
def audit_events(spark, sf_dir):
    """AGG-05."""
    log = facts.audit_log(facts.key_figures(*_figure_inputs(spark, sf_dir)), "run1", "job1", "completed")
    return log.select("run_id", "job_id", "status", F.concat_ws(": ", F.col("events")[0]["step"], F.col("events")[0]["message"]).alias("first"), F.size("events").alias("n_events"))


@query(f"""WITH {SAMPLES}, s AS (SELECT *, p_size % 4 AS row FROM t) SELECT p_partkey, CASE WHEN row <= 1 THEN 'HEADER' WHEN regexp_full_match(trim(t), '[（(][A-Za-z0-9.\\-_/]{{2,28}}[)）]') THEN 'CONTINUATION' WHEN regexp_matches(lower(t), '^(?:合计|总计|小计|共计|平均|mean|total|sum)|[总共计]\\s*\\d+') THEN 'AGGREGATE'
    WHEN regexp_matches(trim(t), '^(?:[*†‡§¶]|\\d+\\))') OR regexp_matches(lower(t), '^(?:注|说明|备注|note):') THEN 'ANNOTATION' ELSE 'DATA' END AS state, CASE WHEN row <= 1 THEN 0.9 WHEN regexp_full_match(trim(t), '[（(][A-Za-z0-9.\\-_/]{{2,28}}[)）]') THEN 0.8 WHEN regexp_matches(lower(t), '^(?:合计|总计|小计|共计|平均|mean|total|sum)|[总共计]\\s*\\d+') THEN 0.7
    WHEN regexp_matches(trim(t), '^(?:[*†‡§¶]|\\d+\\))') OR regexp_matches(lower(t), '^(?:注|说明|备注|note):') THEN 0.6 ELSE 0.7 END AS confidence FROM s""")
def cell_state_kinds(spark, sf_dir):
    """TBL-17: every kind of cell."""
    state = tables.cell_state(F.col("t"), F.col("p_size") % 4, F.lit(0))
    return samples(spark, sf_dir).select("p_partkey", state["state"].alias("state"), r6(state["confidence"]).alias("confidence"))


MOJIBAKE = (("药" * 10, True), ("药" * 10 + " a b c", False), ("药" * 9 + "12", False), ("药" * 420, True), ("药" * 290 + "x" * 130, True), ("药" * 270 + "x" * 150, False), ("药\n" * 400, False), ("", True), ("plain words", False), ("药药 药药 药药", False))


@query(f"SELECT p_partkey, [{', '.join(str(m).lower() for _, m in MOJIBAKE)}][p_partkey % {len(MOJIBAKE)} + 1] AS mojibake FROM part")
def mojibake_cases(spark, sf_dir):
    """FLT-36 STR-28, against what each text must be taken for."""
    text = F.element_at(F.array(*[F.lit(t) for t, _ in MOJIBAKE]), (F.col("p_partkey") % len(MOJIBAKE) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.is_mojibake(text).alias("mojibake"))


@query("""SELECT p_partkey, '药品名称' || p_partkey || chr(10) || '说明书第' || p_size || '页' AS text, CAST(2 AS INTEGER) AS units, 'doc-plain-text' AS hint FROM part""")
def plain_word_files(spark, sf_dir):
    """SRC-21 SRC-22 SRC-23 SRC-24 SRC-25: legacy Word content that is plain text, in UTF-8 or UTF-16, decoded by the best quality."""
    from dossio.sources import files

    c = F.col
    text = F.concat(F.lit("药品名称"), c("p_partkey").cast("string"), F.lit("\n说明书第"), c("p_size").cast("string"), F.lit("页"))
    raw = F.when(c("p_size") % 4 == 1, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "UTF-8"))
    got = files.documents(files.decode(read(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("path"), F.lit(".doc").alias("suffix"), raw.alias("content"))))
    return got.select(c("path").cast("bigint").alias("p_partkey"), "text", c("n_units").alias("units"), c("parser_hint").alias("hint"))


@query("""WITH n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), u AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN [{'p': NULL, 't': n_name}, {'p': NULL, 't': 'Drug Name: ' || n_regionkey}] WHEN 1 THEN [{'p': NULL, 't': n_name || chr(10) || 'shape two'}, {'p': NULL, 't': 'second ' || n_regionkey}]
    ELSE [{'p': '/r[0]', 't': ''}, {'p': '/r[0]/a[0]', 't': n_name}, {'p': '/r[0]/b[1]', 't': 'k ' || n_regionkey}] END AS us FROM n)
    SELECT n_nationkey, CAST(i AS INTEGER) AS i, coalesce(us[i].p, '') AS pointer, us[i].t AS text, CASE n_nationkey % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'presentation' ELSE 'xml' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN 7 ELSE 0 END AS pages FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM u)""")
def office_files(spark, sf_dir):
    """SRC-18 SRC-19 SRC-20 SRC-27 SRC-28 SRC-29 JOIN-15: Word, slide and XML files made from nations, and what they decode to."""
    import io
    import zipfile

    from dossio.sources import files

    def make(batches):
        for b in batches:
            rows = []
            for key, name, region in zip(b["n_nationkey"], b["n_name"], b["n_regionkey"], strict=True):
                held = io.BytesIO()
                if key % 3 == 2:
                    rows.append((str(key), ".xml", f"<r><a x='1'>{name}</a><b>k  {region}</b></r>".encode()))
                    continue
                with zipfile.ZipFile(held, "w") as z:
                    if key % 3 == 0:
                        body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in (name, "", f"Drug Name: {region}"))
                        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.W[1:-1]}"><w:body>{body}</w:body></w:document>')
                        z.writestr("docProps/app.xml", "<Properties><Pages>7</Pages></Properties>")
                    else:
                        for k, shapes in enumerate(((name, "shape two"), (f"second {region}",)), 1):
                            made = "".join(f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>" for t in shapes)
                            z.writestr(f"ppt/slides/slide{k}.xml", f'<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="{files.A[1:-1]}">{made}</p:sld>')
                rows.append((str(key), ".docx" if key % 3 == 0 else ".pptx", held.getvalue()))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["path", "suffix", "content"])

    made = read(spark, sf_dir, "nation").mapInPandas(make, "path string, suffix string, content binary")
    units = files.decode(made).select("path", "source_type", "page_count", F.posexplode("units").alias("i", "u"))
    return units.select(F.col("path").cast("int").alias("n_nationkey"), (F.col("i") + 1).alias("i"), F.coalesce("u.pointer", F.lit("")).alias("pointer"), "u.text", F.col("source_type").alias("kind"), F.coalesce("page_count", F.lit(0)).alias("pages"))
