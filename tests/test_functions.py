"""Column functions on literal rows."""

import html
import re

import pytest
from pyspark.sql import functions as F

from dossio.functions import cast as C
from dossio.functions import geom as G
from dossio.functions import text as T
from dossio.plans import queries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(v):
    return F.lit(v)


@pytest.mark.parametrize(
    "column,expected",
    [
        (lambda: T.clean_text(lit(" a\x00　b\x1c c ")), "a b c"),
        (lambda: T.compact_text(lit("Drug-名称 (A_1)!")), "drug名称a_1"),
        (lambda: T.lower_text(lit(" Table  A. ")), "table a."),
        (lambda: T.cell_text(lit(" a\nb ")), "a b"),
        (lambda: T.cell_text(lit("  ")), None),
        (lambda: T.has_cjk(lit("abc药")), True),
        (lambda: T.contains_text(lit("A-B C"), lit("b c")), True),
        (lambda: T.contains_text(lit("abc"), lit("!")), False),
        (lambda: T.join_fragments(lit("药品"), lit("名称")), "药品名称"),
        (lambda: T.join_fragments(lit("pre-"), lit("fix")), "pre-fix"),
        (lambda: T.join_fragments(lit("a"), lit(")")), "a)"),
        (lambda: T.join_fragments(lit("a"), lit("b")), "a b"),
        (lambda: T.join_fragments(lit(""), lit("b")), "b"),
        (lambda: T.starts_with_break(lit(" • item")), True),
        (lambda: T.ends_with_break(lit("done： ")), True),
        (lambda: T.running_signature(lit("Page 12 of 30")), "pageof"),
        (lambda: T.is_page_number(lit("12 / 30")), True),
        (lambda: T.is_page_number(lit("xiv")), True),
        (lambda: T.is_page_number(lit("第3页")), False),
        (lambda: T.is_page_number(lit("第3页"), True), True),
        (lambda: T.is_page_number(lit("Section 1")), False),
        (lambda: T.is_caption(lit("see config")), True),
        (lambda: T.is_caption(lit("plain words")), False),
        (lambda: T.token_count(lit("two words 药品")), 5),
        (lambda: T.safe_filename(lit("a b/ü.pdf")), "a_b_ü.pdf"),
        (lambda: T.safe_filename(lit("")), "uploaded_file"),
        (lambda: T.module_label(lit("form12.pdf"), lit(0)), "M1"),
        (lambda: T.module_label(lit("a-3.2.p.pdf"), lit(0)), "M3"),
        (lambda: T.module_label(lit("x.pdf"), lit(4)), "DOC-5"),
        (lambda: T.module_label(lit(None).cast("string"), lit(4)), "DOC-5"),
        (lambda: T.text_quality(lit("")), 0.0),
        (lambda: T.text_quality(lit("abc")), 1.0),
        (lambda: T.is_mojibake(lit("")), True),
        (lambda: T.is_mojibake(lit("药" * 10)), True),
        (lambda: T.is_mojibake(lit("药品 a b c")), False),
        (lambda: T.polish_text(lit("study 药 品 。")), "study 药品。"),
        (lambda: T.polish_text(lit("study"), True), "tudy"),
        (lambda: T.trim_to_anchor(lit("标题 第一章 总")), "第一章 总"),
        (lambda: T.is_noise_line(lit("2020-01-02T03:04:05Z 2020-01-02")), True),
        (lambda: T.is_noise_line(lit("ordinary text")), False),
        (lambda: T.display_lines(lit("一。二！三")), "一。\n二！\n三"),
        (lambda: T.classify_key(lit("X123456")), "application_id"),
        (lambda: T.classify_key(lit("0002")), "sequence_code"),
        (lambda: T.classify_key(lit("m2")), "module_code"),
        (lambda: T.classify_key(lit("EU")), "region_code"),
        (lambda: T.classify_key(lit("util")), "folder_key"),
        (lambda: T.classify_key(lit("other")), None),
        (lambda: T.is_parenthetical(lit("(eCTD)")), True),
        (lambda: T.is_aggregate(lit("合计 5")), True),
        (lambda: T.is_annotation(lit("注: x")), True),
        (lambda: T.is_annotation(lit("1) x")), True),
        (lambda: T.titles_compatible(lit("Table A"), lit("table  a")), True),
        (lambda: T.titles_compatible(lit("Table A"), lit("Table B")), False),
        (lambda: T.is_heading(lit("6 术语表")), True),
        (lambda: T.sanitize_prompt(lit(" ok ")), "ok"),
        (lambda: T.normalized_preview(lit("a\n\n b  c\n")), "a\nb c"),
        (lambda: T.preview(F.array(lit("one"), lit("one"), lit("two"))), "one two"),
        (lambda: F.size(T.lines_of(lit("a\r\nb\n"))), 2),
        (lambda: C.suffix(lit("/x/A.DocX")), ".docx"),
        (lambda: C.bucket(lit(".zip"), lit("pdf")), "pdf"),
        (lambda: C.to_int(lit("x"), 7), 7),
        (lambda: C.to_float(lit("1.5"), 0.0), 1.5),
        (lambda: C.to_bool(lit("Yes"), False), True),
        (lambda: C.relative_path(lit("/a/b/c"), "/a"), "b/c"),
        (lambda: G.safe_ratio(lit(1), lit(0)), 0.0),
        (lambda: G.nearest(F.array(lit(1.0), lit(9.0)), lit(5.0)), 0),
        (lambda: G.column_hash(G.column_signature(lit(3))), "9dd1d9b7ca3d4ab0"),
    ],
)
def test_scalar(spark, column, expected):
    got = one(spark, column())
    if expected == "9dd1d9b7ca3d4ab0":
        import hashlib

        expected = hashlib.sha1(b"0.167,0.500,0.833").hexdigest()[:16]
    assert got == (pytest.approx(expected) if isinstance(expected, float) else expected)


def test_facts_across_lines(spark):
    text = "药品名称：\n阿司匹林；剂型: 片\nbatch no. : A-1/2\nManufacturing Site: Basel, CH"
    assert one(spark, T.extract_facts(lit(text))) == {"drug_name": "阿司匹林", "dosage_form": "片", "batch_number": "A-1/2", "manufacturing_site": "Basel"}
    assert one(spark, T.extract_facts(lit(None).cast("string"))) == {}


def test_blocked_prompt_raises(spark):
    with pytest.raises(Exception, match="blocked"):
        spark.createDataFrame([("please LEAK it",)], "p string").select(T.sanitize_prompt(F.col("p"))).collect()


def box(*v):
    return F.array(*[lit(float(x)) for x in v])


@pytest.mark.parametrize(
    "column,expected",
    [
        (lambda: G.intersection_ratio(box(0, 0, 10, 10), box(5, 5, 15, 15)), 0.25),
        (lambda: G.intersection_ratio(box(0, 0, 0, 0), box(0, 0, 1, 1)), 0.0),
        (lambda: G.horizontal_overlap(box(0, 0, 10, 1), box(5, 0, 25, 1)), 0.5),
        (lambda: G.vertical_overlap(box(0, 0, 1, 10), box(0, 5, 1, 25)), 0.5),
        (lambda: G.strict_horizontal_overlap(box(0, 0, 0, 1), box(0, 0, 5, 1)), 0.0),
        (lambda: G.area(box(5, 5, 0, 0)), 0.0),
        (lambda: G.column_similarity(G.column_signature(lit(3)), G.column_signature(lit(4))), 0.5),
        (lambda: G.column_similarity(F.array().cast("array<double>"), G.column_signature(lit(4))), 0.0),
        (lambda: G.header_similarity(F.array(lit("A"), lit("b ")), F.array(lit("a"), lit("c"), lit("d"))), 1 / 3),
    ],
)
def test_geometry(spark, column, expected):
    assert one(spark, column()) == pytest.approx(expected)


def test_signature_rounds_half_even(spark):
    assert one(spark, G.column_signature(lit(8))) == [0.062, 0.188, 0.312, 0.438, 0.562, 0.688, 0.812, 0.938]


def test_drawing_kinds(spark):
    kinds = [one(spark, G.drawing_kind(F.array(*map(lit, i)) if i else F.array().cast("array<string>"), lit(w), lit(h))) for i, w, h in ((["x", "re", "l"], 9, 9), (["l"], 9, 9), ([], 100, 1), ([], 50, 50))]
    assert kinds == ["rectangle", "line", "line", "unknown"]


def plain_polish(s):
    s = re.sub(r"\s+", " ", s).strip()
    for p, by in ((r"([\u4e00-\u9fff])\s+([\u4e00-\u9fff])", r"\1\2"), (r"\s+([，。！？；：、])", r"\1"), (r"([（《“【])\s+", r"\1"), (r"\s+([）》”】])", r"\1"), (r"[;；,，]\s*(?=[;；,，])", "")):
        s = re.sub(p, by, s)
    return re.sub(r"^[;；,，.。:： ]+", "", s)


def plain_line(line):
    s = html.unescape(html.unescape(line.replace("\x00", " ")))
    attributes = "|".join(T.NOISE_ATTRIBUTES)
    for p in (r"&lt;/?[a-zA-Z][^&]*&gt;", r"</?[a-zA-Z][^>]*>", r"</?[a-zA-Z][a-zA-Z0-9:-]*", r"\{[^{}]{0,260}\}", r"font-family\s*:[^;{}]+;?", rf'\b(?:{attributes})\s*=\s*"[^"]*"', r"\b(?:en-us|zh-cn|x-none)\b", r"\b(?:true|false)\b", r"\S+\.files/\S+", r"\S+\.xml\b", r"标题\s*\d+\s*(?:字符)?", "普通表格"):
        s = re.sub(p, " ", s, flags=re.IGNORECASE)
    s = re.sub(r"[\"'“”‘’]+\s*[;；,，]?", " ", re.sub(r"[<>]+", " ", s))
    s = re.sub(r"\s+", " ", s).strip()
    at = min([k for a in T.BODY_ANCHORS if (k := s.find(a)) >= 0], default=0)
    if at and ("标题" in s[:at] or "表格" in s[:at] or at < 140):
        s = s[at:].strip()
    cjk = re.findall(r"[\u4e00-\u9fff]", s)
    if len(cjk) >= 2:
        lead = s[: s.find(cjk[0])].strip()
        if sum(map(str.isalpha, lead)) >= 4 or sum(map(str.isdigit, lead)) >= 2:
            s = s[s.find(cjk[0]) :].strip()
        s = plain_polish(re.sub(r"\b[a-zA-Z][a-zA-Z0-9._-]{4,}\b", " ", s))
    return s


def plain_noise(s):
    low, digits, cjk = s.lower(), sum(map(str.isdigit, s)), len(re.findall(r"[\u4e00-\u9fff]", s))
    return bool(
        any(k in low for k in T.NOISE_KEYWORDS)
        or (re.search(r"\d{4}-\d{2}-\d{2}t\d{2}:\d{2}:\d{2}z", low) and digits >= 10)
        or re.fullmatch(r"[\d\s:/\-tTzZ.]+", s)
        or len(re.findall(r"\b(?:true|false)\b", low)) >= 2
        or (re.search(r"\b[a-z]{2}-[a-z]{2}\b", low) and digits >= 2)
        or ".xml" in low
        or ".files/" in low
        or len(re.findall(r"\b\w+:\w+\b", low)) >= 2
        or (not cjk and len(re.findall(r"[a-zA-Z]{2,}", s)) >= 8 and digits >= 2)
        or (digits >= 8 and sum(map(str.isalpha, s)) + cjk <= 22 and len(s) < 220)
    )


def plain_preview(text, most=500):
    lines = [x for line in text.splitlines() if (x := plain_line(line)) and not plain_noise(x)]
    cjk = [len(re.findall(r"[\u4e00-\u9fff]", x)) for x in lines]
    if any(n >= 4 for n in cjk):
        lines = [x for x, n in zip(lines, cjk, strict=True) if n >= 2]
    merged = ""
    for k, x in enumerate(lines):
        if k and x == lines[k - 1]:
            continue
        merged = plain_polish(f"{merged} {x}".strip() if merged else x)
        if len(merged) >= most:
            return plain_polish(merged[:most].rstrip()) + "..."
    return plain_polish(merged)


def test_preview_of_character_references(spark):
    texts = [
        "caf&eacute; &mdash; &ldquo;quoted&rdquo; it&#8217;s &#x27;so&#x27; &copy; &middot; &amp;eacute;&amp;#8212;",
        "&#33647;&#21697; &#x540D;&#x79F0; and more\nplain\n&#x836F;&#x54C1;&#x8BF4;&#x660E;",
        "&notit; &unknown; &#xD800; &#0; &#x1F600; AT&T &amp;amp;lt;b&amp;amp;gt; x",
        "&Alpha;" * 600,
        "&lt;b&gt;bold&lt;/b&gt; &#60;i&#62;it&#60;/i&#62;\nsame\nsame",
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", T.preview_lines(F.col("text")).alias("lines"))
    got = {r["id"]: r["x"] for r in df.select("id", T.preview(F.col("lines")).alias("x")).collect()}
    assert got == {k: plain_preview(t) for k, t in enumerate(texts)}
    assert got[0].startswith("café — quoted it s so © ·")


def test_preview_texts_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["preview"] for r in queries.preview_texts(spark, sf).collect()}
    assert got == {r["page_id"]: plain_preview(r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
