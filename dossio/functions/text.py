"""Text functions as Column expressions.

White space and word characters are Unicode's ((?U)), plus U+001C to U+001F, which count as white space
here.  A null input gives null unless said otherwise.
"""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from dossio.functions.fold import changes, once

SPACE = r"\s\x1c-\x1f"
#: The same as a string of characters, for trimming, and as ranges, which test faster.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
RANGES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"[\x{4E00}-\x{9FFF}]"
#: Words that mark a figure's caption, and fact labels in both languages with what may follow them.
CAPTION_WORDS = ("figure", "fig", "图", "图表", "表", "chart", "illustration")
_VALUE = r"([^\n,;；，]+)"
FACT_PATTERNS = {
    "drug_name": rf"(?iu)(?:药品名称|Drug Name)(?U)\s*[:：]\s*{_VALUE}",
    "dosage_form": rf"(?iu)(?:剂型|Dosage Form)(?U)\s*[:：]\s*{_VALUE}",
    "batch_number": r"(?iu)(?:批号|Batch(?U)(?:\s*(?:No\.?|Number))?)\s*[:：]\s*([A-Za-z0-9._/-]+)",
    "manufacturing_site": rf"(?iu)(?:生产地|生产地址|Manufacturing Site)(?U)\s*[:：]\s*{_VALUE}",
    "strength": rf"(?iu)(?:规格|Strength)(?U)\s*[:：]\s*{_VALUE}",
}
#: Of each label a part in small letters (none of i, k and s, which have odd capitals) and the Chinese one.
FACT_PARTS = {"drug_name": ("drug", "药品名称"), "dosage_form": ("age form", "剂型"), "batch_number": ("batch", "批号"), "manufacturing_site": ("nufactur", "生产地"), "strength": ("trength", "规格")}
FACT_KEYS = tuple(sorted(FACT_PATTERNS))
#: Substrings that make a preview line noise.
NOISE_KEYWORDS = (
    "author",
    "lastauthor",
    "revision",
    "totaltime",
    "created",
    "lastsaved",
    "generator",
    "originator",
    "documentproperties",
    "progid",
    "file-list",
    "microsoft word",
    "word.document",
    "urn:schemas",
    "schema",
    "xmlns",
    "w3.org/tr/rec-html40",
    "colorschememapping",
    "latentstyles",
    "deflockedstate",
    "defunhidewhenused",
    "defsemihidden",
    "defqformat",
    "defpriority",
    "latentstylecount",
    "mso-",
)
#: Attributes of office styles, whose settings are noise in a preview line.
NOISE_ATTRIBUTES = ("unhidewhenused", "name", "id", "qformat", "semihidden", "priority", "latentstylecount", "deflockedstate", "defunhidewhenused", "defsemihidden", "defqformat", "defpriority")
#: Words that are noise in a preview line, and headings of style lists.
NOISE_LITERALS = ("en-us", "zh-cn", "x-none", "true", "false")
STYLE_HEADINGS = (r"标题\s*\d+\s*(?:字符)?", "普通表格")
#: Anchors at which a body begins.
BODY_ANCHORS = ("中华人民共和国", "第一章", "第一条", "总则")
CONTINUED_WORDS = ("continued", "continued from", "续表", "续页")
GLOSSARY_WORDS = ("术语表", "词汇表", "glossary")
REGION_CODES = ("cn", "us", "eu", "jp", "kr", "au", "ca", "uk")
FOLDER_KEYS = ("dtd", "util", "style")
BLOCKED_PROMPTS = ("ignore previous instructions", "exfiltrate", "leak")


def _any(words, whole: bool = False) -> str:
    body = "|".join(w.replace(".", r"\.") for w in words)
    return f"^(?:{body})$" if whole else body


def char_count(c: Column, kinds: str) -> Column:
    """How many characters are of a class (what stands in brackets): the length less that without its runs, so no match is kept."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{kinds}]+", ""))


def squeezed(c: Column, also: str = "") -> Column:
    """Runs of white space as one space; single spaces, the usual case, aren't touched."""
    run = RANGES + also
    return F.regexp_replace(c, rf"[{run}&&[^ ]][{run}]*| [{run}]+", " ")


def clean_text(c: Column) -> Column:
    """NULs to spaces, white space collapsed, trimmed."""
    return F.trim(squeezed(c, r"\x00"))


def compact_text(c: Column) -> Column:
    """Lower case, word characters only."""
    return F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\w]+", "")


def lower_text(c: Column) -> Column:
    """White space collapsed and lower case; punctuation stays (how titles compare)."""
    return F.lower(F.trim(squeezed(c)))


def cell_text(c: Column) -> Column:
    """Trimmed, newlines to spaces, empty to null (how table cells are read)."""
    return F.nullif(F.translate(strip(c), "\n", " "), F.lit(""))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def cjk_count(c: Column) -> Column:
    return char_count(c, CJK[1:-1])


def contains_text(source: Column, target: Column) -> Column:
    """Whether the compact target is in the compact source; false when either is empty."""
    a, b = compact_text(source), compact_text(target)
    return F.coalesce((a != "") & (b != "") & F.contains(a, b), F.lit(False))


def starts_with_break(c: Column) -> Column:
    return strip(c).rlike(r"^[•\-·●◆()（）\[\]]")


def ends_with_break(c: Column) -> Column:
    return strip(c).rlike(r"[。！？；:：]$")


def join_fragments(left: Column, right: Column) -> Column:
    """Joins two pieces of a line: without a space between CJK, after a hyphen, slash or opening, before a closing."""
    tight = (has_cjk(F.right(left, F.lit(1))) & has_cjk(F.left(right, F.lit(1)))) | left.rlike(r"[-(（/／]$") | right.rlike(r"^[)）\]】%％]")
    return F.when(left == "", right).when(right == "", left).when(tight, F.concat(left, right)).otherwise(F.concat(left, F.lit(" "), right))


def running_signature(c: Column) -> Column:
    """Compact text without digits: equal for the same header on every page."""
    return F.regexp_replace(compact_text(c), r"(?U)\d+", "")


def is_page_number(c: Column, chinese: bool = False) -> Column:
    """A page number: digits, n/m, n-m, Roman letters alone, or one letter.  ``chinese`` adds the form 第n页."""
    t = clean_text(c)
    found = t.rlike(r"(?U)^(?:菴\s*)?\d{1,4}(?:\s*/\s*\d{1,4})?(?:\s*珜)?$") | t.rlike(r"(?U)^\d{1,4}\s*[-每〞]\s*\d{1,4}$") | t.rlike(r"(?i)^[ivxlcdm]+$") | t.rlike(r"^\p{L}$")
    return found | t.rlike(r"(?U)^第\s*\d{1,4}\s*页$") if chinese else found


def is_caption(c: Column) -> Column:
    return F.coalesce(compact_text(c).rlike(_any(CAPTION_WORDS)), F.lit(False))


def extract_fact(text: Column, fact: str) -> Column:
    """The first value of a fact; texts without a part of its label, which cost no more than a search for it, aren't parsed."""
    low = F.lower(text)
    said = F.contains(low, F.lit(FACT_PARTS[fact][0])) | F.contains(text, F.lit(FACT_PARTS[fact][1]))
    return F.when(said, strip(F.regexp_extract(text, FACT_PATTERNS[fact], 1))).otherwise("")


def extract_facts(text: Column) -> Column:
    """map<string,string> of the facts found, first match each; a fact not found has no key."""
    pairs = F.create_map(*[x for k in FACT_PATTERNS for x in (F.lit(k), extract_fact(F.coalesce(text, F.lit("")), k))])
    return F.map_filter(pairs, lambda _, v: v != "")


def space_tokens(c: Column) -> Column:
    """How many runs without white space: the spaces that are left when a line is squeezed, and one."""
    line = clean_text(F.translate(c, "\x00", "0"))
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def token_count(c: Column) -> Column:
    """White-space tokens plus CJK characters."""
    return space_tokens(c) + cjk_count(c)


def safe_filename(c: Column) -> Column:
    """Everything but letters, digits, underscore, hyphen and full stop becomes an underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"[^\p{L}\p{N}_.\-]", "_"), F.lit("")), F.lit("uploaded_file"))


def module_label(filename: Column, index: Column) -> Column:
    """M1 to M5 by what the name contains, the first that matches; else DOC-n."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    label = None
    for k in range(1, 6):
        hit = F.contains(name, F.lit(f"m{k}")) | F.contains(name, F.lit(f"module{k}"))
        hit = hit | F.contains(name, F.lit("3.2")) if k == 3 else hit
        label = F.when(hit, f"M{k}") if label is None else label.when(hit, f"M{k}")
    return label.otherwise(F.concat(F.lit("DOC-"), (index + 1).cast("string")))


def lines_of(c: Column) -> Column:
    """Lines as Python's splitlines gives them: no empty last line."""
    parts = F.split(c, r"\R|[\x1c-\x1e]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def paragraphs_of(c: Column) -> Column:
    """array<struct<index,text>> of the lines with text, cleaned; index counts all lines."""
    cleaned = F.transform(lines_of(c), lambda x, i: F.struct(i.alias("index"), clean_text(F.translate(x, "\x00", "")).alias("text")))
    return F.filter(cleaned, lambda p: p["text"] != "")


def normalized_preview(c: Column, max_lines: int = 80) -> Column:
    return strip(F.array_join(F.transform(F.slice(paragraphs_of(c), 1, max_lines), lambda p: p["text"]), "\n"))


def text_quality(c: Column) -> Column:
    """0.45 printable share + 0.55 informative share - 1.5 replacement share; 0 for the empty text."""
    n = F.length(c)
    printable = n - char_count(c, r"\p{C}\p{Z}&&[^\x20]")
    informative = n - char_count(c, r"^a-zA-Z0-9\p{L}\p{N}，。；：、（）《》“”‘’！？,.:;!?()\[\]{}+\-/_")
    replaced = n - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return F.when(n == 0, F.lit(0.0)).otherwise(printable / n * 0.45 + informative / n * 0.55 - replaced / n * 1.5)


def is_mojibake(c: Column) -> Column:
    """Empty, or Chinese nearly throughout without the lines, words or letters that such a text would have; other texts aren't looked into."""
    n, cjk = F.length(c), cjk_count(c)
    rows = F.size(F.filter(lines_of(c), lambda x: strip(x) != ""))
    giant = (n > 400) & (space_tokens(c) <= 4) & (rows <= 3)
    short = (cjk / n > 0.85) & ~c.rlike("[A-Za-z]") & (space_tokens(c) <= 2)
    return F.when(F.coalesce(n, F.lit(0)) == 0, True).otherwise((cjk / n > 0.65) & (giant | short))


def polish_text(c: Column, drop_leading_s: bool = False) -> Column:
    """Tidies spaces and punctuation of mixed Chinese text.  ``drop_leading_s`` repeats an old slip that also drops leading letters s.

    No space between two Chinese characters (of three in a row with spaces, the first pair joins), before closing
    marks and after opening ones; of separators in a row the last stays; none leads.
    """
    spaced = strip(F.regexp_replace(c, rf"(?U)[{SPACE}]+", " "))
    joined = F.regexp_replace(spaced, rf"({CJK}) +({CJK})", "$1$2")
    tight = F.regexp_replace(joined, " +(?=[，。！？；：、）》”】])|(?<=[（《“【]) +", "")
    single = F.regexp_replace(tight, "[;；,，] *(?=[;；,，])", "")
    return F.regexp_replace(single, r"^[;；,，.。:：\\s]+" if drop_leading_s else "^[;；,，.。:： ]+", "")


@F.udf(ArrayType(StringType()), useArrow=True)
def _unescaped(lines):
    return None if lines is None else [x if x is None or "&" not in x else html.unescape(html.unescape(x)) for x in lines]


def unescape_html(lines: Column) -> Column:
    """Each line of an array with its character references decoded as HTML does, twice over."""
    return _unescaped(lines)


def _noise_passes() -> list[str]:
    """What goes from a preview line, pass by pass: a later pass sees what an earlier one joined.  The patterns are fixed values."""
    some = lambda words: "(?:" + "|".join(words) + ")"
    tag = r"</?[a-zA-Z](?:[^>]*>|[a-zA-Z0-9:-]*)"  # closed somewhere on the line, else the name alone
    return [
        r"&lt;/?[a-zA-Z][^&]*&gt;",
        tag,
        r"\{[^{}]{0,260}\}",
        r"font-family\s*:[^;{}]+;?",
        rf'\b{some(NOISE_ATTRIBUTES)}\s*=\s*"[^"]*"',
        rf"\b{some(NOISE_LITERALS)}\b",
        r"\S+\.files/\S+|\S+\.xml\b",
        some(STYLE_HEADINGS),
        r"[<>]+",
        r"[\"'“”‘’]+\s*[;；,，]?",
    ]


def strip_inline_noise(c: Column) -> Column:
    """Markup, style and office attributes out of a line whose references are decoded."""
    for p in _noise_passes():
        c = F.regexp_replace(c, "(?iU)" + p, " ")
    return clean_text(c)


def trim_to_anchor(c: Column) -> Column:
    """From the first body anchor on, if little or only headings stand before it."""
    at = F.least(*[F.nullif(F.instr(c, a), F.lit(0)) for a in BODY_ANCHORS])
    before = F.left(c, at - 1)
    drop = (at > 1) & (F.contains(before, F.lit("标题")) | F.contains(before, F.lit("表格")) | (F.length(before) < 140))
    return F.when(F.coalesce(drop, F.lit(False)), strip(F.substring(c, at, F.length(c)))).otherwise(c)


def is_noise_line(c: Column) -> Column:
    low, count = F.lower(c), lambda p: F.regexp_count(c, F.lit(p))
    digits, letters, cjk = char_count(c, r"\p{Nd}"), char_count(c, r"\p{L}"), cjk_count(c)
    words = _any(NOISE_KEYWORDS)
    return (
        low.rlike(words)
        | (low.rlike(r"\d{4}-\d{2}-\d{2}t\d{2}:\d{2}:\d{2}z") & (digits >= 10))
        | c.rlike(rf"(?U)^[\d{SPACE}:/\-tTzZ.]+$")
        | (F.regexp_count(low, F.lit(r"(?U)\b(?:true|false)\b")) >= 2)
        | (low.rlike(r"(?U)\b[a-z]{2}-[a-z]{2}\b") & (digits >= 2))
        | F.contains(low, F.lit(".xml"))
        | F.contains(low, F.lit(".files/"))
        | (F.regexp_count(low, F.lit(r"(?U)\b\w+:\w+\b")) >= 2)
        | ((cjk == 0) & (count("[a-zA-Z]{2,}") >= 8) & (digits >= 2))
        | ((digits >= 8) & (letters + cjk <= 22) & (F.length(c) < 220))
    )


def _body_line(c: Column) -> Column:
    """A line of Chinese text without its Latin lead-in and long Latin tokens."""
    first = F.regexp_instr(c, F.lit(CJK))
    lead = F.left(c, first - 1)
    cut = (first > 1) & ((char_count(lead, r"\p{L}") >= 4) | (char_count(lead, r"\p{Nd}") >= 2))
    body = F.when(cut, strip(F.substring(c, first, F.length(c)))).otherwise(c)
    return F.when(cjk_count(c) >= 2, polish_text(F.regexp_replace(body, r"(?U)\b[a-zA-Z][a-zA-Z0-9._-]{4,}\b", " "))).otherwise(c)


def preview_lines(c: Column) -> Column:
    """Readable lines of a text: noise stripped, started at the body, Latin clutter out of Chinese lines."""
    decoded = unescape_html(F.transform(lines_of(c), lambda x: F.translate(x, "\x00", " ")))
    stripped = F.filter(F.transform(decoded, strip_inline_noise), lambda x: x != "")
    anchored = F.filter(F.transform(stripped, trim_to_anchor), lambda x: x != "")
    return F.filter(F.transform(anchored, _body_line), lambda x: ~is_noise_line(x))


def distinct_runs(lines: Column) -> Column:
    """Lines without those that repeat the one before."""
    return changes(lines, lambda a, b: a.eqNullSafe(b))


def preview(lines: Column, max_chars: int = 500) -> Column:
    """Preview of readable lines (a column, as a Python function can't stand inside a lambda): Chinese ones alone where there are some, repeats dropped, cut with an ellipsis."""
    chinese = F.filter(lines, lambda x: cjk_count(x) >= 2)
    kept = F.when(F.exists(lines, lambda x: cjk_count(x) >= 4) & (F.size(chinese) > 0), chinese).otherwise(lines)

    def step(acc, line):
        more = polish_text(F.when(acc["text"] == "", line).otherwise(F.concat_ws(" ", acc["text"], line)))
        cut = lambda t: F.concat(polish_text(F.rtrim(F.left(t, F.lit(max_chars)))), F.lit("..."))
        grown = once(more, lambda t: F.when(F.length(t) >= max_chars, F.struct(cut(t).alias("text"), F.lit(True).alias("full"))).otherwise(F.struct(t.alias("text"), F.lit(False).alias("full"))))
        return F.when(acc["full"], acc).otherwise(grown)

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    return F.aggregate(distinct_runs(kept), start, step, lambda a: F.when(a["full"], a["text"]).otherwise(polish_text(a["text"])))


def preview_chunks(source_type: Column, pages: Column, paragraphs: Column, slides: Column, text: Column) -> Column:
    """The texts a preview is made of, by source type."""
    whole = F.array(F.coalesce(text, F.lit("")))
    some = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    kind = F.lower(source_type)
    return F.when(kind == "pdf", F.coalesce(pages, F.array().cast("array<string>"))).when((kind == "word") & some(paragraphs), paragraphs).when((kind == "presentation") & some(slides), slides).otherwise(whole)


def display_lines(c: Column) -> Column:
    """A polished text with a line break after each Chinese full stop."""
    return F.array_join(F.filter(F.transform(F.split(polish_text(c), "(?<=[。！？；])", -1), strip), lambda x: x != ""), "\n")


def classify_key(c: Column) -> Column:
    """Kind of a directory key; null for none."""
    t = strip(c)
    low = F.lower(t)
    return (
        F.when(t.rlike(r"^[xX]\d{6,}$"), "application_id")
        .when(t.rlike(r"^\d{4}$"), "sequence_code")
        .when(t.rlike(r"^\d{2}$"), "short_sequence_code")
        .when(t.rlike(r"^[mM]\d{1,2}$"), "module_code")
        .when(low.isin(*REGION_CODES), "region_code")
        .when(low.isin(*FOLDER_KEYS), "folder_key")
    )


def is_parenthetical(c: Column) -> Column:
    """A short code in brackets, alone: it carries on the cell above."""
    return F.coalesce(strip(c).rlike(r"^[（(][A-Za-z0-9.\-_/]{2,28}[)）]$"), F.lit(False))


def is_aggregate(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(low.rlike(r"^(?:合计|总计|小计|共计|平均|mean|total|sum)|[总共计](?U)\s*\d+"), F.lit(False))


def is_annotation(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"^(?:[*†‡§¶]|\d+\))") | F.lower(c).rlike(r"^(?:注|说明|备注|note):"), F.lit(False))


def is_glossary_hint(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).rlike(_any(GLOSSARY_WORDS)), F.lit(False))


def titles_compatible(a: Column, b: Column) -> Column:
    a, b = strip(F.coalesce(a, F.lit(""))), strip(F.coalesce(b, F.lit("")))
    return (a == "") | (b == "") | (lower_text(a) == lower_text(b))


def row_text(row: Column) -> Column:
    """Cells joined by ' | ', null shown as the word."""
    return F.array_join(row, " | ", "null")


def row_texts(grid: Column, clean: bool = True) -> Column:
    return F.transform(grid, lambda r: row_text(F.transform(r, cell_text) if clean else r))


def is_heading(c: Column) -> Column:
    """A row that heads a table rather than belongs to it."""
    t = cell_text(c)
    found = t.rlike(r"^\d+(?:\.\d+)*(?U)\s*[\x{4E00}-\x{9FFF}A-Za-z]{1,20}表$") | t.rlike(r"(?U)^表\s*[0-9A-Za-z一二三四五六七八九十零〇.\-]+\b") | F.contains(t, F.lit("术语表"))
    return F.coalesce(found, F.lit(False))


def is_section_tail(words: Column) -> Column:
    """Words of a numbered section heading of three words at most."""
    n, first, second = F.size(words), F.get(words, F.lit(0)), F.get(words, F.lit(1))
    numbered = first.rlike(r"^\d+(?:\.\d+){1,4}$")
    two = numbered & (F.length(second) <= 12) & second.rlike(r"[\x{4E00}-\x{9FFF}A-Za-z]")
    joined = F.array_join(words, " ").rlike(r"^\d+(?:\.\d+){1,4}\s+\S+$")
    return F.coalesce(F.when(n == 1, numbered).when((n == 2) & two, True).when((n > 0) & (n <= 3), joined).otherwise(False), F.lit(False))


def smart_join(tokens: Column, gap: float = 1.5) -> Column:
    """Joins array<struct<x0,x1,text>> in order, with a space over a gap or where CJK meets Latin."""

    def step(acc, t):
        last, first = F.right(acc["text"], F.lit(1)), F.left(t["text"], F.lit(1))
        edge = (has_cjk(last) & first.rlike("[A-Za-z0-9]")) | (last.rlike("[A-Za-z0-9]") & has_cjk(first))
        apart = (t["x0"] - acc["x1"] > gap) | edge
        text = F.when(acc["text"] == "", t["text"]).when(apart, F.concat(acc["text"], F.lit(" "), t["text"])).otherwise(F.concat(acc["text"], t["text"]))
        return F.struct(t["x1"].cast("double").alias("x1"), text.alias("text"))

    start = F.struct(F.lit(0.0).alias("x1"), F.lit("").alias("text"))
    return F.aggregate(F.array_sort(F.filter(tokens, lambda t: strip(t["text"]) != "")), start, step, lambda a: a["text"])


def sanitize_prompt(c: Column) -> Column:
    """Trimmed; a blocked token raises an error."""
    return F.when(F.lower(c).rlike(_any(BLOCKED_PROMPTS)), F.raise_error(F.lit("the prompt has a blocked token")).cast("string")).otherwise(strip(c))
