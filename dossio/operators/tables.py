"""Logical tables from ruled-table evidence: columns, grid, header, scores, identity, validity, confidence.

Evidence is a row a table: doc_id, page, ordinal, bbox, page_height, physical_cols, and rows as
array<struct<physical_row, cells array<struct<physical_col, text>>>>.  Everything is Column expressions on
that row; only lookups between tables and blocks join, on (doc_id, page).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dossio.config import Stitching
from dossio.functions import cast as C
from dossio.functions import geom as G
from dossio.functions import text as T
from dossio.functions.fold import changes, once
from dossio.operators.text_blocks import PAGE

#: Patterns that tell titles, hints, contents lines and references, and the limits by which tables are judged.
TITLE = r"(?i)^\s*(?:附?表\s*[0-9A-Za-z一二三四五六七八九十零〇.\-]+|table\s*[0-9A-Za-z.\-]+)\s*(?:[.:：、\-]|\s+)"
SECTION_HINT = r"(?i)术语表|词汇表|名词表|名词解释|参数表|清单|附录表|glossary"
CONTENTS_HEADING = r"(?i)^\s*(?:目录|contents)\s*$"
LEADER_LINE = r"[.·…]{4,}\s*\d{1,3}\s*$"
NUMBERED_LINE = r"^\s*\d+(?:\.\d+){1,4}\s+\S+\s+\d{1,3}\s*$"
REFERENCE_ROW = r"^\s*(?:\d+\.\s+|[（(]?\d+[)）])"
DATA_WORDS = "回复|撤回|提交|模块|m1|m2|m3|文件夹"
NEAR_TOP, NEAR_BOTTOM = 0.28, 0.72
LEAST_CONFIDENCE = 0.3


def near_edges(evidence: DataFrame) -> DataFrame:
    """Evidence that is a table (a box, two rows, a column), with near_top and near_bottom."""
    ok = F.col("bbox").isNotNull() & (F.size("rows") >= 2) & (F.col("physical_cols") >= 1)
    b, h = F.col("bbox"), F.col("page_height")
    return evidence.where(ok).withColumn("near_top", b[1] <= h * NEAR_TOP).withColumn("near_bottom", b[3] >= h * NEAR_BOTTOM)


def in_region(items: Column, bbox: Column, margin: float) -> Column:
    """Items (structs with bbox) within a table's box and a margin: 10 for spans and words, 15 for drawings."""
    return F.filter(items, lambda i: G.within(i["bbox"], bbox, margin))


def row_patterns(rows: Column) -> Column:
    """For each row, the physical columns that hold text."""
    text = lambda c: F.trim(F.coalesce(c["text"], F.lit("")))
    return F.transform(rows, lambda r: F.transform(F.filter(r["cells"], lambda c: text(c) != ""), lambda c: c["physical_col"]))


def most_filled(patterns: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(patterns, lambda p: F.size(p))), F.lit(0))


def runs(patterns: Column) -> Column:
    """The used columns as runs of neighbours."""
    used = F.array_sort(F.array_distinct(F.flatten(patterns)))

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.array(x))))
        return F.when((F.size(acc) > 0) & (x <= F.get(last, F.size(last) - 1) + 1), joined).otherwise(F.concat(acc, F.array(F.array(x))))

    return F.aggregate(used, F.array().cast("array<array<int>>"), step)


def column_count(patterns: Column, physical: Column, parent: Column) -> Column:
    """struct(n, strategy): the parent's columns, else runs of used columns or the most in a row."""
    n, widest = F.size(runs(patterns)), most_filled(patterns)
    made = lambda v, s: F.struct(v.cast("int").alias("n"), F.lit(s).alias("strategy"))
    return F.when(widest == 0, made(F.greatest(physical, F.lit(1)), "fallback")).when(F.coalesce(parent, F.lit(0)) > 0, made(parent, "inherit")).when((n == widest) | (n >= 2), made(n, "content_clusters")).otherwise(made(F.greatest(widest, F.lit(1)), "max_content_cols"))


def column_clustering(patterns: Column, physical: Column) -> Column:
    """struct(logical_col_count, confidence, clusters) by runs of used columns."""
    found, widest = runs(patterns), most_filled(patterns)
    n = F.size(found)
    return F.struct(F.when(n == 0, physical).otherwise(n).alias("logical_col_count"), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), n / F.greatest(F.lit(1), widest))).alias("confidence"), found.alias("clusters"))


def content_distribution(patterns: Column, physical: Column) -> Column:
    """struct(logical_col_count, confidence, clusters): neighbours in use join where they occur together at least half the time."""
    used = F.array_sort(F.array_distinct(F.flatten(patterns)))

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        prev = F.get(last, F.size(last) - 1)
        both = F.size(F.filter(patterns, lambda p: F.array_contains(p, x) & F.array_contains(p, prev)))
        either = F.size(F.filter(patterns, lambda p: F.array_contains(p, x) | F.array_contains(p, prev)))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.array(x))))
        return F.when((F.size(acc) > 0) & (either > 0) & (both / either >= 0.5), joined).otherwise(F.concat(acc, F.array(F.array(x))))

    found = F.aggregate(used, F.array().cast("array<array<int>>"), step)
    n = F.size(found)
    return F.struct(F.when(n == 0, physical).otherwise(n).alias("logical_col_count"), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(patterns) / 5.0)).alias("confidence"), found.alias("clusters"))


def column_mapping(physical: Column, logical: Column, patterns: Column, bbox: Column, parent_bbox: Column) -> Column:
    """For each physical column its logical one: by place in the parent's box, by run, or in proportion."""
    cols = F.sequence(F.lit(0), physical - 1)
    share = lambda p: F.least(F.floor((p + 0.5) / physical * logical), logical - 1).cast("int")
    def by_run(found, p):
        near = F.array_min(F.flatten(F.transform(found, lambda run, k: F.transform(run, lambda c: F.struct(F.abs(p - c).alias("d"), k.alias("k"))))))
        return near["k"].cast("int")

    def by_parent(p):
        step = G.width(bbox) / physical
        center = bbox[0] + (p + 0.5) * step
        at = F.floor((center - parent_bbox[0]) / G.width(parent_bbox) * logical).cast("int")
        cut = bbox[0] - parent_bbox[0] > G.width(parent_bbox) / logical * 0.2  # the first column is cut off
        inside = F.when(at < 0, 0).otherwise(F.least(at, logical - 1))
        return F.when(cut, F.greatest(F.lit(1), inside)).otherwise(inside).cast("int")

    placed = parent_bbox.isNotNull() & bbox.isNotNull()
    sound = placed & (G.width(bbox) > 0) & (G.width(parent_bbox) > 0)
    unplaced = ~F.coalesce(placed, F.lit(False))
    return once(runs(patterns), lambda found: F.transform(cols, lambda p: F.when(sound, by_parent(p)).when(unplaced & (F.size(found) == logical), by_run(found, p)).otherwise(share(p))))


def column_clusters(mapping: Column, logical: Column, bbox: Column, physical: Column) -> Column:
    """For each logical column its physical columns and centre x; null centre where it has none."""
    of = lambda k: F.filter(F.transform(mapping, lambda m, p: F.when(m == k, p)), lambda p: p.isNotNull())
    center = lambda ps: bbox[0] + (F.aggregate(ps, F.lit(0.0), lambda a, p: a + p + 0.5) / F.size(ps)) * G.width(bbox) / physical
    return F.transform(F.sequence(F.lit(0), logical - 1), lambda k: F.struct(of(k).alias("physical_cols"), F.when(F.size(of(k)) > 0, center(of(k))).alias("center_x")))


def project_grid(rows: Column, mapping: Column, logical: Column) -> Column:
    """The logical grid: texts of the physical cells of a column joined by spaces, null for none."""
    own = lambda c: F.coalesce(F.get(mapping, c["physical_col"]), c["physical_col"])
    texts = lambda r, k: F.transform(F.filter(r["cells"], lambda c: (own(c) == k) & (F.coalesce(c["text"], F.lit("")) != "")), lambda c: c["text"])
    return F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), logical - 1), lambda k: F.nullif(F.array_join(texts(r, k), " "), F.lit(""))))


def grid_score(horizontal: Column, vertical: Column, table_area: Column) -> Column:
    """0.6 for ten lines, 0.4 for even gaps between vertical lines (``vertical``: their centres)."""
    lines = F.size(horizontal) + F.size(vertical)
    xs = F.array_sort(vertical)
    gaps = F.zip_with(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), lambda b, a: b - a)
    n = F.size(gaps)
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g) / n
    spread = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + (g - mean) * (g - mean)) / n)
    even = F.when((F.size(horizontal) == 0) | (F.size(xs) < 2), 0.0).when(mean > 0, F.greatest(F.lit(0.0), 1 - spread / mean)).otherwise(0.0)
    return F.when(table_area <= 0, 0.0).otherwise(0.6 * F.least(F.lit(1.0), lines / 10.0) + 0.4 * even)


def is_continuation(near_top: Column, has_parent: Column, first_row: Column) -> Column:
    """Whether a table at the top of a page goes on from a parent: its first row looks like data."""
    texts = F.filter(first_row, lambda c: F.coalesce(c, F.lit("")) != "")
    joined = F.array_join(texts, " ")
    data = F.lower(joined).rlike(DATA_WORDS) | (F.trim(joined).rlike(r"^\d{1,4}$")) | (F.size(texts) <= 2)
    return F.coalesce(near_top & has_parent & (F.size(texts) > 0) & data, F.lit(False))


def header_and_cells(grid: Column, continues: Column, parent_header: Column) -> Column:
    """struct(header, inherited, data_start, cells): an inherited header with data from row 0, or the first row."""
    takes = continues & parent_header.isNotNull() & (F.size(parent_header) > 0)
    start = F.when(takes, 0).otherwise(1)
    body = F.transform(F.slice(grid, start + 1, F.greatest(F.size(grid) - start, F.lit(0))), lambda r, i: F.transform(r, lambda c, j: F.struct((i + 1).alias("logical_row"), (j + 1).alias("col"), T.cell_text(c).alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"))))
    return F.struct(F.when(takes, parent_header).otherwise(C.header_of(grid)).alias("header"), F.coalesce(takes, F.lit(False)).alias("inherited"), start.alias("data_start"), F.flatten(body).alias("cells"))


def merge_cells(cells: Column) -> Column:
    """Cells without short bracketed codes, which go on a new line of the cell above in their column."""
    kind = "array<struct<logical_row:int,col:int,text:string,rowspan:int,colspan:int>>"

    def step(acc, x):
        blank = F.coalesce(x["text"], F.lit("")) == ""
        at = F.array_max(F.transform(acc, lambda c, i: F.when((c["col"] == x["col"]) & (F.coalesce(c["text"], F.lit("")) != ""), i)))
        up = ~blank & T.is_parenthetical(x["text"]) & at.isNotNull()
        put = F.transform(acc, lambda c, i: F.when(i == at, F.struct(c["logical_row"], c["col"], F.concat(c["text"], F.lit("\n"), x["text"]).alias("text"), (c["rowspan"] + 1).alias("rowspan"), c["colspan"])).otherwise(c))
        return F.when(up, put.cast(kind)).otherwise(F.concat(acc, F.array(x).cast(kind)))

    ordered = F.array_sort(cells).cast(kind)
    # the fold only changes something where there is such a code
    return F.when(F.exists(cells, lambda x: T.is_parenthetical(x["text"])), F.aggregate(ordered, F.array().cast(kind), step)).otherwise(ordered)


def distinct_cells(cells: Column) -> Column:
    """Cells in order of (row, column), the first of each place."""
    ordered = F.transform(F.array_sort(F.transform(cells, lambda c, i: F.struct(c["logical_row"].alias("r"), c["col"].alias("c"), i.alias("i"), c.alias("x")))), lambda o: o["x"])
    return changes(ordered, lambda a, b: (a["logical_row"] == b["logical_row"]) & (a["col"] == b["col"]))


def empty_rows(grid: Column) -> Column:
    """1-based numbers of the rows without text."""
    return F.filter(F.transform(grid, lambda r, i: F.when(G.filled_count(r) == 0, i + 1)), lambda i: i.isNotNull())


def merge_split_rows(grid: Column) -> Column:
    """Rows that hold a torn-off last character of the row above (and repeat its text) go into it, bottom up; blank rows go then."""
    torn = ("夹", "件", "文", "的", "等", "表", "书", "明")  # fixed values
    flat = lambda c: F.translate(T.strip(c), "\n", " ")
    at_torn = lambda r: F.array_min(F.filter(F.transform(r, lambda c, i: F.when(T.strip(c).isin(*torn), i)), lambda i: i.isNotNull()))

    def pair(prev, cur):
        """struct(place of the row above that goes on, its new text), null where the rows don't belong together."""
        k = at_torn(cur)
        hit = lambda i: (i != k) & (flat(F.get(cur, i)) != "") & (flat(F.get(prev, i)) != "") & F.startswith(flat(F.get(cur, i)), flat(F.get(prev, i)))
        place = F.array_min(F.filter(F.sequence(F.lit(0), F.least(F.size(cur), F.size(prev)) - 1), hit))
        text, end = flat(F.get(prev, place)), T.strip(F.get(cur, k))
        return F.when(k.isNotNull() & place.isNotNull(), F.struct(place.alias("place"), F.when(F.endswith(text, end), F.get(prev, place)).otherwise(F.concat(text, end)).alias("text")))

    def step(acc, prev):
        cur = F.get(acc, F.lit(0))
        p = pair(prev, cur)
        mended = F.transform(prev, lambda c, i: F.when(i == p["place"], p["text"]).otherwise(c))
        blank = F.transform(cur, lambda _: F.lit(None).cast("string"))
        return F.when(p.isNull() | cur.isNull(), F.concat(F.array(prev), acc)).otherwise(F.concat(F.array(mended, blank), F.slice(acc, F.lit(2), F.greatest(F.size(acc) - 1, F.lit(0)))))

    done = F.aggregate(F.reverse(grid), F.array().cast("array<array<string>>"), step)
    any_merge = F.exists(F.sequence(F.lit(1), F.greatest(F.size(grid) - 1, F.lit(1))), lambda i: pair(F.get(grid, i - 1), F.get(grid, i)).isNotNull())
    return F.when(F.coalesce(any_merge, F.lit(False)) & (F.size(grid) >= 2), F.filter(done, lambda r: G.filled_count(r) > 0)).otherwise(grid)


def counts(grid: Column, cells: Column) -> dict[str, Column]:
    """What the scores are made of."""
    full = F.filter(cells, lambda c: F.coalesce(c["text"], F.lit("")) != "")
    return {"filled": F.size(full), "digits": F.size(F.filter(full, lambda c: c["text"].rlike(r"(?U)\d"))), "aligned": F.size(F.filter(grid, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != "")))}


def _score(filled: Column, slots: Column, aligned: Column, rows: Column, digits: Column, w: tuple) -> Column:
    one = lambda c: F.greatest(F.lit(1), c)
    return F.least(F.lit(1.0), w[0] * filled / one(slots) + w[1] * aligned / one(rows) + w[2] * digits / one(filled))


def structure_score(filled, slots, aligned, rows, digits) -> Column:
    """The score that validity rests on."""
    return _score(filled, slots, aligned, rows, digits, (0.40, 0.35, 0.25))


def emitted_score(filled, slots, aligned, rows, digits, cells) -> Column:
    """The score that is written out; 0 without cells."""
    return F.when(cells == 0, 0.0).otherwise(_score(filled, slots, aligned, rows, digits, (0.45, 0.35, 0.20)))


def _mean_of(texts: Column, weight) -> Column:
    """Mean of a row weight over the texts, 1 at most, 0 without any."""
    n = F.size(texts)
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(texts, F.lit(0.0), lambda a, t: a + weight(t)) / n))


def _dotted(t: Column) -> Column:
    """Whether a row may hold leaders at all."""
    return F.contains(t, F.lit("..")) | t.rlike("[·…]")


def is_contents_line(t: Column) -> Column:
    return (_dotted(t) & t.rlike(LEADER_LINE)) | t.rlike(NUMBERED_LINE)


def contents_ratio(texts: Column) -> Column:
    """Share of rows that are contents lines, as written out."""
    return _mean_of(texts, lambda t: F.when(is_contents_line(t), 1.0).otherwise(0.0))


def _contents_weight(t: Column) -> Column:
    middle = F.regexp_extract(t, r"^\S+(?U)\s+(.*)\s+\S+$", 1)
    numbered = t.rlike(r"^\d+(?:\.\d+){1,4}(?U)\s+\S.*\s\d{1,3}$") & middle.rlike(r"[A-Za-z\x{4E00}-\x{9FFF}]") & (middle.rlike(r"[.·…]{2,}") | (F.length(middle) >= 3))
    return F.when(_dotted(t) & t.rlike(LEADER_LINE), 1.0).when(numbered, 0.75).when(_dotted(t) & t.rlike(r"[.·…]{2,}") & t.rlike(r"\d{1,3}$"), 0.65).otherwise(0.0)


def contents_weight(text: Column) -> Column:
    """How much a row is a contents line: 1, 0.75, 0.65 or 0."""
    return _contents_weight(T.strip(text))


def weighted_contents_ratio(texts: Column) -> Column:
    """The same by weights, which validity rests on."""
    return _mean_of(F.transform(texts, T.strip), _contents_weight)


def _reference_weight(t: Column) -> Column:
    part = lambda hit, w: F.when(hit, w).otherwise(0.0)
    book = F.contains(t, F.lit("《")) & (F.contains(t, F.lit("》")) | F.contains(t, F.lit("——《")))

    def weight(low):
        version = F.contains(low, F.lit("v")) & t.rlike(r"(?i)\bV\d+(?:\.\d+){1,3}\b")
        said = F.contains(low, F.lit("specification")) | F.contains(low, F.lit("document")) | F.contains(low, F.lit("technical")) | F.contains(low, F.lit("change request"))
        return F.least(F.lit(1.0), part(book, 0.9) + part(t.rlike(REFERENCE_ROW), 0.75) + part(version, 0.45) + part(F.contains(low, F.lit("ich")), 0.35) + part(said, 0.25))

    return once(F.lower(t), weight)


def reference_weight(text: Column) -> Column:
    """How much a row is a reference, 1 at most."""
    return _reference_weight(T.strip(text))


def reference_ratio(texts: Column) -> Column:
    """Mean reference weight of the rows that aren't blank."""
    return _mean_of(F.filter(F.transform(texts, T.strip), lambda t: t != ""), _reference_weight)


def is_valid(rows, cols, score, title, hint, continues, marked, contents, grid_lines, contents_share, reference_share) -> Column:
    """Whether a candidate is a table: an ordered decision list.  title and hint are texts or null; continues, marked and contents are flags."""
    loose, plain = title.isNull() & ~continues, hint.isNull()
    glossary = F.lower(hint).rlike("术语表|glossary")
    strong = ((rows >= 5) & (cols >= 3) & (score >= 0.85) & (contents_share <= 0.15)) | ((rows >= 6) & (cols >= 2) & (score >= 0.85) & (contents_share <= 0.1)) | ((rows >= 4) & (cols >= 2) & (score >= 0.7) & (contents_share <= 0.2))
    goes_on = F.when((rows >= 2) & (cols >= 2) & (score >= 0.15), True).when((rows >= 3) & (cols >= 2), score >= 0.12).otherwise((rows >= 4) & (cols >= 1) & (score >= 0.15))
    return (
        F.when(contents | (contents_share >= 0.38), False)
        .when(loose & (reference_share >= 0.75), False)
        .when(loose & plain & (grid_lines < 0.3) & (reference_share >= 0.42), False)
        .when(loose & (grid_lines < 0.2) & (cols >= 4) & (rows <= 8) & (reference_share >= 0.25), False)
        .when(title.isNotNull(), F.when(cols == 1, (rows >= 4) & (score >= 0.15)).otherwise((score >= 0.25) & (rows >= 2) & (cols >= 2)))
        .when(continues, goes_on)
        .when(hint.isNotNull(), (rows >= 4) & (cols >= 2) & (score >= F.when(glossary, 0.25).otherwise(0.55)))
        .when(grid_lines >= 0.45, (rows >= 4) & (cols >= 2) & (score >= 0.56))
        .when(marked & (rows >= 2) & (cols >= 2), score >= 0.15)
        .otherwise(strong)
    )


def identity(near_top, parent_id, header_inherited, has_header, needs_header, rows, cols) -> Column:
    """struct(identity, confidence, parent_id, signals), by ordered rules."""
    own = has_header & ~header_inherited
    made = lambda kind, c, p: F.struct(F.lit(kind).alias("identity"), F.lit(c).alias("confidence"), p.alias("parent_id"))
    none = F.lit(None).cast("string")
    return F.when(parent_id.isNotNull() & near_top & ~own, made("CONTINUATION", 0.9, parent_id)).when(needs_header, made("CONTINUATION", 0.8, parent_id)).when((cols >= 3) & (rows <= 3), made("FRAGMENT", 0.6, none)).otherwise(made("NEW_TABLE", 0.8, none))


def identity_signals(near_top, parent_id, header_inherited, has_header, marked) -> Column:
    """Names of what spoke for the identity."""
    say = lambda hit, name: F.when(hit, F.lit(name))
    return F.array_compact(F.array(say(near_top, "near_page_top"), say(parent_id.isNotNull(), "parent_candidate_found"), F.when(has_header & ~header_inherited, "has_explicit_header").otherwise("no_explicit_header"), say(marked, "marked_as_continuation")))


def cell_state(text: Column, row: Column, header_row: Column) -> Column:
    """struct(state, confidence) of a cell; rows up to the one after the header's count as header."""
    made = lambda s, c: F.struct(F.lit(s).alias("state"), F.lit(c).alias("confidence"))
    return F.when(F.coalesce(text, F.lit("")) == "", made("EMPTY", 1.0)).when(header_row.isNotNull() & (row <= header_row + 1), made("HEADER", 0.9)).when(T.is_parenthetical(text), made("CONTINUATION", 0.8)).when(T.is_aggregate(text), made("AGGREGATE", 0.7)).when(T.is_annotation(text), made("ANNOTATION", 0.6)).otherwise(made("DATA", 0.7))


def nested_regions(cells: Column) -> Column:
    """Cells that span more than one row or column."""
    return F.filter(cells, lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1))


def confidence(identity_confidence, score, continues, similarity, has_nested, filled_ratio, valid, contents, contents_share) -> Column:
    """struct(confidence, risk_flags, review_required, is_valid)."""
    weak = continues & (similarity < 0.5)
    factors = F.array_compact(F.array(identity_confidence, score, F.when(continues & ~weak, similarity), F.when(has_nested, F.lit(0.8)), filled_ratio))
    mean = F.least(F.lit(1.0), F.aggregate(factors, F.lit(0.0), lambda a, x: a + x) / F.size(factors))
    toc = contents | (contents_share >= 0.38)
    say = lambda hit, name: F.when(hit, F.lit(name))
    flags = F.array_compact(F.array(say(identity_confidence < 0.6, "low_identity_confidence"), say(score < 0.3, "unstable_grid"), say(weak, "low_continuation_similarity"), say(filled_ratio < 0.3, "sparse_content"), say(toc, "toc_like_table")))
    ok = valid & ~toc
    return F.struct(mean.alias("confidence"), flags.alias("risk_flags"), ((F.size(flags) >= 2) | (mean < 0.5) | (score < 0.3) | weak | ~ok).alias("review_required"), ok.alias("is_valid"))


def is_accepted(valid: Column, overall: Column) -> Column:
    return valid & (overall >= LEAST_CONFIDENCE)


def _context_hits(text: Column, box: Column, gap: Column, over: Column, policy: Stitching) -> tuple[Column, Column, Column, Column]:
    """Whether a block is a table's title, its section's hint, a heading of contents, or text before it; places first, as patterns cost more."""
    titled = gap.between(-8, 160) & (over >= 0.12) & text.rlike(TITLE)
    hinted = gap.between(0, 180) & (over >= 0.1) & text.rlike(SECTION_HINT)
    toc = gap.between(0, 220) & text.rlike(CONTENTS_HEADING)
    before = (gap > 0) & (gap <= policy.preceding_text_gap_max) & (box[1] > policy.preceding_text_ignore_top_margin) & (over >= policy.preceding_text_overlap_min) & (F.length(text) >= policy.preceding_text_min_length)
    return titled, hinted, toc, before


def page_context(tables: DataFrame, blocks: str, rects: str, policy: Stitching = Stitching()) -> DataFrame:
    """What ``context`` gives, for tables that carry their page's blocks (array<struct<bbox,text>> in order) and drawings' boxes: no join."""
    b = F.col("bbox")
    known = F.transform(blocks, lambda x, i: F.struct((b[1] - x["bbox"][3]).alias("gap"), i.alias("o"), T.strip(x["text"]).alias("text"), x["bbox"].alias("bbox"), G.strict_horizontal_overlap(b, x["bbox"]).alias("over")))
    hits = lambda x: _context_hits(x["text"], x["bbox"], x["gap"], x["over"], policy)

    def found(k):
        first = lambda n: F.get(F.filter(k, lambda x: hits(x)[n]), F.lit(0))["text"]
        near = F.array_min(F.filter(k, lambda x: hits(x)[3]))
        said = F.when(near.isNotNull(), F.struct(near["text"].alias("text"), near["bbox"].alias("bbox")))
        return F.struct(first(0).alias("title"), first(1).alias("hint"), F.exists(k, lambda x: hits(x)[2]).alias("toc"), said.alias("said"))

    lines = F.size(F.filter(rects, lambda d: d[0].between(b[0], b[2]) & d[1].between(b[1], b[3])))
    got = tables.withColumn("_ctx", once(F.filter(known, lambda x: x["text"] != ""), found))
    return got.withColumns({"title": F.col("_ctx.title"), "section_hint": F.col("_ctx.hint"), "toc_context": F.coalesce("_ctx.toc", F.lit(False)), "preceding_text_block": F.col("_ctx.said"), "grid_line_score": F.least(F.lit(1.0), F.greatest(lines, F.lit(0)) / 8.0)}).drop("_ctx", blocks, rects)


def context(tables: DataFrame, blocks: DataFrame, drawings: DataFrame, policy: Stitching = Stitching()) -> DataFrame:
    """Each table (doc_id, page, table_id, bbox) with title, section_hint, toc_context, preceding text and grid_line_score.

    Titles and hints are the first block in order that fits; the preceding text is the nearest.
    """
    key = [*PAGE, "table_id"]
    t = tables.select(*key, "bbox")
    b = blocks.select(*PAGE, F.col("ordinal").alias("_o"), F.col("bbox").alias("_b"), T.strip(F.col("text")).alias("_t")).where("_t <> ''")
    both = t.join(b, PAGE).withColumn("_gap", F.col("bbox")[1] - F.col("_b")[3]).withColumn("_over", G.strict_horizontal_overlap(F.col("bbox"), F.col("_b")))
    text = F.col("_t")
    titled, hinted, toc, before = _context_hits(text, F.col("_b"), F.col("_gap"), F.col("_over"), policy)
    first = lambda hit: F.min_by(F.when(hit, text), F.when(hit, F.col("_o")))
    found = both.groupBy(*key).agg(first(titled).alias("title"), first(hinted).alias("section_hint"), F.bool_or(toc).alias("toc_context"), F.min_by(F.when(before, F.struct(text.alias("text"), F.col("_b").alias("bbox"))), F.when(before, F.struct("_gap", "_o"))).alias("preceding_text_block"))
    d = t.join(drawings.select(*PAGE, F.col("bbox").alias("_d")), PAGE).where(F.col("_d")[0].between(F.col("bbox")[0], F.col("bbox")[2]) & F.col("_d")[1].between(F.col("bbox")[1], F.col("bbox")[3]))
    lines = d.groupBy(*key).agg(F.least(F.lit(1.0), F.count("*") / 8.0).alias("grid_line_score"))
    return tables.join(found, key, "left").join(lines, key, "left").withColumn("toc_context", F.coalesce("toc_context", F.lit(False))).withColumn("grid_line_score", F.coalesce("grid_line_score", F.lit(0.0)))


def parents(tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each table with the latest table of the page before that goes on to it: parent_cols, parent_header, parent_bbox."""
    c = candidates.select("doc_id", (F.col("page") + 1).alias("page"), F.col("ordinal").alias("_o"), F.col("near_bottom").alias("_nb"), F.col("bbox").alias("_b"), F.col("col_count").alias("_c"), F.col("header").alias("_h"))
    both = tables.select(*PAGE, "table_id", "near_top", "bbox").join(c, PAGE).where(F.col("_nb") | (F.col("near_top") & (G.strict_horizontal_overlap(F.col("bbox"), F.col("_b")) >= 0.5)))
    best = both.groupBy(*PAGE, "table_id").agg(F.max_by(F.struct(F.col("_c").alias("c"), F.col("_h").alias("h"), F.col("_b").alias("b")), "_o").alias("p"))
    return tables.join(best, [*PAGE, "table_id"], "left").select(tables["*"], F.col("p.c").alias("parent_cols"), F.col("p.h").alias("parent_header"), F.col("p.b").alias("parent_bbox"))


def identity_parents(tables: DataFrame, last: int = 10, least: float = 0.7, order: WindowSpec | None = None) -> DataFrame:
    """Each table (in order of seq, or of a document's window ``order``) with parent_id and parent_signature: of the ``last`` tables before it, the latest on the page before, near its bottom, with like columns."""
    before = order.rowsBetween(-last, -1) if order is not None else Window.partitionBy("doc_id").orderBy("seq").rangeBetween(-last, -1)
    seen = F.collect_list(F.when(F.col("near_bottom"), F.struct("page", "table_id", "column_signature"))).over(before)
    like = lambda p: (p["page"] + 1 == F.col("page")) & (G.column_similarity(F.col("column_signature"), p["column_signature"]) >= least)
    both = tables.withColumn("_seen", seen).withColumn("_p", F.try_element_at(F.filter("_seen", like), F.lit(-1)))
    return both.withColumns({"parent_id": F.col("_p.table_id"), "parent_signature": F.col("_p.column_signature")}).drop("_seen", "_p")


def next_parents(tables: DataFrame) -> DataFrame:
    """Tables (with ``accepted``) and what ``parents`` would give each of them: next_cols, next_header, next_bbox."""
    before = Window.partitionBy("doc_id").orderBy("page").rangeBetween(-1, -1)
    seen = F.collect_list(F.when(F.col("accepted"), F.struct(F.col("ordinal").alias("o"), F.col("near_bottom").alias("nb"), F.col("bbox").alias("b"), F.col("col_count").alias("c"), F.col("header").alias("h")))).over(before)
    fits = lambda p: p["nb"] | (F.col("near_top") & (G.strict_horizontal_overlap(F.col("bbox"), p["b"]) >= 0.5))
    both = tables.withColumn("_seen", seen).withColumn("_p", F.array_max(F.filter("_seen", fits)))
    return both.withColumns({"next_cols": F.col("_p.c"), "next_header": F.col("_p.h"), "next_bbox": F.col("_p.b")}).drop("_seen", "_p")


def normalize(evidence: DataFrame, repair: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Evidence with parent context (parent_cols, parent_header, parent_bbox) to grids, headers, cells and scores.

    ``repair`` maps a grid and its number of columns to the repaired grid.
    """
    c = F.col
    keep = c("near_top") & (G.strict_horizontal_overlap(c("bbox"), c("parent_bbox")) >= 0.3)
    e = evidence.withColumn("patterns", row_patterns(c("rows"))).withColumn("_pc", F.when(keep, c("parent_cols"))).withColumn("_pb", F.when(keep, c("parent_bbox")))
    e = e.withColumn("_n", column_count(c("patterns"), c("physical_cols"), c("_pc"))).withColumn("col_count", c("_n.n")).withColumn("strategy", c("_n.strategy"))
    e = e.withColumn("mapping", column_mapping(c("physical_cols"), c("col_count"), c("patterns"), c("bbox"), c("_pb"))).withColumn("grid", project_grid(c("rows"), c("mapping"), c("col_count")))
    if repair is not None:
        e = e.withColumn("grid", repair(c("grid"), c("col_count")))
    # through a generator of one row: what follows reads the grid many times, and would else have it spelled out each time
    e = e.withColumn("grid", F.explode(F.array("grid")))
    e = e.withColumn("is_continuation", is_continuation(c("near_top"), c("parent_header").isNotNull(), F.get("grid", F.lit(0)))).withColumn("_h", header_and_cells(c("grid"), c("is_continuation"), c("parent_header")))
    e = e.withColumn("header", c("_h.header")).withColumn("header_inherited", c("_h.inherited")).withColumn("cells", merge_cells(c("_h.cells"))).withColumn("row_count", F.size("grid")).withColumn("row_texts", T.row_texts(c("grid"))).withColumn("column_signature", G.column_signature(c("col_count")))
    n = counts(c("grid"), c("cells"))
    e = e.withColumns({f"_{k}": v for k, v in n.items()})
    slots = c("row_count") * c("col_count")
    return e.withColumns(
        {
            "column_hash": G.column_hash(c("column_signature")),
            "structure_score": structure_score(c("_filled"), slots, c("_aligned"), c("row_count"), c("_digits")),
            "emitted_structure_score": emitted_score(c("_filled"), slots, c("_aligned"), F.size("grid"), c("_digits"), F.size("cells")),
            "filled_ratio": c("_filled") / F.greatest(F.lit(1), F.size("cells")),
            "toc_row_ratio": contents_ratio(c("row_texts")),
            "weighted_toc_ratio": weighted_contents_ratio(c("row_texts")),
            "reference_ratio": reference_ratio(c("row_texts")),
        }
    ).drop("_pc", "_pb", "_n", "_h", "_filled", "_digits", "_aligned", "patterns")


def judge(tables: DataFrame) -> DataFrame:
    """Normalized tables with context, parent_id and parent_signature (none counts as unlike columns) to identity, validity and confidence; only accepted ones stay."""
    return judged(tables).where("accepted").drop("accepted")


def judged(tables: DataFrame) -> DataFrame:
    """The same with all of them, and ``accepted``."""
    c = F.col
    parent = c("parent_signature") if "parent_signature" in tables.columns else F.lit(None).cast("array<double>")
    who = identity(c("near_top"), c("parent_id"), c("header_inherited"), F.size("header") > 0, F.lit(False), c("row_count"), c("col_count"))
    t = tables.withColumn("_who", who).withColumn("_on", c("_who.identity") == "CONTINUATION").withColumn("_sim", F.when(c("_on"), F.coalesce(G.column_similarity(c("column_signature"), parent), F.lit(0.0))).otherwise(0.0))
    ok = is_valid(c("row_count"), c("col_count"), c("structure_score"), c("title"), c("section_hint"), c("_on"), c("is_continuation"), c("toc_context"), c("grid_line_score"), c("weighted_toc_ratio"), c("reference_ratio"))
    sure = confidence(c("_who.confidence"), c("structure_score"), c("_on"), c("_sim"), F.size(nested_regions(c("cells"))) > 0, c("filled_ratio"), ok, c("toc_context"), c("weighted_toc_ratio"))
    # through a generator of one row: the filter below would else be pushed under the grids' projections and spell them all out
    t = t.withColumn("_c", F.explode(F.array(sure)))
    t = t.withColumns({"identity": c("_who.identity"), "confidence": c("_c.confidence"), "risk_flags": c("_c.risk_flags"), "review_required": c("_c.review_required"), "is_valid": c("_c.is_valid")})
    return t.withColumn("accepted", F.coalesce(is_accepted(c("is_valid"), c("confidence")), F.lit(False))).drop("_who", "_on", "_sim", "_c")
