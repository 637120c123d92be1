"""Text blocks of pages: scan, merge, deduplicate, running headers and footers, text that belongs to tables.

A block is a row (doc_id, page, ordinal, bbox, text, font_size, source); pages are (doc_id, page, width,
height).  Folds run over one page's blocks; everything else is relational and keyed by (doc_id, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossio.functions import geom as G
from dossio.functions import text as T
from dossio.functions.fold import once, replaced

PAGE = ["doc_id", "page"]
BLOCK = "struct<bbox:array<double>,text:string,font_size:double,source:string,indices:array<int>>"


def median(values: Column) -> Column:
    """Median of an array of numbers, the mean of the middle two; null for none."""
    return once(F.array_sort(values), lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2)


def scan_lines(evidence: DataFrame) -> DataFrame:
    """A row for each line of the type-0 blocks of ``evidence`` (doc_id, page, blocks of lines of spans)."""
    blocks = evidence.select(*PAGE, F.posexplode("blocks").alias("b", "block")).where("block.type = 0")
    lines = blocks.select(*PAGE, "b", F.posexplode("block.lines").alias("l", "line"))
    text = T.clean_text(F.array_join(F.transform("line.spans", lambda s: s["text"]), ""))
    sizes = F.filter(F.transform("line.spans", lambda s: s["size"]), lambda v: v > 0)
    found = lines.select(*PAGE, "b", "l", F.col("line.bbox").alias("bbox"), text.alias("text"), F.coalesce(median(sizes), F.lit(0.0)).alias("font_size")).where("text <> ''")
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("b", "l"))
    return found.select(*PAGE, order.alias("ordinal"), F.format_string("txt_p%d_%03d", "page", order).alias("block_id"), G.rounded(F.col("bbox")).alias("bbox"), "text", "font_size", F.lit("text-layer").alias("source"))


def page_lines(blocks: Column) -> Column:
    """What ``scan_lines`` gives, as an array<struct<bbox,text,font_size>> of the page."""
    lines = F.flatten(F.transform(F.filter(blocks, lambda b: b["type"] == 0), lambda b: b["lines"]))
    sizes = lambda x: F.filter(F.transform(x["spans"], lambda s: s["size"]), lambda v: v > 0)
    one = lambda x: F.struct(G.rounded(x["bbox"]).alias("bbox"), T.clean_text(F.array_join(F.transform(x["spans"], lambda s: s["text"]), "")).alias("text"), F.coalesce(median(sizes(x)), F.lit(0.0)).cast("double").alias("font_size"))
    return F.filter(F.transform(lines, one), lambda x: x["text"] != "")


def scan_images(evidence: DataFrame) -> DataFrame:
    """A row for each type-1 block."""
    found = evidence.select(*PAGE, F.posexplode("blocks").alias("b", "block")).where("block.type = 1")
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("b"))
    return found.select(*PAGE, order.alias("ordinal"), F.format_string("img_p%d_%03d", "page", order).alias("image_id"), G.rounded(F.col("block.bbox")).alias("bbox"))


def scan_context_blocks(evidence: DataFrame) -> DataFrame:
    """A row for each text block, spans joined by spaces, as the table context reads them."""
    found = evidence.select(*PAGE, F.posexplode_outer("blocks").alias("ordinal", "block")).where("block.type = 0")
    spans = F.flatten(F.transform("block.lines", lambda x: F.transform(x["spans"], lambda s: s["text"])))
    return found.select(*PAGE, "ordinal", F.col("block.bbox").alias("bbox"), F.array_join(spans, " ").alias("text"))


def scan_drawings(evidence: DataFrame) -> DataFrame:
    return evidence.select(*PAGE, F.posexplode("drawings").alias("ordinal", "d")).select(*PAGE, "ordinal", F.col("d.rect").alias("bbox"), F.col("d.items").alias("items"))


def scan_words(evidence: DataFrame) -> DataFrame:
    return evidence.select(*PAGE, F.posexplode("words").alias("ordinal", "w")).where(F.trim("w.text") != "").select(*PAGE, "ordinal", "w.*")


def _overlaid(a: Column, b: Column) -> Column:
    return (G.vertical_overlap(a, b) >= 0.6) & (G.horizontal_overlap(a, b) >= 0.18)


def _facing(left: Column, right: Column, page_width: Column, tolerance: Column) -> Column:
    """Whether two neighbouring blocks with what is known of their texts are one line of text."""
    a, b = left["bbox"], right["bbox"]
    tall = lambda x: F.greatest(F.lit(1.0), G.height(x))
    aligned = (F.abs(G.y_center(a) - G.y_center(b)) <= tolerance) | (G.vertical_overlap(a, b) >= 0.6)
    gap = b[0] - a[2]
    apart = gap <= F.greatest(F.lit(24.0), page_width * 0.045, F.least(tall(a), tall(b)) * 2.4)
    fa, fb = left["font_size"], right["font_size"]
    same_font = (fa <= 0) | (fb <= 0) | (F.greatest(fa, fb) / F.greatest(F.lit(0.1), F.least(fa, fb)) <= 1.45) | _overlaid(a, b)
    short = left["cjk"] | right["cjk"] | ((F.length(left["text"]) <= 64) & (F.length(right["text"]) <= 64))
    return (left["text"] != "") & (right["text"] != "") & ~left["ends"] & ~right["starts"] & short & aligned & apart & ((gap >= -2.5) | _overlaid(a, b)) & same_font


#: A block with what the merge asks of its clean text: its compact form, whether it begins or ends like a break, and has Chinese.
KNOWN = BLOCK[:-1] + ",compact:string,starts:boolean,ends:boolean,cjk:boolean>"


def _known(b: Column) -> Column:
    t = b["text"]
    more = [T.compact_text(t).alias("compact"), T.starts_with_break(t).alias("starts"), T.ends_with_break(t).alias("ends"), T.has_cjk(t).alias("cjk")]
    return F.struct(*[b[n].alias(n) for n in ("bbox", "text", "font_size", "source", "indices")], *more).cast(KNOWN)


def should_merge(left: Column, right: Column, page_width: Column, tolerance: Column) -> Column:
    """Whether two neighbouring blocks (their texts clean) are one line of text."""
    return _facing(_known(left), _known(right), page_width, tolerance)


def _block(bbox: Column, text: Column, font: Column, source: Column, indices: Column) -> Column:
    return F.struct(bbox.alias("bbox"), text.alias("text"), font.alias("font_size"), source.alias("source"), indices.alias("indices")).cast(BLOCK)


def _last(acc: Column) -> Column:
    return F.get(acc, F.size(acc) - 1)


def merge_fold(blocks: Column, page_width: Column) -> Column:
    """Blocks (KNOWN) in reading order, each merged into the last one where they are one line."""
    tolerance = F.greatest(F.lit(2.5), median(F.transform(blocks, lambda b: F.greatest(F.lit(1.0), G.height(b["bbox"])))) * 0.45)

    def fold(x):
        def step(acc, b):
            last = _last(acc)
            both = F.filter(F.array(last["font_size"], b["font_size"]), lambda v: v > 0)
            source = F.when(b["source"] == "image-text-recovery", "semantic-merged-image-text").otherwise(last["source"])
            merged = F.struct(
                G.rounded(G.union(last["bbox"], b["bbox"])).alias("bbox"),
                T.join_fragments(last["text"], b["text"]).alias("text"),
                F.coalesce(median(both), F.lit(0.0)).alias("font_size"),
                source.alias("source"),
                F.concat(last["indices"], b["indices"]).alias("indices"),
                F.concat(last["compact"], b["compact"]).alias("compact"),  # no space stays in it
                last["starts"].alias("starts"),
                b["ends"].alias("ends"),
                (last["cjk"] | b["cjk"]).alias("cjk"),
            ).cast(KNOWN)
            joins = F.coalesce((F.size(acc) > 0) & _facing(last, b, page_width, x["tolerance"]), F.lit(False))
            return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(b)))

        return F.aggregate(F.filter(x["blocks"], lambda b: b["text"] != ""), F.array().cast(f"array<{KNOWN}>"), step)

    return once(F.struct(blocks.alias("blocks"), tolerance.alias("tolerance")), fold)


def _holds(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def is_duplicate(a: Column, b: Column) -> Column:
    """Whether two blocks overlap and one's text holds the other's."""
    return (G.intersection_ratio(a["bbox"], b["bbox"]) >= 0.72) & _holds(T.compact_text(a["text"]), T.compact_text(b["text"]))


def dedup_fold(blocks: Column) -> Column:
    """Blocks (KNOWN) without duplicates of an earlier one; the longer text takes the earlier one's place."""

    def step(acc, x):
        apart = lambda k: (x["bbox"][1] >= k["bbox"][3]) | (k["bbox"][1] >= x["bbox"][3])  # noqa: E731  (one above the other: the usual case, and cheap to see)
        same = lambda k: ~apart(k) & (G.intersection_ratio(x["bbox"], k["bbox"]) >= 0.72) & _holds(x["compact"], k["compact"])
        longer = lambda k: F.when(F.length(x["compact"]) > F.length(k["compact"]), x).otherwise(k)
        return F.coalesce(replaced(acc, same, longer), F.concat(acc, F.array(x)))

    order = F.array_sort(F.transform(blocks, lambda b, i: F.struct(b["bbox"][1].alias("y"), b["bbox"][0].alias("x"), i.alias("i"), b.alias("b"))))
    return F.aggregate(F.transform(order, lambda o: o["b"]), F.array().cast(f"array<{KNOWN}>"), step)


def near_duplicate_fold(blocks: Column) -> Column:
    """Blocks (KNOWN) of equal compact text on the same line are one, with the tighter box and the longer text."""

    def step(acc, x):
        same = lambda k: (k["compact"] == x["compact"]) & (G.vertical_overlap(k["bbox"], x["bbox"]) >= 0.6) & G.close(k["bbox"], x["bbox"])
        longer = lambda k: F.when(F.length(x["text"]) > F.length(k["text"]), x["text"]).otherwise(k["text"])
        take = lambda k: k.withField("bbox", G.rounded(G.compact_choice(k["bbox"], x["bbox"]))).withField("text", longer(k))
        return F.coalesce(F.when(x["compact"] != "", replaced(acc, same, take)), F.concat(acc, F.array(x)))

    return F.aggregate(blocks, F.array().cast(f"array<{KNOWN}>"), step)


def merge_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Merged and deduplicated blocks of each page, numbered anew: doc_id, page, ordinal, block_id, bbox, text, font_size, source, indices, n_merged."""
    one = _block(F.col("bbox"), T.clean_text(F.col("text")), F.coalesce("font_size", F.lit(0.0)).cast("double"), F.coalesce("source", F.lit("text-layer")), F.array("ordinal").cast("array<int>"))
    known = blocks.select(*PAGE, "bbox", "ordinal", one.alias("b")).withColumn("b", _known(F.col("b")))
    sorted_blocks = F.transform(F.array_sort(F.collect_list(F.struct(F.col("bbox")[1].alias("y"), F.col("bbox")[0].alias("x"), F.col("ordinal").alias("i"), "b"))), lambda o: o["b"])
    held = known.groupBy(*PAGE).agg(sorted_blocks.alias("blocks")).join(pages.select(*PAGE, F.col("width").cast("double").alias("width")), PAGE)
    merged = held.withColumn("m", merge_fold(F.col("blocks"), F.col("width"))).withColumn("d", dedup_fold(F.col("m"))).withColumn("d", near_duplicate_fold(F.col("d")))
    gone = (F.size(F.filter("blocks", lambda b: b["text"] != "")) - F.size("d")).alias("n_merged")
    out = merged.select(*PAGE, gone, F.posexplode("d").alias("i", "b"))
    return out.select(*PAGE, (F.col("i") + 1).alias("ordinal"), F.format_string("txt_p%d_%03d", "page", F.col("i") + 1).alias("block_id"), "b.bbox", "b.text", "b.font_size", "b.source", "b.indices", "n_merged")


def page_blocks(page: Column, blocks: Column, page_width: Column) -> Column:
    """What ``merge_blocks`` gives of a page's blocks (array<struct<bbox,text,font_size,source>>, texts clean): struct(blocks, n_merged)."""
    one = lambda x, i: F.struct(x["bbox"][1].alias("y"), x["bbox"][0].alias("x"), (i + 1).alias("i"), _known(_block(x["bbox"], x["text"], x["font_size"], x["source"], F.array(i + 1))).alias("b"))
    ordered = F.transform(F.array_sort(F.transform(blocks, one)), lambda o: o["b"])
    number = lambda b, i: F.struct((i + 1).alias("ordinal"), F.format_string("txt_p%d_%03d", page, i + 1).alias("block_id"), *[b[n].alias(n) for n in ("bbox", "text", "font_size", "source", "indices")])
    done = once(ordered, lambda bs: once(dedup_fold(merge_fold(bs, page_width)), near_duplicate_fold))
    return once(done, lambda d: F.struct(F.transform(d, number).alias("blocks"), (F.size(F.filter(blocks, lambda b: b["text"] != "")) - F.size(d)).alias("n_merged")))


def in_margin(bbox: Column, page_height: Column) -> Column:
    """In the band of running headers and footers."""
    band = F.greatest(F.lit(72.0), page_height * 0.11)
    return (bbox[3] <= band) | (bbox[1] >= page_height - band)


def is_small(bbox: Column, page_height: Column) -> Column:
    return G.clamped(G.height(bbox)) <= F.greatest(F.lit(12.0), page_height * 0.035)


def _sized(blocks: DataFrame, pages: DataFrame | None) -> DataFrame:
    """``blocks`` with _h, their page's height: from ``pages``, or without them from the column page_height."""
    if pages is None:
        return blocks.withColumn("_h", F.col("page_height").cast("double"))
    return blocks.join(pages.select(*PAGE, F.col("height").cast("double").alias("_h")), PAGE)


def mark_running(blocks: DataFrame, pages: DataFrame | None = None, chinese_numbers: bool = False) -> DataFrame:
    """``blocks`` with ``running``: repeated in the margin across the document, a page number, or a stray letter or two.

    Only what stands in the margins is looked into and moves: signatures are counted by grouping, with map-side
    sums, as a running header may stand on every page.
    """
    sized = _sized(blocks, pages)
    inside = F.coalesce(in_margin(F.col("bbox"), F.col("_h")), F.lit(False))
    margin = sized.where(inside).withColumn("_sig", T.running_signature(F.col("text")))
    counted = F.length("_sig") >= 3
    often = margin.where(counted).groupBy("doc_id", "_sig").agg(F.count("*").alias("_n")).where("_n >= 2").withColumn("_often", F.lit(True))
    text = T.clean_text(F.col("text"))
    stray = is_small(F.col("bbox"), F.col("_h")) & (F.length(text) <= 2) & text.rlike(r"^\p{L}+$")
    running = F.coalesce("_often", F.lit(False)) | T.is_page_number(text, chinese_numbers) | stray
    marked = margin.join(often, ["doc_id", "_sig"], "left").withColumn("running", F.coalesce(running, F.lit(False)))
    rest = sized.where(~inside).withColumn("running", F.lit(False))
    names = [*blocks.columns, "running"]
    return rest.select(*names).unionByName(marked.select(*names))


def running_signatures(pages: DataFrame) -> DataFrame:
    """(doc_id, often): the signatures that stand twice or more in the margins of a document's pages (doc_id, height, texts)."""
    inside = F.filter("texts", lambda t: in_margin(t["bbox"], F.col("height")))
    each = pages.select("doc_id", F.explode_outer(F.transform(inside, lambda t: T.running_signature(t["text"]))).alias("_sig")).where(F.length("_sig") >= 3)
    return each.groupBy("doc_id", "_sig").agg(F.count("*").alias("_n")).where("_n >= 2").groupBy("doc_id").agg(F.collect_list("_sig").alias("often"))


def is_running(t: Column, page_height: Column, often: Column) -> Column:
    """What ``mark_running`` says of a page's block t, given its document's ``running_signatures``."""
    text = T.clean_text(t["text"])
    stray = is_small(t["bbox"], page_height) & (F.length(text) <= 2) & text.rlike(r"^\p{L}+$")
    return F.coalesce(in_margin(t["bbox"], page_height), F.lit(False)) & F.coalesce(F.coalesce(F.array_contains(often, T.running_signature(t["text"])), F.lit(False)) | T.is_page_number(text) | stray, F.lit(False))


def drop_running(blocks: DataFrame, pages: DataFrame | None = None, chinese_numbers: bool = False) -> DataFrame:
    return mark_running(blocks, pages, chinese_numbers).where(~F.col("running")).drop("running")


def in_table(block: Column, table: Column) -> Column:
    """Whether a table's box covers a block's."""
    overlap = G.intersection_ratio(block, table)
    return (overlap >= 0.42) | (G.center_inside(block, table) & (overlap >= 0.2))


def drop_table_text(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that no table of their page covers: an anti join on the page with the overlap as its condition."""
    b, t = blocks.alias("b"), tables.select(*PAGE, "bbox").alias("t")
    inside = in_table(F.col("b.bbox"), F.col("t.bbox"))
    return b.join(t, (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page") == F.col("t.page")) & inside, "left_anti")
