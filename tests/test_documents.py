"""The document pipeline on small evidence: figures, stitching, repairs, the evidence package and the report."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from dossio import report
from dossio.config import Settings
from dossio.plans import document_queries, documents
from dossio.sources import evidence, sinks


def block(text, x0, y0, x1, y1, kind=0):
    box = [float(v) for v in (x0, y0, x1, y1)]
    return {"type": kind, "bbox": box, "lines": [{"bbox": box, "spans": [{"text": text, "size": 10.0, "bbox": box}]}]}


def table(x0, y0, x1, rows):
    n, step = len(rows[0]), (x1 - x0) / len(rows[0])
    made = [{"physical_row": i, "bbox": [x0, y0 + 20.0 * i, x1, y0 + 20.0 * i + 20], "cells": [{"physical_col": j, "text": t, "bbox": [x0 + j * step, y0 + 20.0 * i, x0 + (j + 1) * step, y0 + 20.0 * i + 20]} for j, t in enumerate(r)]} for i, r in enumerate(rows)]
    return {"bbox": [x0, y0, x1, y0 + 20.0 * len(rows)], "physical_cols": n, "rows": made}


def made(spark):
    body = [[f"k{i}", f"{i} mg", f"{i}.5"] for i in range(14)]
    first = {"doc_id": 1, "page": 1, "width": 600.0, "height": 800.0, "blocks": [block("Table 1 Doses", 50, 240, 300, 252), block("", 300, 30, 400, 90, 1), block("Figure 1 of it", 300, 95, 400, 105)], "words": [{"x0": 310.0, "y0": 40.0, "x1": 380.0, "y1": 52.0, "text": "label text"}], "drawings": [], "ruled_tables": [table(50.0, 300.0, 550.0, [["Name", "Dose", "Strength"], *body])]}
    second = first | {"page": 2, "blocks": [block("A closing paragraph", 50, 600, 300, 612)], "words": [], "ruled_tables": [table(50.0, 40.0, 550.0, [["", "12", ""], *body[:5]])]}
    other = first | {"doc_id": 2, "blocks": [block("Drug Name: X", 50, 200, 300, 212)], "words": [], "ruled_tables": []}
    return spark.createDataFrame([first, second, other], evidence.EVIDENCE)


def test_parse(spark):
    got = documents.parse(made(spark))
    docs = {r["doc_id"]: r for r in got.documents.collect()}
    assert (docs[1]["page_count"], docs[1]["table_count"], docs[1]["raw_table_candidates"], docs[1]["cross_page_table_links"]) == (2, 2, 2, 1)
    assert (docs[2]["table_count"], docs[2]["facts"], docs[2]["text"]) == (0, {"drug_name": "X"}, "Drug Name: X")
    # the image's words make it a text block
    assert docs[1]["image_text_recovered_count"] == 1 and "label text" in docs[1]["text"] and docs[1]["image_count"] == 0
    tables = {r["table_id"]: r for r in got.tables.collect()}
    assert tables["tbl_002"]["continued_from"] == "tbl_001" and tables["tbl_002"]["header"] == ["Name", "Dose", "Strength"] and tables["tbl_002"]["title"] == "Table 1 Doses"
    records = {r["table_id"]: json.loads(r["record"]) for r in documents.table_json(got.tables).collect()}
    assert "continued_from" not in records["tbl_001"] and records["tbl_001"]["block_type"] == "table" and records["tbl_002"]["is_continuation"] is True


def test_tables_alone_leave_no_steps_behind(spark):
    """The final records and two lists of documents stay in the shared folder; what only led to them is gone, and no text is worked out."""
    at = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    steps = lambda: {p for p in at.glob("**/*") if p.is_dir() and any(p.glob("*part-*"))}
    before = steps()
    records, found, accepted = documents.parse_tables(made(spark))
    assert len(steps() - before) == 3
    assert {r["table_id"]: r["continued_from"] for r in records.collect()} == {"tbl_001": None, "tbl_002": "tbl_001"}
    assert (found.count(), accepted.count()) == (2, 2)


def test_columns_come_from_the_parent(spark):
    accepted, rounds = documents.judged_tables(documents.table_evidence(made(spark)), documents.text_blocks.scan_context_blocks(made(spark)), documents.text_blocks.scan_drawings(made(spark)).select("doc_id", "page", "bbox"), Settings())
    second = accepted.where("page = 2").first()
    assert rounds >= 2 and second["col_count"] == 3 and second["identity"] == "CONTINUATION" and second["header_inherited"]


def test_only_documents_whose_parents_changed_are_judged_again(spark, monkeypatch):
    """Document 3 has no table that goes on, so no round after the first works its grids out."""
    alone = made(spark).where("doc_id = 1 AND page = 1").withColumn("doc_id", F.lit(3).cast("long"))
    steps, written = [], documents.written
    monkeypatch.setattr(documents, "written", lambda df, label: steps.append(written(df, label)) or steps[-1])
    monkeypatch.setattr(documents, "remove", lambda *frames: None)
    records = documents.parse_tables(made(spark).unionByName(alone))[0]
    judged = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps if "filled_ratio" in s.columns]
    assert judged[0] == {1, 3} and len(judged) >= 2 and all(d == {1} for d in judged[1:])
    assert {(r["doc_id"], r["table_id"]): r["continued_from"] for r in records.collect()} == {(1, "tbl_001"): None, (1, "tbl_002"): "tbl_001", (3, "tbl_001"): None}


def test_package_and_report(spark, tmp_path):
    made(spark).write.parquet(f"{tmp_path}/evidence")
    text = report.run(spark, f"file://{tmp_path}/evidence", f"file://{tmp_path}/out")
    assert text.startswith("# Parsing report") and "| 1 | 2 |" in text
    at = Path(tmp_path) / "out"
    assert {p.name for p in at.iterdir()} == {"documents", "tables", "images", "blocks", "records", "summary"}
    total = spark.read.json(f"file://{at}/summary").first()
    assert (total["documents"], total["raw_tables"], total["accepted_tables"], total["acceptance_rate"]) == (2, 2, 2, 1.0)


def test_reader_hook(spark):
    def pages_of(raw):
        """A reader from bytes to page rows, as a PDF library's would be; local, so workers get it by value."""
        for k, text in enumerate(raw.decode().split("\f"), 1):
            boxes = [(line, [50.0, 100.0 + 30 * i, 300.0, 112.0 + 30 * i]) for i, line in enumerate(text.split("\n"))]
            blocks = [{"type": 0, "bbox": b, "lines": [{"bbox": b, "spans": [{"text": t, "size": 10.0, "bbox": b}]}]} for t, b in boxes]
            yield {"page": k, "width": 600.0, "height": 800.0, "blocks": blocks, "words": [], "drawings": [], "ruled_tables": []}

    files = spark.createDataFrame([(5, b"Drug Name: Y\nline two\fsecond page")], "doc_id long, content binary")
    pages = evidence.from_content(files, pages_of)
    assert pages.count() == 2
    got = documents.parse(pages).documents.first()
    assert (got["page_count"], got["facts"]["drug_name"]) == (2, "Y")


def test_outputs_and_fingerprint(spark, tmp_path):
    one = spark.range(1).select(F.lit("x").alias("a"))
    sinks.write_outputs(one, one, f"file://{tmp_path}/run")
    assert spark.read.json(f"file://{tmp_path}/run/outputs/audit_log").count() == 1
    assert sinks.dependency_fingerprint({"b": b"2", "a": b"1"}) == sinks.dependency_fingerprint({"a": b"1", "b": b"2"}) != sinks.dependency_fingerprint({"a": b"2"})


def test_borderless_tables(spark):
    ws = [{"x0": 50.0 + 100 * j, "y0": 100.0 + 20 * i, "x1": 90.0 + 100 * j, "y1": 112.0 + 20 * i, "text": f"c{i}{j}"} for i in range(6) for j in range(3)]
    page = {"doc_id": 1, "page": 1, "width": 600.0, "height": 800.0, "blocks": [], "words": ws, "drawings": [], "ruled_tables": []}
    found = documents.table_evidence(spark.createDataFrame([page], evidence.EVIDENCE), borderless=True).first()
    assert found["physical_cols"] == 3 and [c["text"] for c in found["rows"][2]["cells"]] == ["c20", "c21", "c22"]


def test_long_tables_push_down_what_stands_below_them(spark, tmp_path):
    """Orders of 2, 17 and 40 lines: a paragraph that a table covers is dropped as its text."""
    spark.createDataFrame([(i, 1, "1-URGENT") for i in (2, 17, 40)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i, n, n, n, 5.0, 1.0, "N", "O") for i in (2, 17, 40) for n in range(i)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    pages = document_queries.evidence(spark, f"file://{tmp_path}").orderBy("page").collect()
    assert [len(p["ruled_tables"][0]["rows"]) for p in pages] == [2, 17, 40]
    for p in pages:
        paragraph, image, caption, number = [b["bbox"] for b in p["blocks"][-4:]]
        assert p["ruled_tables"][0]["bbox"][3] < paragraph[1] < image[1] < caption[1] < number[1] < number[3] < p["height"]
    assert pages[0]["height"] == 800.0


def test_page_content_is_what_the_steps_give(spark):
    """Texts and images of a page, without a join, against the steps that explode them; with an image of several lines of words, a copy of an image, and a block twice."""
    ws = [{"x0": x, "y0": y, "x1": x + 20, "y1": y + 8, "text": t} for x, y, t in [(340.0, 40.0, "right"), (310.0, 41.0, "left"), (310.0, 60.0, "below"), (310.0, 70.0, " "), (20.0, 700.0, "outside")]]
    blocks = [block("One", 50, 100, 80, 112), block("line", 84, 100, 110, 112), block("One", 50, 100, 80, 112), block("", 300, 30, 400, 90, 1), block("", 100, 300, 500, 700, 1), block("", 100, 300, 501, 700, 1), block("1", 290, 780, 300, 790)]
    page = {"doc_id": 1, "page": 1, "width": 600.0, "height": 800.0, "blocks": blocks, "words": ws, "drawings": [], "ruled_tables": []}
    pages = spark.createDataFrame([page, page | {"page": 2, "blocks": []}, page | {"page": 3, "words": []}], evidence.EVIDENCE)
    content = documents.page_content(pages)
    got = {r["page"]: r for r in content.collect()}
    assert "Exchange" not in content._jdf.queryExecution().executedPlan().toString()
    assert (got[2]["texts"], got[2]["images"], got[2]["recovered"]) == ([], [], 0)
    assert any("left right below" in t["text"] for t in got[1]["texts"]) and (got[1]["recovered"], got[3]["recovered"]) == (1, 0)
    assert [i["image_id"] for i in got[1]["images"]] == ["img_p1_001"] and (got[1]["duplicates"], got[3]["duplicates"], len(got[3]["images"])) == (1, 1, 2)
    found = documents.text_blocks.scan_images(pages)
    boxes = found.select("doc_id", "page", F.col("image_id").alias("box_id"), "bbox")
    near = documents.words.lines_of_words(documents.words.words_in_boxes(documents.text_blocks.scan_words(pages), boxes), ["doc_id", "page", "box_id"])
    said = pages.select("page", F.explode(F.transform(F.filter("blocks", lambda b: b["type"] == 1), lambda b: documents.words.text_in_box(F.col("words"), b["bbox"]))).alias("t")).where("t <> ''")
    assert sorted((r["page"], r["text"]) for r in near.collect()) == sorted((r["page"], r["t"]) for r in said.collect()) == [(1, "left right\nbelow")]
    steps = documents.text_blocks.merge_blocks(documents.text_blocks.scan_lines(pages), pages).where("page = 3").orderBy("ordinal").collect()
    assert [(t["block_id"], t["text"], t["bbox"], t["indices"]) for t in got[3]["texts"]] == [(r["block_id"], r["text"], r["bbox"], r["indices"]) for r in steps]
    assert {r["n_merged"] for r in steps} == {got[3]["merged"]}


def test_images_are_read_by_an_engine(spark):
    def engine(raw):
        import pandas as pd

        return pd.DataFrame({"text": ["read by it"] * len(raw), "confidence": [0.99] * len(raw)})

    pages = made(spark).withColumn("words", F.expr("filter(words, w -> false)"))
    docs = {r["doc_id"]: r for r in documents.parse(pages, engine=engine).documents.collect()}
    assert docs[1]["image_text_recovered_count"] == 1 and "read by it" in docs[1]["text"]
