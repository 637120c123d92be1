"""Decoders, sinks and intake on files made here."""

import io
import zipfile

from pyspark.sql import functions as F

from dossio.sources import files, sinks
from dossio.streaming import intake

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def slide(text):
    return f"<p:sld {P}><p:sp><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"


CONTENT = {
    "a.docx": archive({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Drug Name: X</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t><w:tab/><w:t>words</w:t></w:r></w:p></w:body></w:document>", "docProps/app.xml": "<Properties><Pages>7</Pages></Properties>"}),
    "b.pptx": archive({"ppt/slides/slide1.xml": slide("One"), "ppt/slides/slide2.xml": slide("Two"), "ppt/notesSlides/notesSlide2.xml": slide("Said")}),
    "c.xml": b'<r a="1"><x>t</x><y><z/>tail</y></r>',
    "d.xml": b"<r>\n broken  line\n\n<",
    "e.doc": "普通文本 content here, plain\n第二行 text".encode(),
    "f.doc": files.OLE + b"rest",
    "g.ppt": b"line one\n\n line two ",
    "h.pdf": b"%PDF",
}


def decoded(spark):
    rows = [(n, "." + n.split(".")[1], c) for n, c in CONTENT.items()]
    return files.decode(spark.createDataFrame(rows, "path string, suffix string, content binary"))


def test_decoders(spark):
    got = {r["path"]: r for r in decoded(spark).collect()}
    assert ([(u["ordinal"], u["text"]) for u in got["a.docx"]["units"]], got["a.docx"]["page_count"]) == ([(0, "Drug Name: X"), (2, "two words")], 7)
    assert [(u["text"], u["notes"]) for u in got["b.pptx"]["units"]] == [("One", ""), ("Two", "Said")]
    assert [(u["pointer"], u["text"]) for u in got["c.xml"]["units"]] == [("/r[0]", ""), ("/r[0]/x[0]", "t"), ("/r[0]/y[1]", ""), ("/r[0]/y[1]/z[0]", "")]
    assert got["c.xml"]["units"][0]["attributes"] == {"a": "1"}
    assert [u["pointer"] for u in got["d.xml"]["units"]] == ["/raw[0]", "/raw[1]", "/raw[3]"] and got["d.xml"]["parser_hint"] == "xml-fallback-plain-text"
    assert [u["text"] for u in got["e.doc"]["units"]] == ["普通文本 content here, plain", "第二行 text"]
    assert "converter" in got["f.doc"]["error"] and got["h.pdf"]["error"]
    assert [u["ordinal"] for u in got["g.ppt"]["units"]] == [1, 2]
    docs = {r["path"]: r for r in files.documents(decoded(spark)).collect()}
    assert docs["a.docx"]["facts"] == {"drug_name": "X"} and docs["b.pptx"]["text"] == "One\nTwo\nSaid"
    assert {r["path"] for r in files.errors(decoded(spark)).collect()} == {"f.doc", "h.pdf"}


def test_discovery_and_dispatch(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/A.XML").write_bytes(CONTENT["c.xml"])
    (tmp_path / "note.txt").write_text("x")
    found = files.discover(spark, str(tmp_path))
    assert [r["suffix"] for r in files.supported(found).collect()] == [".xml"] and files.rejected(found).first()["error"] == "Unsupported file type: .txt"
    assert spark.createDataFrame([(files.OLE,)], "c binary").select(files.is_ole(F.col("c")).alias("o")).first()["o"]


def test_run_package(spark, tmp_path):
    at = sinks.create_run(spark, f"file://{tmp_path}", sinks.run_id("abcdefghij", "20200101"), spark.createDataFrame([("f1", "a.pdf")], "file_id string, filename string"), {"engine": "1"})
    assert at.endswith("run_id=run_20200101_abcdefgh")
    sinks.append_log(spark, at, "started")
    sinks.append_log(spark, at, "ended", "WARN")
    assert sorted(r["value"].split(" | ")[1] for r in spark.read.text(f"{at}/log").collect()) == ["INFO", "WARN"]
    tables = spark.createDataFrame([(1, "tbl_001"), (2, "tbl_001")], "doc_id int, table_id string")
    sinks.write_tables(tables, at)
    assert spark.read.json(f"{at}/tables").count() == 2
    sinks.finish_run(spark, at, "completed")
    assert {r["status"] for r in spark.read.json(f"{at}/manifest").collect()} == {"running", "completed"}


def test_intake_stream(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    (land / "c.xml").write_bytes(CONTENT["c.xml"])
    seen = []
    q = intake.each_batch(intake.incoming_files(spark, str(land)), lambda df, _: seen.extend(r["path"] for r in files.decode(df).collect()), str(tmp_path / "state"))
    q.awaitTermination()
    assert len(seen) == 1
