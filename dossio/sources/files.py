"""Files by format: discovery, dispatch by suffix, and decoders of Word, slide, XML and plain-text content.

Content is read by Spark (binaryFile), so any store that Spark reaches will do; Python decodes bytes at the
edge, batch by batch, and every document's failure is a row of rejects, not of the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossio.functions import cast as C
from dossio.functions import text as T
from dossio.shipping import ship

OLE = bytes.fromhex("D0CF11E0A1B11AE1")
ENCODINGS = ("utf-8", "gb18030", "utf-16le", "utf-16be")
LEAST_QUALITY = 0.55
PLAIN_HINT = "doc-plain-text"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
UNIT = "struct<ordinal:int,pointer:string,tag:string,attributes:map<string,string>,text:string,notes:string>"
DECODED = f"path string, source_type string, units array<{UNIT}>, page_count int, parser_hint string, error string"


def discover(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, suffix, size, content) of the files under ``root`` whose name fits, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", C.suffix(F.col("path")).alias("suffix"), F.col("length").alias("size"), "content")


def supported(files: DataFrame) -> DataFrame:
    return files.where(F.col("suffix").isin(*C.SUFFIXES))


def rejected(files: DataFrame) -> DataFrame:
    return files.where(~F.col("suffix").isin(*C.SUFFIXES)).select("path", F.concat(F.lit("Unsupported file type: "), F.col("suffix")).alias("error"))


def _squeeze(s: str | None) -> str:
    return " ".join((s or "").split())


def _unit(ordinal: int, text: str, pointer: str | None = None, tag: str | None = None, attributes: dict | None = None, notes: str | None = None) -> dict:
    return {"ordinal": ordinal, "pointer": pointer, "tag": tag, "attributes": attributes or {}, "text": text, "notes": notes}


def decode_docx(raw: bytes) -> tuple[list[dict], int | None, str]:
    """Body paragraphs with text, with their place among all; the page count if the file says it."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        try:
            pages = re.search(r"<Pages>(\d+)</Pages>", z.read("docProps/app.xml").decode("utf-8", "ignore"))
        except KeyError:
            pages = None
    tail = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    units = []
    for i, p in enumerate(body.findall(f"{W}p") if body is not None else []):
        text = _squeeze("".join(e.text or "" if e.tag == f"{W}t" else tail.get(e.tag, "") for e in p.iter()))
        if text:
            units.append(_unit(i, text))
    if not units:
        raise ValueError("the document has no text")
    return units, int(pages[1]) if pages else None, "docx-paragraphs"


def _slide_number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def _runs(raw: bytes) -> list[str]:
    found = []
    for shape in ElementTree.fromstring(raw).iter("{http://schemas.openxmlformats.org/presentationml/2006/main}sp"):
        text = "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in shape.iter(f"{A}p")).strip()
        if text:
            found.append(text)
    return found


def decode_pptx(raw: bytes) -> tuple[list[dict], int | None, str]:
    """A unit for each slide: texts of its shapes, one a line, and the notes of that number, the empty text without any."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_slide_number)
        notes = {_slide_number(n): "\n".join(t for t in _runs(z.read(n)) if not t.isdigit()) for n in names if re.fullmatch(r"ppt/notesSlides/notesSlide\d+\.xml", n)}
        return [_unit(k, "\n".join(_runs(z.read(n))), notes=notes.get(_slide_number(n), "")) for k, n in enumerate(slides, 1)], None, "pptx-generic-v1"


def decode_ppt(raw: bytes) -> tuple[list[dict], int | None, str]:
    lines = [x.strip() for x in raw.decode("utf-8", "ignore").splitlines() if x.strip()]
    return [_unit(k, x, notes="") for k, x in enumerate(lines, 1)], None, "pptx-generic-v1"


def decode_xml(raw: bytes) -> tuple[list[dict], int | None, str]:
    """Nodes in document order with pointers that count all siblings; a malformed file gives a node for each line."""
    text = raw.decode("utf-8", "ignore")
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        lines = ((i, _squeeze(x)) for i, x in enumerate(text.splitlines()))
        return [_unit(i, x, f"/raw[{i}]", "raw") for i, x in lines if x], None, "xml-fallback-plain-text"
    units, todo = [], [(root, f"/{root.tag}[0]")]
    while todo:
        node, at = todo.pop()
        units.append(_unit(len(units), _squeeze(node.text), at, node.tag, dict(node.attrib)))
        todo.extend(reversed([(child, f"{at}/{child.tag}[{i}]") for i, child in enumerate(node)]))
    return units, None, "xml-tree-v1"


def decode_doc(raw: bytes, converter=None) -> tuple[list[dict], int | None, str]:
    """Legacy Word through an external converter (bytes to text or None); without its text, a candidate for each of ENCODINGS.

    Candidates are units whose pointer names the encoding; ``decode`` scores them and keeps the lines of the best.
    """
    text = converter(raw) if converter else None
    if text:
        return [_unit(i, t) for i, x in enumerate(text.splitlines()) if (t := _squeeze(x.replace("\x00", "")))], None, "doc-converter"
    if raw[:8] == OLE:
        raise ValueError("a legacy Word file needs a converter")
    return [_unit(k, "\n".join(filter(None, map(_squeeze, raw.decode(e, "ignore").splitlines()))), pointer=e) for k, e in enumerate(ENCODINGS)], None, PLAIN_HINT


def best_candidate(units):
    """The text of best quality among candidates, the first on ties; null where none reaches LEAST_QUALITY or all are mojibake."""
    scored = F.transform(F.filter(units, lambda u: ~T.is_mojibake(u["text"])), lambda u: F.struct(T.text_quality(u["text"]).alias("q"), (-u["ordinal"]).alias("o"), u["text"].alias("text")))
    best = F.array_max(scored)
    return F.when(best["q"] >= LEAST_QUALITY, best["text"])


def _settled(decoded: DataFrame) -> DataFrame:
    """Decoded files with candidates replaced by the lines of the best; one without is an error."""
    plain = F.col("parser_hint") == PLAIN_HINT
    lines = F.transform(T.paragraphs_of(F.col("_best")), lambda p: F.struct(p["index"].alias("ordinal"), F.lit(None).cast("string").alias("pointer"), F.lit(None).cast("string").alias("tag"), F.create_map().cast("map<string,string>").alias("attributes"), p["text"].alias("text"), F.lit(None).cast("string").alias("notes")))
    none = F.array().cast(f"array<{UNIT}>")
    made = decoded.withColumn("_best", F.when(plain, best_candidate(F.col("units"))))
    made = made.withColumn("units", F.when(plain, F.coalesce(lines.cast(f"array<{UNIT}>"), none)).otherwise(F.col("units")))
    empty = plain & (F.size("units") == 0)
    return made.withColumn("error", F.when(empty, "ValueError: the document has no text").otherwise(F.col("error"))).withColumn("parser_hint", F.when(~empty | F.col("parser_hint").isNull(), F.col("parser_hint"))).drop("_best")


DECODERS = {".docx": (decode_docx, "word"), ".doc": (decode_doc, "word"), ".pptx": (decode_pptx, "presentation"), ".ppt": (decode_ppt, "presentation"), ".xml": (decode_xml, "xml")}


def decode(files: DataFrame, pdf=None) -> DataFrame:
    """Each file (path, suffix, content) with its units; a failure has its message in ``error``.

    ``pdf`` decodes PDF content to (units, pages, hint); without it PDFs are errors, and their pages come as page evidence.
    """
    ship(files.sparkSession)

    def one(path: str, suffix: str, raw: bytes) -> dict:
        reader, kind = (pdf, "pdf") if suffix == ".pdf" else DECODERS.get(suffix, (None, None))
        row = {"path": path, "source_type": kind, "units": [], "page_count": None, "parser_hint": None, "error": None}
        try:
            if reader is None:
                raise ValueError(f"no decoder for {suffix}")
            units, pages, hint = reader(raw)
            return row | {"units": units, "page_count": pages, "parser_hint": hint}
        except Exception as e:  # any broken file is its own reject
            return row | {"error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([one(*x) for x in zip(b["path"], b["suffix"], b["content"], strict=True)], columns=[c.split(" ")[0] for c in DECODED.split(", ")])
            made["page_count"] = made["page_count"].astype("Int32")
            yield made

    return _settled(files.select("path", "suffix", "content").mapInPandas(run, DECODED))


def documents(decoded: DataFrame) -> DataFrame:
    """Decoded files with text (units that hold some, one a line), facts and counts."""
    good = decoded.where("error IS NULL")
    said = lambda f: F.filter(F.transform("units", f), lambda x: x != "")
    with_notes = F.filter(F.flatten(F.transform("units", lambda u: F.array(u["text"], F.coalesce(u["notes"], F.lit(""))))), lambda x: x != "")
    text = F.array_join(F.when(F.col("source_type") == "presentation", with_notes).otherwise(said(lambda u: u["text"])), "\n")
    return good.withColumn("text", text).withColumn("facts", T.extract_facts(F.col("text"))).withColumn("n_units", F.size("units"))


def errors(decoded: DataFrame) -> DataFrame:
    return decoded.where("error IS NOT NULL").select("path", "error")


def is_ole(content):
    return F.hex(F.substring(content, 1, 8)) == OLE.hex().upper()
