"""Page evidence: the one physical input of the page and table layers, and a data source that makes it.

Decoding PDFs needs a library that may be missing; ``register`` takes any reader from bytes to pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPAN = "struct<text:string,size:double,bbox:array<double>>"
LINE = f"struct<bbox:array<double>,spans:array<{SPAN}>>"
BLOCK = f"struct<type:int,bbox:array<double>,lines:array<{LINE}>>"
WORD = "struct<x0:double,y0:double,x1:double,y1:double,text:string>"
DRAWING = "struct<rect:array<double>,items:array<string>>"
ROW = "struct<physical_row:int,bbox:array<double>,cells:array<struct<physical_col:int,text:string,bbox:array<double>>>>"
RULED = f"struct<bbox:array<double>,physical_cols:int,rows:array<{ROW}>>"
EVIDENCE = f"doc_id bigint, page int, width double, height double, blocks array<{BLOCK}>, words array<{WORD}>, drawings array<{DRAWING}>, ruled_tables array<{RULED}>"


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page evidence from files, with its schema."""
    return spark.read.format(fmt).schema(EVIDENCE).load(path)


def from_content(files: DataFrame, reader) -> DataFrame:
    """Page evidence of files (doc_id, content); ``reader`` maps bytes to an iterable of page rows without doc_id."""
    import pandas as pd

    names = [c.split(" ")[0] for c in ("doc_id page width height blocks words drawings ruled_tables").split(" ")]

    def run(batches):
        for b in batches:
            rows = [{"doc_id": d, **page} for d, raw in zip(b["doc_id"], b["content"], strict=True) for page in reader(raw)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("doc_id", "content").mapInPandas(run, EVIDENCE)
