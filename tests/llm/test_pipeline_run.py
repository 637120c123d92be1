"""The pipeline's run(): all stages in a row, each reading what the one before it wrote."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_run(spark):
    rows = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["start"])
    assert rows and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids) and set(ids) <= {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
