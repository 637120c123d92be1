"""Operators that pass documents on: every name that they use inside may be a column of the documents; repeated rows; one id for unlike texts."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dossio.llm import decontaminate, line_dedup, lz_fingerprint, mixing, quality, secret_scan, simhash_dedup, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def names_inside(module):
    """Every word in quotes in a module that could be a column's name."""
    found = set(re.findall(r'"([A-Za-z_]\w{0,24})"', Path(module.__file__).read_text()))
    return sorted({n.lower(): n for n in found if n.lower() not in ("doc_id", "text", "lang", "source", "n_chars")}.values())


def clashing(spark, module):
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(["one two three", None, "", "four five six seven", "one two three", "x " * 50])]
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("clash") for n in names_inside(module)})


MODEL = quality.Model()


@pytest.mark.parametrize(
    ("module", "run", "same_columns"),
    [
        (mixing, mixing.mixed_documents, True),
        (mixing, mixing.mix, False),
        (line_dedup, line_dedup.clean, True),
        (line_dedup, line_dedup.report, False),
        (simhash_dedup, simhash_dedup.deduplicate, True),
        (simhash_dedup, simhash_dedup.near_duplicates, False),
        (secret_scan, secret_scan.scan, False),
        (lz_fingerprint, lz_fingerprint.fingerprints, False),
        (quality, lambda d: quality.keep_good(d, MODEL), True),
        (quality, lambda d: quality.score(d, MODEL), False),
        (toxicity, lambda d: toxicity.score(d, toxicity.Chain({}, 0.5)), False),
        (decontaminate, lambda d: decontaminate.drop_documents(d, []), True),
        (decontaminate, lambda d: decontaminate.remove_spans(d, []), True),
        (token_files, lambda d: token_files.token_files(d.sparkSession, d, token_files.default_tokenizer()), False),
    ],
)
def test_names_used_inside_may_be_columns(spark, module, run, same_columns):
    d = clashing(spark, module)
    made = run(d)
    rows = made.collect()
    assert rows
    if same_columns:
        assert made.columns == d.columns and all(r[n] == "clash" for r in rows for n in names_inside(module))


def test_one_id_for_unlike_texts(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "one two three four five six seven"]
    d = spark.createDataFrame([(7, t, "en", "a", 1) for t in texts] + [(None, texts[0], "en", "a", 1), (None, "no id here at all", "en", "a", 2)], DOCS)
    left = simhash_dedup.deduplicate(d).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(7, texts[0]), (7, texts[1]), (None, "no id here at all")])
    # the same rows in another order, and with another row without an id: the same ones stay
    more = d.unionByName(spark.createDataFrame([(None, "quite another text of no id", "en", "a", 2)], DOCS)).repartition(3)
    again = simhash_dedup.deduplicate(more).collect()
    assert {(r["doc_id"], r["text"]) for r in left} < {(r["doc_id"], r["text"]) for r in again} and len(again) == 4


@pytest.mark.parametrize("seed", range(6))
def test_repeated_rows_in_the_mix(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    monkeypatch.setattr(mixing, "BLOCK_RANGES", 2)
    rows = [(1, "w " * 10, "en", "a", 20)] * 9 + [(2, "v " * 10, "en", "a", 20), (2, "u " * 10, "de", "a", 20), (3, "t " * 7, "en", "b", 14), (4, "s", "en", "c", 1)]
    d = spark.createDataFrame(rows, DOCS)
    taken = Counter()
    for r in mixing.mix(d, seed=seed).collect():
        taken[r["source"]] += r["taken"]
    words = Counter()
    for r in mixing.mixed_documents(d, seed=seed).collect():
        words[r["source"]] += len(r["text"].split())
    assert words == Counter({s: n for s, n in taken.items() if n}) and words["a"] == sum(r["target"] for r in mixing.mix(d, seed=seed).where("source = 'a'").limit(1).collect())
