"""Secret scans of very long candidates and of very many matches."""

import random
import time

import pytest

from dossio.llm import secret_scan


def scanned(spark, text):
    began = time.perf_counter()
    row = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    return row, time.perf_counter() - began


def test_a_candidate_of_a_million_characters(spark):
    rnd = random.Random(1)
    row, took = scanned(spark, "".join(rnd.choice(secret_scan.ALPHABET[:62]) for _ in range(1_000_000)))
    assert row["n_entropy"] == 1 and row["spans"] == "entropy:0:1000000" and took < 60


@pytest.mark.parametrize(("word", "column", "length"), [("password=hunter22 ", "n_assign", 17), ("0123456789abcdef01234567ff ", "n_hex", 26), ("q7Zr2Xk9Lm4Vt8Bn1Cw5Pd3Hs6 ", "n_entropy", 26)])
def test_a_hundred_thousand_matches(spark, word, column, length):
    row, took = scanned(spark, word * 100_000)
    spans = [tuple(map(int, s.split(":")[1:])) for s in row["spans"].split(",")]
    assert row[column] == len(spans) == 100_000 and took < 90
    assert all((a, b) == (i * len(word), i * len(word) + length) for i, (a, b) in enumerate(spans))


@pytest.mark.parametrize("text", ["a/" * 100_000, "/x" * 100_000, "aB" * 100_000, "z" * 500_000, "A-" * 100_000])
def test_long_candidates_that_are_no_secrets(spark, text):
    row, took = scanned(spark, text)
    assert row["spans"] == "" and took < 60
