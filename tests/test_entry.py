"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from dossio.plans import document_queries, operator_queries  # noqa: F401  (they register their queries)
from dossio.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    if name in core.ORACLES:
        want = duck.sql(core.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0
