"""Helpers that the training-data operators share: reading, ordering, scratch folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossio.shared import shared_folder
from dossio.shipping import ship

#: Most ranges of one ordered exchange.  Ranges are streamed and sorted with spills, so beyond this number they grow
#: in size, not in memory: 100 TB make ranges of 1.5 GB.
MAX_RANGES = 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_uri(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def row_hash(docs: DataFrame):
    """A hash of all columns that can be hashed: rows equal in them are taken for repeats."""
    names = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{n}`") for n in names])


def range_bounds(df: DataFrame, key: str, rows_per_range: int = 4096) -> list:
    """Ascending distinct key values that split ``df`` into ranges of about equal rows.

    Only the key column is read; at most MAX_RANGES values reach the driver.
    """
    n = max(1, min(MAX_RANGES, -(-df.count() // rows_per_range)))
    if n == 1:
        return []
    at = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.agg(F.percentile_approx(key, at, F.lit(max(10000, 4 * n))).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_of(key, bounds: list):
    """Number of bounds at or below the key, found by halving; null keys fall into range 0."""
    if not bounds:
        return F.lit(0)
    held = F.lit(bounds)
    steps = len(bounds).bit_length()
    zero, full = F.lit(0), F.lit(len(bounds))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = ((lo + hi) / 2).cast("int")
        right = F.element_at(held, F.least(mid, full - 1) + 1) <= key
        return F.when(lo >= hi, acc).when(right, F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))

    start = F.struct(zero.alias("lo"), full.alias("hi"))
    return F.when(key.isNull(), 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, step, lambda a: a["lo"]))


def in_order(df: DataFrame, key: str, ties: list, rows_per_range: int = 4096) -> tuple[DataFrame, int]:
    """``df`` with a column ``_range``, one partition a range, rows sorted by key (nulls first), then ties.

    Rows without a key all fall into the first range, which is streamed and sorted with spills like the others.
    """
    bounds = range_bounds(df, key, rows_per_range)
    n = len(bounds) + 1
    dealt = df.withColumn("_range", range_of(F.col(key), bounds)).repartitionById(n, F.col("_range"))
    return dealt.sortWithinPartitions(F.col(key).asc_nulls_first(), *ties), n
