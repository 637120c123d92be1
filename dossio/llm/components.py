"""Connected components of an edge table by alternating stars, entirely on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossio.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` with their u's m.  Joined by a hash beside u, so both sides are dealt anew and the centre of a large star can be split."""
    named = low.select(F.col("u").alias("low_u"), "m")
    return edges.join(named, (F.xxhash64("u") == F.xxhash64("low_u")) & (F.col("u") == F.col("low_u"))).drop("low_u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_low(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = _with_low(down, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it reaches.

    ``edges`` has columns u and v of one orderable type; direction, repeats and loops don't matter.
    Lineage is cut by a checkpoint in the shared folder after each round.
    """
    now = cut(edges.where("u <> v").distinct())
    state = _state(now)
    while True:
        now = cut(_small_star(_large_star(now)))
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
