"""Mixing sources to target weights, by DataFrame functions alone.

Every document gets a hash-random key.  Within a source, documents are dealt to ranges of the key; prefix sums
of the ranges' totals (over blocks of ranges, then inside each block) give each range's start, and a running sum
inside the range gives each document's start in its source's random order.  A source's budget of words is cut
there exactly: whole epochs first, then the documents up to the cut, the one that the cut falls into in part.

Targets: sources in code-point order, null last, take the weights in turn; the sources share ``share`` times
all words by weight, none above ``most`` times its own words, what is above being shared again by weight.
Sources are labels: their table (a row for each source, with sums) is ordered in one task, which bounds them to
some millions; documents are never gathered by source.

Defined results: a null text has 0 words; a source without words has target 0; the order is by key, then
document id, text and all other columns, so reruns agree; of repeated rows each counts and is cut on its own; an
empty table gives no rows; other columns, whatever their names, are passed on where documents are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossio.llm.common import cut, row_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Rows of a source that make one key range; a range's rows are summed in one task.
RANGE_ROWS = 1000
#: Ranges whose totals are summed in one task; blocks of ranges are summed in another.
BLOCK_RANGES = 1000
#: Sources whose table, under 100 bytes a row but for the name, may be broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 10_000
SPACE = "\\x20\\x09-\\x0D"


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, source_rows, target) from a table with columns source and size.

    Sources in ascending order of cap over weight fill up first; the level at which the rest stand is
    the budget left over the weight left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cap = F.col("source_size") * F.lit(float(most))
    placed = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    summed = placed.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    stands = summed.withColumn("stand", F.when(F.col("left") / F.col("weight_left") < F.col("level"), F.col("left") / F.col("weight_left")))
    final = stands.withColumn("water", F.first("stand", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return final.select("source", "source_size", "source_rows", F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


#: A source as columns that are never null, so joins and windows on them share one partitioning.
SOURCE = ["source_name", "no_source"]
TIES = ["doc_id", "size", "text_hash", "row_hash"]


def _sized(docs: DataFrame, *more) -> DataFrame:
    """(doc_id, source, SOURCE, size, text_hash, row_hash) and ``more`` of each document."""
    named = [F.coalesce("source", F.lit("")).alias(SOURCE[0]), F.col("source").isNull().alias(SOURCE[1])]
    return docs.select("doc_id", "source", *named, n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), row_hash(docs).alias("row_hash"), *more)


def _small(aims: DataFrame) -> DataFrame:
    """The sources' table, written out, marked for broadcast if it has BROADCAST_SOURCES rows at most."""
    aims = cut(aims)
    return F.broadcast(aims) if aims.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else aims


def _keyed(sized: DataFrame, aims: DataFrame, seed: int) -> DataFrame:
    """``sized`` with its source's source_size, source_rows and target, and with its key and range."""
    a, b = sized.withColumn("key", F.xxhash64(F.lit(seed), *TIES)).alias("a"), aims.alias("b")
    spread = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / RANGE_ROWS)).cast("long")
    # a range of the key: its place in 0..1 times the number of ranges
    place = (F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53)) * spread).cast("long")
    held = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "inner").select("a.*", "b.source_size", "b.source_rows", "b.target")
    return held.withColumn("range", F.least(place, spread - 1))


def _starts(keyed: DataFrame) -> DataFrame:
    """(SOURCE, range, start) for each range of each source: the words before it, by prefix sums over blocks of ranges, then inside them."""
    parts = keyed.groupBy(*SOURCE, "range").agg(F.sum("size").alias("n")).withColumn("block", F.floor(F.col("range") / BLOCK_RANGES))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = parts.groupBy(*SOURCE, "block").agg(F.sum("n").alias("n")).select(*SOURCE, "block", before(Window.partitionBy(*SOURCE).orderBy("block")).alias("base"))
    inside = parts.withColumn("inside", before(Window.partitionBy(*SOURCE, "block").orderBy("range")))
    return inside.join(blocks, [*SOURCE, "block"]).select(*SOURCE, "range", (F.col("base") + F.col("inside")).alias("start"))


def _taken(keyed: DataFrame, starts: DataFrame) -> DataFrame:
    """``keyed`` with taken: the words that the mix takes of the row."""
    inside = Window.partitionBy(*SOURCE, "range").orderBy("key", *TIES).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - (F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return keyed.join(starts, [*SOURCE, "range"]).withColumn("taken", epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest)))


def mix(docs: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken."""
    sized = cut(_sized(docs))
    keyed = _keyed(sized, _small(targets(sized, weights, share, most)), seed)
    return _taken(keyed, _starts(keyed)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: a document as often as whole epochs take it, and once more, cut after the words left, where a cut falls into it.

    Rows have the columns of ``docs``; n_chars, if there, is that of the text as cut.  A row travels once, whole, to
    its range of its source; the columns stand in one struct, so none clashes with those worked out here.
    """
    sized = cut(_sized(docs))
    aims = _small(targets(sized, weights, share, most))
    starts = cut(_starts(_keyed(sized, aims, seed)))
    whole = _keyed(_sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), aims, seed)
    took = _taken(whole, starts).where("taken > 0").select("row", "size", "taken")
    took = took.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.col("taken") - F.col("copy") * F.col("size")
    pieces = F.regexp_extract_all("row.text", F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    text = F.when(left >= F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), left.cast("int")), ""))
    out = took.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)))
    return out.select("row.*")
