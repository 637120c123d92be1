"""Near-duplicate lines by a deletion-neighbourhood join, by DataFrame functions alone.

A line is what stands between newlines, trimmed of blanks.  Two lines of LEAST characters or more are near
when one edit (a character replaced, put in or taken out) turns one into the other; shorter lines must be
equal; blank lines are left alone.  An occurrence of a line is dropped when an equal or a near line occurs
earlier, in order of (doc_id, line number).

Every way to delete one character of a line gives a variant.  Two lines are one replacement apart when
they have a variant in common that lacks the same place, and one insertion apart when a variant of one is
the other.  Variants are hashed keys; equal keys meet by grouping, each line is held against the earliest
of its group only, and the edit distance is verified on the lines themselves.  Members of a group are all
one edit apart, so the earliest of the groups is the earliest of the neighbours, and no pairs are listed.

Where two lines are one edit apart, they agree outside one of SEGMENTS segments.  A line is keyed by each
way to leave a segment out; only lines that share a key make variants, and only of the segment left out.

Defined results: a null text has no lines; rows that repeat an id and text are one document, so their
equal lines count once and get the same verdict; ids that are null come first; an empty table gives no
rows; other columns are ignored or passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossio.llm.common import cut

LEAST = 16
SEGMENTS = 6
#: Bytes of a key table that may be broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 32 << 20
#: A line with more than this share of all lines is hot; there are HOT_SHARE such lines at most.
HOT_SHARE = 1000


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the lines that aren't blank, trimmed, numbered from 0."""
    exploded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return exploded.withColumn("line", F.trim("line")).where("line <> ''")


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), "line")})


def _framed(lines: DataFrame) -> DataFrame:
    """``lines`` (line, ...) with a row for each way to leave a segment out: key, which hashes the rest, and ``way``.

    Segments are sized by the line's length and, where that gives another size, by one less.  With segments of u
    characters, way k leaves out what stands between the first k * u and the last (SEGMENTS - 1 - k) * u.  Each
    segment is hashed once, counted from the beginning and from the end; a key hashes those hashes.
    """
    n = F.length("line")
    sized = lines.withColumn("n", n).withColumn("u", (F.col("n") / SEGMENTS).cast("int"))
    again = F.col("n") % SEGMENTS == 0  # one character less makes smaller segments
    hashes, keys = {}, []
    for less in (0, 1):
        u = F.col("u") - less
        for i in range(SEGMENTS - 1):
            head, tail = F.xxhash64(F.substring("line", u * i + 1, u)), F.xxhash64(F.substring("line", F.col("n") - u * (i + 1) + 1, u))
            hashes[f"head{less}{i}"], hashes[f"tail{less}{i}"] = (head, tail) if not less else (F.when(again, head), F.when(again, tail))
        keys.append(F.array(*[F.xxhash64(F.lit(k), u, *[F.col(f"head{less}{i}") for i in range(k)], *[F.col(f"tail{less}{i}") for i in range(SEGMENTS - 1 - k)]) for k in range(SEGMENTS)]))
    every = F.when(again, F.concat(*keys)).otherwise(keys[0])
    return sized.withColumns(hashes).select(*lines.columns, "n", "u", F.posexplode(every).alias("way", "key"))


def _middle():
    """What a row of ``_framed`` leaves out."""
    u, k = F.col("u") - (F.col("way") / SEGMENTS).cast("int"), F.col("way") % SEGMENTS
    return F.substring("line", u * k + 1, F.col("n") - u * (SEGMENTS - 1))


def _leaves(kind) -> int:
    return sum(_leaves(f.dataType) for f in kind.fields) if hasattr(kind, "fields") else 1


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` (a checkpoint of numbers), marked for broadcast where it has few enough bytes, by its rows and their width."""
    most = BROADCAST_BYTES // (32 + 12 * _leaves(df.schema))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _near(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2, near_first): the earliest occurrence of any near line, for lines that have one."""
    long_lines = _hashed(lines.where(F.length("line") >= LEAST).select("line"))
    framed = _framed(long_lines)
    shared = cut(framed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"))
    few = framed.join(_bounded(shared), "key", "left_semi").withColumn("mid", _middle()).groupBy("h1", "h2", "key", "mid").agg(F.min("line").alias("line"))
    owners = cut(few.join(firsts, ["h1", "h2"]).select("h1", "h2", "key", "mid", "line", "first"))

    at = F.sequence(F.lit(1), F.length("mid"))
    variant = lambda i: F.xxhash64(F.concat(F.substring("mid", F.lit(1), i - 1), F.substring("mid", i + 1, F.length("mid"))))
    variants = owners.select("h1", "h2", "key", "first", F.posexplode(F.transform(at, variant)).alias("place", "x"))
    # a replacement: the same variant that lacks the same place
    group = ["key", "place", "x"]
    lead = cut(variants.groupBy(*group).agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min(F.struct("first", "h1", "h2")).alias("to")).where("a <> b").drop("a", "b"))
    replaced = variants.join(_bounded(lead), group).select("h1", "h2", "to")
    # an insertion: a variant that is the other line
    whole = cut(owners.select("key", F.xxhash64("mid").alias("x"), F.struct("first", "h1", "h2").alias("w")))
    put = cut(variants.select("h1", "h2", "key", "first", "x").distinct().join(_bounded(whole), ["key", "x"]))
    shorter = put.select("h1", "h2", F.col("w").alias("to"))
    longer = put.groupBy("w").agg(F.min(F.struct("first", "h1", "h2")).alias("to")).select("w.h1", "w.h2", "to")

    found = replaced.unionByName(shorter).unionByName(longer).where("h1 <> to.h1 OR h2 <> to.h2").distinct()
    texts = owners.select("h1", "h2", "line").distinct()
    mine, theirs = texts.select("h1", "h2", F.col("line").alias("l")), texts.select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.col("line").alias("r"))
    held = found.join(mine, ["h1", "h2"]).join(theirs, (F.col("to.h1") == F.col("t1")) & (F.col("to.h2") == F.col("t2")))
    return held.where(F.levenshtein("l", "r", 1) >= 0).groupBy("h1", "h2").agg(F.min("to.first").alias("near_first"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no) of every occurrence that an earlier equal or near line makes redundant.

    The occurrences of a hot line are dealt to several tasks, its verdict to each of them.
    """
    lines = lines_of(docs)
    seen = _hashed(lines).select("h1", "h2", "doc_id", "line_no")
    firsts = cut(seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")))
    near = cut(_near(lines, firsts))
    share = max(1, (firsts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    deals = F.ceil(F.col("n") / share).cast("int")
    # lines that occur once and have no earlier neighbour need no verdict
    verdict = firsts.join(near, ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("near_first").isNotNull()).select("h1", "h2", F.least("first", F.coalesce("near_first", "first")).alias("keep"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    hot = F.broadcast(firsts.where(F.col("n") > share).select("h1", "h2", deals.alias("deals")))  # HOT_SHARE rows at most
    dealt = seen.join(hot, ["h1", "h2"], "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("doc_id", "line_no"), F.col("deals")), F.lit(0)).cast("int"))
    return dealt.join(verdict, ["h1", "h2", "deal"]).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("keep"))).select("doc_id", "line_no").distinct()


def _drops(docs: DataFrame) -> DataFrame:
    return dropped_lines(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("drop_id")).agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))


def report(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped, dropped (line numbers from 0, joined by commas)."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"))
    both = sizes.join(drops := _drops(docs), sizes["doc_id"].eqNullSafe(drops["drop_id"]), "left")
    none = F.array().cast("array<int>")
    return both.select("doc_id", "n_lines", F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"), F.array_join(F.coalesce("dropped", none), ",").alias("dropped"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the redundant lines taken out of their texts; all columns stay, in one struct on the way."""
    drops = _drops(docs)
    held = docs.select(F.col("doc_id").cast("long").alias("held_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lines = F.split("row.text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("dropped", s["i"]))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    both = held.join(drops, held["held_id"].eqNullSafe(drops["drop_id"]), "left")
    return both.select(F.col("row").withField("text", text).alias("row")).select("row.*")


ORACLE = f"""
    WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, i - 1 AS line_no, trim(ls[i], ' ') AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
    o AS (SELECT * FROM l WHERE line <> ''),
    d AS (SELECT line, min((doc_id, line_no)) AS first, length(line) AS n, string_split(line, '') AS c FROM o GROUP BY line),
    f AS (SELECT * FROM d WHERE n >= {LEAST}),
    near AS (
        SELECT a.line AS p, b.line AS q FROM f a JOIN f b ON a.n = b.n AND a.line < b.line AND levenshtein(a.line, b.line) <= 4
            WHERE len(list_filter(list_zip(a.c, b.c), lambda z: z[1] <> z[2])) = 1
        UNION SELECT a.line, b.line FROM f a JOIN f b ON a.n + 1 = b.n AND levenshtein(a.line, b.line) <= 4
            WHERE list_contains(list_transform(range(1, b.n + 1), lambda i: left(b.line, i - 1) || substr(b.line, i + 1)), a.line)),
    both_ways AS (SELECT p, q FROM near UNION SELECT q, p FROM near),
    keep AS (SELECT d.line, least(min(d.first), min(coalesce(e.first, d.first))) AS k FROM d LEFT JOIN both_ways ON p = d.line LEFT JOIN d e ON e.line = q GROUP BY d.line),
    x AS (SELECT DISTINCT doc_id, line_no FROM o JOIN keep USING (line) WHERE (doc_id, line_no) <> k),
    per AS (SELECT doc_id, count(*) AS n_dropped, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped FROM x GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped FROM s LEFT JOIN per USING (doc_id)"""
