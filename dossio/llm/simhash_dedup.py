"""SimHash near-duplicates: fingerprints linked by a grid range-join of their segments' bit counts.

A fingerprint has 64 bits, one for each bit position at which more than half of its shingles' hashes
have a 1.  It is embedded as 32 counts, the 1 bits of its 2-bit segments.  The Manhattan distance of two
embeddings never exceeds the number of differing bits, so embeddings further apart than the bound are
no link.  The 32 dimensions are dealt to parts; embeddings within the bound agree in all but ``bound`` of
the parts at most, so a grid cell is a choice of the other parts and the counts there, and every link
shares a cell.  Pairs in a cell are held to the Manhattan bound, then to the exact one.  More parts make
more grids of smaller cells: their number follows from the number of fingerprints (see parts_for).

Cells with more than CELL_LIMIT fingerprints (only huge families of almost equal texts make them) get
their links another way, exact too, without listing pairs: a bit pattern within 1 bit of one fingerprint
and 2 bits of another proves a link, and all at such a pattern hang on its smallest fingerprint.  The
number of links of each is worked out from how many fingerprints stand at each distance of such patterns.

Equal fingerprints are one node throughout, so copies are never paired with each other.

``deduplicate`` (for pipelines) also finds near copies whose fingerprints differ in more bits than any grid
can join: a text has SAMPLES further fingerprints, each of the SAMPLE shingles that a seeded order puts first,
and texts that share one are candidates.  Of those that share a fingerprint each is held against one, the text
that shares most fingerprints with others, so no pairs within a group are listed.  A candidate is verified
exactly: the sets of shingles must have ``similarity`` or more in common.

Defined results: a null, empty or blank text has no shingle and fingerprint zero, and is linked like any
other; a repeated row gets the same component; component_id ignores null ids and is null where no
document reached has an id; an empty table gives no rows; other columns, whatever their names, are ignored or
passed on.  Unlike texts that share an id, and texts without an id, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossio.llm.common import cut, row_hash
from dossio.llm.components import components

BOUND = 3
SHINGLE = 3
SEED = 42
#: What testing a pair costs against dealing a fingerprint to a grid.
PAIR_COST = 0.5
CELL_LIMIT = 4096
ODD_BITS = 0x5555555555555555
#: Sample fingerprints of a text, the shingles of each, and the odd multipliers of their orders.
SAMPLES, SAMPLE = 12, 4
ORDERS = np.random.default_rng(SEED).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits


def hash_blocks(words: list[bytes], shingle: int, block: int = 1 << 15) -> Iterator[np.ndarray]:
    """The hashes of all shingles, a block at a time."""
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    k = min(shingle, len(words))
    of, n = xxhash.xxh64_intdigest, len(words) - k + 1
    for a in range(0, n if words else 0, block):
        b = min(n, a + block)
        yield np.array([of(line[i : j - 1], SEED) for i, j in zip(starts[a:b], starts[a + k : b + k], strict=True)], dtype=">u8")


def majority(blocks) -> int:
    """The bits that more than half of the hashes have, as a signed long; 0 without any."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = 1 << 15) -> int:
    return majority(hash_blocks(words_of(text), shingle, block))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprint(t.as_py(), shingle) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _embedding(fp):
    """32 bit counts, each in 2 bits of a long: where both bits are set the count is 2, where one is, 1."""
    odd = F.lit(ODD_BITS)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _manhattan(a, b):
    """Of two packed embeddings: counts 0 to 2 differ by 1 where the low bit of their XOR is set, by 2 where only the high one is."""
    odd, x = F.lit(ODD_BITS), a.bitwiseXOR(b)
    low, high = x.bitwiseAND(odd), F.shiftrightunsigned(x, 1).bitwiseAND(odd)
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def parts_for(n: int, bound: int) -> int:
    """The number of parts that makes least work of n fingerprints: grids, each with its dealing and the pairs by chance in its cells.

    A dimension tells as much as 1.5 bits: a count is 0, 1 or 2 with chances of 1, 2 and 1 in 4.
    """
    work = lambda p: comb(p, bound) * (1 + PAIR_COST * n / 2 ** (48 * (p - bound) / p))
    return min(range(bound + 1, 17), key=work)


def _cells(bound: int, parts: int) -> list[int]:
    """A mask over the packed embedding for each choice of parts that may agree."""
    masks = [sum(3 << (2 * d) for d in range(32) if d % parts == p) for p in range(parts)]
    return [_signed(sum(c)) for c in combinations(masks, parts - bound)]


def _ball(radius: int) -> list[int]:
    """A mask for each way to flip ``radius`` bits at most."""
    return [_signed(sum(1 << i for i in c)) for r in range(radius + 1) for c in combinations(range(64), r)]


def _at(crowded: DataFrame, radius: int, node: str, bits: str) -> DataFrame:
    """(node, bits, z): each bit pattern z within ``radius`` bits of a fingerprint."""
    flip = F.explode(F.lit(_ball(radius))).alias("flip")
    return crowded.select(F.col("fp").alias(node), flip).select(node, F.bit_count("flip").alias(bits), F.col(node).bitwiseXOR(F.col("flip")).alias("z"))


def _crowded_links(crowded: DataFrame, bound: int) -> DataFrame:
    """Links that keep all connections within the bound among ``crowded`` fingerprints (column fp)."""
    near, far = bound // 2, bound - bound // 2
    at = _at(crowded, near, "u", "i").groupBy("z").agg(F.min("u").alias("u"))
    return at.join(_at(crowded, far, "v", "j"), "z").where("u <> v").select("u", "v").distinct()


def _crowded_degrees(crowded: DataFrame, bound: int) -> DataFrame:
    """(node, n): how many other ``crowded`` fingerprints differ from each in ``bound`` bits at most; lists no pairs.

    With N(i, j) the sum, over the patterns i bits from a fingerprint, of the fingerprints j bits from them, and
    n(e) the fingerprints at distance e,  N(i, j) = sum of n(e) * comb(e, t) * comb(64 - e, s),  2 s = i + j - e,
    t = i - s.  So i = d // 2 and j = d - i give n(d) from the smaller distances of its parity.
    """
    near, far = bound // 2, bound - bound // 2
    have = _at(crowded, far, "v", "j").groupBy("z").agg(*[F.count_if(F.col("j") == j).alias(f"a{j}") for j in range(far + 1)])
    steps = {d: (d // 2, d - d // 2) for d in range(1, bound + 1)}
    sums = [F.sum(F.when(F.col("i") == i, F.col(f"a{j}")).otherwise(0)).alias(f"s{d}") for d, (i, j) in steps.items()]
    found = _at(crowded, near, "node", "i").join(have, "z").groupBy("node").agg(*sums)
    n = {0: F.lit(1).cast("long")}
    for d, (i, j) in steps.items():
        known = F.lit(0).cast("long")
        for e in range(d % 2, d, 2):
            s = (d - e) // 2
            known = known + n[e] * (comb(e, i - s) * comb(64 - e, s) if i >= s else 0)
        found = found.withColumn(f"n{d}", F.expr(f"s{d}") - known).withColumn(f"n{d}", F.expr(f"n{d} div {comb(d, i)}"))
        n[d] = F.col(f"n{d}")
    return found.select("node", sum((n[d] for d in steps), F.lit(0).cast("long")).alias("n"))


def _pairs(nodes: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """All pairs (u, v) within the bound that share an uncrowded cell, and the fingerprints of crowded cells, if any."""
    masks = _cells(bound, parts_for(nodes.count(), bound))
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)])).alias("c")
    dealt = nodes.select("fp", _embedding(F.col("fp")).alias("e")).select("fp", "e", cell).select("fp", "e", "c.grid", "c.cell")
    shared = cut(dealt.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1"))
    held = cut(dealt.join(shared, ["grid", "cell"]))
    few = held.where(F.col("n") <= CELL_LIMIT).select("grid", "cell", "fp", "e")
    a, b = few.alias("a"), few.alias("b")
    fa, fb = F.col("a.fp"), F.col("b.fp")
    within = (_manhattan(F.col("a.e"), F.col("b.e")) <= bound) & (F.bit_count(fa.bitwiseXOR(fb)) <= bound)
    same = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell"))
    found = a.join(b, same & (fa < fb) & within).select(fa.alias("u"), fb.alias("v"))
    crowded = held.where(F.col("n") > CELL_LIMIT).select("fp").distinct()
    return found.distinct(), None if crowded.isEmpty() else crowded


def links(nodes: DataFrame, bound: int = BOUND) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that differ in 1 to ``bound`` bits.

    All such pairs where cells hold CELL_LIMIT fingerprints at most; beyond that, enough to connect them alike.
    """
    found, crowded = _pairs(nodes, bound)
    return found if crowded is None else found.unionByName(_crowded_links(crowded, bound)).distinct()


def _degrees(pairs: DataFrame, crowded: DataFrame | None, bound: int) -> DataFrame:
    """(node, n_links): exact.  A pair with an end outside the crowded cells shares uncrowded ones only, so it is listed."""
    both = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("b")
    if crowded is None:
        return pairs.select(both).groupBy("b.node").agg(F.count("*").alias("n_links"))
    for end in ("u", "v"):
        pairs = pairs.join(crowded.select(F.col("fp").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    listed = pairs.where("_u IS NULL OR _v IS NULL").select(both).groupBy("b.node").agg(F.count("*").alias("n"))
    return listed.unionByName(_crowded_degrees(crowded, bound)).groupBy("node").agg(F.sum("n").alias("n_links"))


def _fingerprint_edges(nodes: DataFrame, bound: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges that connect all fingerprints within the bound, the pairs of uncrowded cells, crowded fingerprints) of the distinct ones in ``nodes``."""
    pairs, crowded = _pairs(nodes.select("fp"), bound)
    pairs = cut(pairs)
    if crowded is None:
        return pairs, pairs, None
    crowded = cut(crowded)
    return cut(pairs.unionByName(_crowded_links(crowded, bound)).distinct()), pairs, crowded


def near_duplicates(docs: DataFrame, bound: int = BOUND, shingle: int = SHINGLE, count_links: bool = True) -> DataFrame:
    """A row for each document: doc_id, fp, component_id and, with ``count_links``, n_links (other fingerprints within the bound)."""
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges, pairs, crowded = _fingerprint_edges(nodes, bound)
    of = components(edges)
    if count_links:
        of = of.join(_degrees(pairs, crowded, bound), "node", "left")
    counted = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if count_links else []
    named = nodes.join(of, nodes["fp"] == of["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"), *counted)
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    out = ["fp", "component_id", *(["n_links"] if count_links else [])]
    classes = cut(named.join(lowest, "root").select(*out))
    return prints.join(classes, "fp").select("doc_id", *out)


# --- deduplication: the fingerprints' links, and near copies verified by their shingles


def sample_prints(hashes: np.ndarray) -> list[int]:
    """For each of SAMPLES seeded orders of the distinct hashes, the fingerprint of the first SAMPLE."""
    found = []
    for odd in ORDERS:
        x = hashes * odd
        x = (x ^ (x >> np.uint64(32))) * odd
        first = hashes[np.argpartition(x, SAMPLE)[:SAMPLE]] if len(x) > SAMPLE else hashes
        found.append(majority([first.astype(">u8")]))
    return found


KEY = ["no_id", "doc_id", "text_hash", "row_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """KEY, which tells rows apart that differ in anything, and the text."""
    return docs.select(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), row_hash(docs).alias("row_hash"), "text")


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """KEY, the word sequence's digest, the whole fingerprint and the sample fingerprints."""
    for b in batches:
        rows: list[tuple] = []
        for t in b.column("text"):
            words = words_of(t.as_py())
            blocks = list(hash_blocks(words, shingle))
            distinct = np.unique(np.concatenate(blocks).astype(np.uint64)) if blocks else np.zeros(0, np.uint64)
            rows.append((xxhash.xxh3_128_digest(b" ".join(words)), majority(blocks), sample_prints(distinct) if len(distinct) else []))
        made = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), pa.array(made[0], pa.binary()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.list_(pa.int64()))], [*KEY, "digest", "fp", "samples"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for node, t in zip(b.column("node"), b.column("text"), strict=True):
            shingles = np.unique(np.concatenate(list(hash_blocks(words_of(t.as_py()), shingle))).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([shingles], pa.list_(pa.int64()))], ["node", "shingles"])


def _candidates(classes: DataFrame) -> DataFrame:
    """(node, hub): texts that share a sample fingerprint, each with the one among them that shares most fingerprints with others."""
    dealt = classes.select("node", F.posexplode("samples").alias("t", "f"))
    shared = cut(dealt.join(dealt.groupBy("t", "f").agg(F.count("*").alias("n")).where("n > 1"), ["t", "f"]))
    often = shared.groupBy("node").agg(F.sum("n").alias("often"))
    hubs = shared.join(often, "node").groupBy("t", "f").agg(F.max(F.struct("often", -F.col("node"))).alias("m")).select(F.col("t").alias("ht"), F.col("f").alias("hf"), (-F.col("m.col2")).alias("hub"))
    # by a hash of the pair: both sides are dealt anew, so a fingerprint that many share can be split
    same = F.xxhash64("t", "f") == F.xxhash64("ht", "hf")
    return shared.join(hubs, same & (F.col("t") == F.col("ht")) & (F.col("f") == F.col("hf"))).where("node <> hub").select("node", "hub").distinct()


def _verified(classes: DataFrame, docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (node, hub) whose sets of shingles have ``similarity`` or more in common, as edges u, v."""
    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    first = classes.join(wanted, "node").select("node", *[F.col(f"first.{k}").alias(k) for k in KEY])
    sets = cut(_matching(docs, first).mapInArrow(lambda it: _sets(it, shingle), "node long, shingles array<long>"))
    a, b = sets.select("node", F.col("shingles").alias("sa")), sets.select(F.col("node").alias("hub"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    like = common / (F.size("sa") + F.size("sb") - common)
    return pairs.join(b, "hub").join(a, "node").where(like >= similarity).select(F.col("node").alias("u"), F.col("hub").alias("v"))


def _matching(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, text) of one row for each of ``keys`` (node, KEY)."""
    named = keys.select("node", *[F.col(k).alias(f"want_{k}") for k in KEY])
    same = (F.col("row_hash") == F.col("want_row_hash")) & (F.col("text_hash") == F.col("want_text_hash")) & F.col("doc_id").eqNullSafe(F.col("want_doc_id"))
    return _keyed(docs).join(named, same).select("node", "text").dropDuplicates(["node"])


def deduplicate(docs: DataFrame, bound: int = BOUND, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each component, the one with the smallest id (null ids last; then by text and row hash); all columns of ``docs`` stay.

    Links are fingerprints within ``bound`` bits, and candidates of the samples that ``similarity`` verifies.
    """
    sketched = cut(_keyed(docs).mapInArrow(lambda it: _sketches(it, shingle), "no_id boolean, doc_id long, text_hash long, row_hash long, digest binary, fp long, samples array<long>"))
    first = F.min(F.struct(*KEY)).alias("first")
    classes = cut(sketched.groupBy("digest", "fp", "samples").agg(first).withColumn("node", F.monotonically_increasing_id()))
    prints = cut(classes.groupBy("fp").agg(F.min("node").alias("node")))
    edges, _, _ = _fingerprint_edges(prints, bound)
    u, v = prints.select(F.col("fp").alias("u"), F.col("node").alias("un")), prints.select(F.col("fp").alias("v"), F.col("node").alias("vn"))
    by_print = edges.join(u, "u").join(v, "v").select(F.col("un").alias("u"), F.col("vn").alias("v"))
    equal = classes.select("node", "fp").join(prints.withColumnRenamed("node", "low"), "fp").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    pairs = cut(_candidates(classes))
    of = components(cut(by_print.unionByName(equal).unionByName(_verified(classes, docs, pairs, shingle, similarity))))
    named = classes.join(of, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    stay = named.groupBy("root").agg(F.min("first").alias("stay")).select("stay.*")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(F.col("doc_id").cast("long").alias("held_id"), row_hash(docs).alias("held_hash"), row.alias("row"))
    kept = stay.select(F.col("doc_id").alias("stay_id"), F.col("row_hash").alias("stay_hash"))
    same = held["held_id"].eqNullSafe(kept["stay_id"]) & (held["held_hash"] == kept["stay_hash"])
    # rows that are equal throughout are one document
    return held.join(kept, same, "left_semi").dropDuplicates(["held_id", "held_hash"]).select("row.*")
