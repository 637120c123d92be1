"""Lempel-Ziv phrase fingerprints of documents, for compression-like similarity.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the shortest stretch not met as a
phrase before (a last stretch that repeats a phrase adds nothing).  The set of phrases is hashed, and the
fingerprint holds, for each of PERMUTATIONS mixings of the hashes, 16 bits of the smallest.  The share of
equal places estimates the Jaccard likeness of two phrase sets, which follows how well one text compresses
given the other.

A text and its edited form share their first part, so their parses do too: the parse is carried on from
there once for each ending.

Defined results: null is the empty text; the empty text has no phrases, is fully like another empty text
and not at all like any other; equal texts have equal fingerprints; rows go in ascending order of doc_id
(nulls first, then by the text's hash and the text), the row after the last being the first, so a single
row's next is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossio.llm.common import in_order, range_bounds, range_of

PERMUTATIONS = 128
SEED = 0x5EED
BLOCK = 2048
_RNG = np.random.default_rng(SEED)
#: Odd multipliers and XOR masks of the mixings, 32 bits each.
MULTIPLY = (_RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None]
MASK = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]
NONE = np.uint32(0xFFFFFFFF)


class Parse:
    """A Lempel-Ziv parse that can be carried on; ``fresh`` gathers the phrases that are new."""

    def __init__(self):
        self.phrases: set[bytes] = set()
        self.open = b""

    def feed(self, raw: bytes) -> list[bytes]:
        data, known, at = self.open + raw, self.phrases, 0
        add, fresh = known.add, []
        note = fresh.append
        for end in range(len(self.open) + 1, len(data) + 1):
            part = data[at:end]
            if part not in known:
                add(part)
                note(part)
                at = end
        self.open = data[at:]
        return fresh


def smallest(phrases: list[bytes]) -> np.ndarray:
    """The least mixed hash of the phrases, for each mixing."""
    least = np.full(PERMUTATIONS, NONE, np.uint32)
    of = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((of(p) & 0xFFFFFFFF for p in phrases), np.uint32, len(phrases))
    for k in range(0, len(hashes), BLOCK):
        mixed = (hashes[None, k : k + BLOCK] ^ MASK) * MULTIPLY
        mixed ^= mixed >> np.uint32(15)
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    return (least & np.uint32(0xFFFF)).astype("<u2")


def fingerprint(text: str | None) -> str:
    """The fingerprint as lowercase hexadecimal digits, 4 for each place; of the empty text, empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return signature(smallest(Parse().feed(raw))).tobytes().hex() if raw else ""


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of equal places of two fingerprints."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(bytes.fromhex(a), "<u2") == np.frombuffer(bytes.fromhex(b), "<u2")).mean())


def fingerprint_pair(text: str, ending: str) -> tuple[str, str, str]:
    """(edited text, fingerprint of the text, of the edited text): the edited text ends in ``ending`` instead of its last quarter."""
    kept = text[: len(text) - len(text) // 4]
    edited = kept + ending
    parse = Parse()
    head = parse.feed(kept.encode("utf-8", "surrogatepass"))
    base, rest = smallest(head), parse.open
    prints = []
    for tail in (text[len(kept) :], ending):
        parse.open = rest
        fresh = parse.feed(tail.encode("utf-8", "surrogatepass"))
        prints.append(np.minimum(base, smallest(fresh)))
        parse.phrases.difference_update(fresh)
    a, b = (signature(p).tobytes().hex() for p in prints)
    return edited, a if text else "", b if edited else ""


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; a row with ``_lent`` only serves as the next of the one before it."""
    prior: tuple | None = None
    out: list[tuple] = []

    def close(row: tuple, following: tuple) -> tuple:
        doc, text, first = row
        ending = following[1][: len(text) // 4]
        edited, a, b = fingerprint_pair(text, ending)
        return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a, b, likeness(a, b), first

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = OUT.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    waiting: tuple | None = None  # a finished row but for its likeness to the next
    for b in batches:
        for doc, text, lent in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("_lent").to_pylist(), strict=True):
            row = (doc, text or "", lent)
            if prior is not None:
                made = close(prior, row)
                if waiting is not None:
                    out.append((*waiting[:6], likeness(waiting[3], made[3])))
                waiting = made
            if lent:
                if waiting is not None:
                    out.append((*waiting[:6], likeness(waiting[3], fingerprint(text))))
                prior = waiting = None
                break
            prior = row
            if len(out) >= 512:
                yield batch(out)
                out = []
        else:
            continue
        break
    if prior is not None:
        raise ValueError("a range of documents lacks the document after it")
    if out:
        yield batch(out)


def fingerprints(docs: DataFrame, rows_per_range: int = 4096) -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    Ranges begin at values of doc_id that occur.  The first document of each range is also lent to the
    range before it (that of the first range to the last), so every row meets its next; texts move once.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = range_bounds(own, "doc_id", rows_per_range)
    n = len(bounds) + 1
    dealt = own.withColumn("_range", range_of(F.col("doc_id"), bounds)).withColumn("_hash", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("text").asc_nulls_first()]
    # the first of each range: the least (doc_id, hash) of the table, and of the rows at each bound
    low = dealt.select(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_hash")).alias("m")).first()["m"]
    if low is None:
        return own.sparkSession.createDataFrame([], OUT)
    lent_to = F.when(F.col("doc_id").eqNullSafe(F.lit(low["doc_id"])) & (F.col("_hash") == low["_hash"]), F.lit(n - 1))
    if bounds:
        at = own.sparkSession.createDataFrame([(b,) for b in bounds], "bound long")
        heads = dealt.join(F.broadcast(at), F.col("doc_id") == F.col("bound"), "left_semi").groupBy(F.col("doc_id").alias("head_id")).agg(F.min("_hash").alias("head_hash"))
        dealt = dealt.join(F.broadcast(heads), F.col("doc_id") == F.col("head_id"), "left")  # MAX_RANGES rows at most, as many as bounds
        lent_to = F.coalesce(lent_to, F.when(F.col("head_hash") == F.col("_hash"), F.col("_range") - 1))
    places = F.filter(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("lent")), F.struct(lent_to.cast("int").alias("r"), F.lit(True).alias("lent"))), lambda x: x["r"].isNotNull())
    both = dealt.select("doc_id", "text", "_hash", F.explode(places).alias("p")).select("doc_id", "text", "_hash", F.col("p.r").alias("_range"), F.col("p.lent").alias("_lent"))
    ranged = both.repartitionById(n, F.col("_range")).sortWithinPartitions("_lent", *order)
    return ranged.select("doc_id", "text", "_lent").mapInArrow(_walk, OUT)
