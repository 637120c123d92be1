"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

Words are maximal runs of letters a-z (A-Z lower-cased), digits and code points from U+0080.  A window is
``size`` consecutive words of a benchmark item, or all words of an item that has fewer.  A worker turns
words into numbers by the benchmark's vocabulary, looks up a rolling hash of every window of known words,
and verifies each hit word by word; a hit therefore never rests on a hash.

The benchmark is cut into blocks of BLOCK_WORDS words, each indexed in flat arrays (about 10 MB) and broadcast on
its own.  A benchmark of any size makes as many blocks as it needs; the driver holds one at a time, a worker
HELD_BLOCKS, and with more than those, texts are scanned CHUNK_BYTES at a time so that blocks load seldom.
Broadcasts end with the last reference to them, as Spark's cleaner frees them then.

Defined results: a null or empty text has no words and is clean; an item without words has no window;
items that repeat an id count once; an item without an id hits words but isn't named; a document without
words is clean; an empty benchmark leaves all clean; other columns are ignored or passed on as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 13
#: A document is contaminated where RATIO times its hit words reach its words.
RATIO = 20
BLOCK_WORDS = 300_000
HELD_BLOCKS = 16
#: Texts scanned at once, in rows and bytes; beyond HELD_BLOCKS, in bytes alone.
CHUNK, CHUNK_BYTES = 256, 16 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Lower-cases A-Z and turns what isn't part of a word into a space; UTF-8 keeps other code points in bytes from 0x80.
FOLD = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Index:
    """The windows of a block of items, in flat arrays: for each length, sorted hashes, where a window stands in the items' words, and its items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        self.words = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for _, words in items for w in words], np.uint32)
        windows: dict[int, dict[bytes, tuple[int, set]]] = {}
        at = 0
        for number, (_, words) in enumerate(items):
            n = min(size, len(words))
            for k in range(at, at + len(words) - n + 1 if n else at):
                windows.setdefault(n, {}).setdefault(self.words[k : k + n].tobytes(), (k, set()))[1].add(number)
            at += len(words)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.by_length = {}
        for n, found in windows.items():
            starts = np.array([k for k, _ in found.values()], np.int64)
            keys = self.rolled([self.words[starts + j].astype(np.uint64) for j in range(n)])
            order = np.argsort(keys, kind="stable")
            owners = [sorted(s) for _, s in found.values()]
            held = [owners[i] for i in order]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            self.by_length[n] = (keys[order], starts[order], edges, np.array([i for x in held for i in x], np.int32))

    def rolled(self, columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * self.base
            h ^= h >> np.uint64(29)
        return h

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(first word, words, items) of every window that occurs in ``ids``; 0 is an unknown word."""
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (keys, starts, edges, owners) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(gaps[n:] == gaps[:-n])
            if not len(at):
                continue
            h = self.rolled([ids[at + j].astype(np.uint64) for j in range(n)])
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                for i in range(lo[k], hi[k]):
                    if np.array_equal(self.words[starts[i] : starts[i] + n], ids[at[k] : at[k] + n]):
                        yield int(at[k]), n, {self.names[o] for o in owners[edges[i] : edges[i + 1]]} - {None}


def index_blocks(benchmark: DataFrame, size: int = SIZE) -> list[Broadcast]:
    """Broadcast indexes of the benchmark (item_id, text); the driver holds the words of one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    blocks: list[Broadcast] = []
    held: list[tuple[str | None, list[bytes]]] = []
    count = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = words_of(row["text"])
        step = BLOCK_WORDS
        for k in range(0, max(1, len(words) - size + 1), step):  # parts of a long item overlap by a window less one word
            part = words[k : k + step + size - 1]
            held.append((row["item_id"], part))
            count += len(part)
            if count >= BLOCK_WORDS:
                blocks.append(sc.broadcast(Index(held, size)))
                held, count = [], 0
    if held:
        blocks.append(sc.broadcast(Index(held, size)))
    return blocks


def _found(texts: list[str | None], blocks: list[Broadcast]) -> list[tuple[int, np.ndarray, set]]:
    """Of each text: its number of words, which words are hit (None: none), and the items found."""
    split = [words_of(t) for t in texts]
    lengths = [len(w) for w in split]
    ends = np.cumsum([n + 1 for n in lengths])
    hit, items = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32), [set() for _ in texts]
    for b in blocks:
        index = b.value
        get = index.vocab.get
        ids: list[int] = []
        for w in split:
            ids += [get(x, 0) for x in w]
            ids.append(0)
        for at, n, names in index.hits(np.array(ids, dtype=np.uint32)):
            hit[at] += 1
            hit[at + n] -= 1
            items[int(np.searchsorted(ends, at, "right"))] |= names
        if len(blocks) > HELD_BLOCKS:
            b.__dict__.pop("_value", None)  # the next block takes its place
    inside = np.cumsum(hit) > 0
    return [(n, inside[e - n - 1 : e - 1], names) for n, e, names in zip(lengths, ends.tolist(), items, strict=True)]


def is_contaminated(n_words: int, n_hit: int, ratio: int = RATIO) -> bool:
    return n_hit > 0 and ratio * n_hit >= n_words


def _chunks(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast]):
    for batch in batches:
        k = 0
        while k < batch.num_rows:
            if len(blocks) <= HELD_BLOCKS:
                n = CHUNK
            else:  # as many rows as have CHUNK_BYTES together, one at least
                sizes = np.cumsum([v.as_buffer().size if v.is_valid else 0 for v in batch.column("text").slice(k)])
                n = max(1, int(np.searchsorted(sizes, CHUNK_BYTES, "right")))
            part = batch.slice(k, n)
            yield part, _found(part.column("text").to_pylist(), blocks)
            k += n


REPORT = "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, items_sha256 string, contaminated boolean"


def scan(docs: DataFrame, blocks: list[Broadcast], ratio: int = RATIO) -> DataFrame:
    """A row for each document: its words, hit words, and the benchmark items whose windows occur."""

    def report(batches):
        for part, found in _chunks(batches, blocks):
            names = [sorted(x) for _, _, x in found]
            hits = [int(h.sum()) for _, h, _ in found]
            words = [n for n, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([is_contaminated(n, h, ratio) for n, h in zip(words, hits, strict=True)], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(report, REPORT)


def drop_documents(docs: DataFrame, blocks: list[Broadcast], ratio: int = RATIO) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""

    def keep(batches):
        for part, found in _chunks(batches, blocks):
            yield part.filter(pa.array([not is_contaminated(n, int(h.sum()), ratio) for n, h, _ in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def remove_spans(docs: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """All documents; from each text, every run of hit words goes, from its first word's start to its last word's end."""

    def clean(text: str | None, hit: np.ndarray) -> str | None:
        if not hit.any():
            return text
        raw = text.encode("utf-8", "surrogatepass")
        spans = [m.span() for m in WORD.finditer(raw)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()
        out, at = [], 0
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            out.append(raw[at : spans[a][0]])
            at = spans[b - 1][1]
        return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

    def strip(batches):
        for part, found in _chunks(batches, blocks):
            i = part.schema.get_field_index("text")
            new = pa.array([clean(t, h) for t, (_, h, _) in zip(part.column(i).to_pylist(), found, strict=True)], part.schema.field(i).type)
            yield part.set_column(i, part.schema.field(i), new)

    return docs.mapInArrow(strip, docs.schema)
