"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

Each range of documents becomes one shard, ``shard-NNNNNN.bin`` (ids, little-endian, uint16 where the
vocabulary fits, else uint32) and ``shard-NNNNNN.idx``:

    8 bytes  magic ``DSSOTOK1``
    int64    bytes an id, int64 number of documents n
    int64    n + 1 offsets into the shard, in ids
    int64    n document ids (0 where null), uint8 n flags (1: the document id is null)

A shard's place in the whole corpus, its base, is the prefix sum of the shards' totals; the bases are in
``manifest.json``.  Both files can be memory-mapped.

Defined results: a null or empty text is one end id; rows are ordered by document id, nulls first, then
by the text's hash and the text, so repeated rows each get their place; an empty table has no shards and
reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossio.llm.common import in_order, scratch_uri

MAGIC = b"DSSOTOK1"
END_ID = 2
#: Entries of each of a worker's two word caches; a full cache is emptied.
CACHE_ENTRIES = 600_000
STATS = "shard int, n_docs long, n_tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _char_class(start: str, below: int = 0x2000) -> str:
    """Regular-expression class of the assigned code points under ``below`` of a general category."""
    return "".join(f"\\u{c:04x}" for c in range(below) if unicodedata.category(chr(c)).startswith(start))


def _known(below: int = 0x2000) -> str:
    return "".join(f"\\u{c:04x}" for c in range(below) if unicodedata.category(chr(c)) not in ("Cn", "Cs") and chr(c) not in "\x1c\x1d\x1e\x1f")


class Visible(dict):
    """How a byte-level vocabulary spells a character: each of its UTF-8 bytes by a visible one.

    Printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on, in order.
    """

    def __init__(self):
        shown = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or c >= 0xAE]
        self.of_byte = {c: chr(c) for c in shown} | {c: chr(0x100 + k) for k, c in enumerate(sorted({*range(256)}.difference(shown)))}

    def __missing__(self, char: str) -> str:
        self[char] = found = "".join(self.of_byte[b] for b in char.encode())
        return found


class WordEncoder:
    """Encodes through the tokenizers library, a word at a time, keeping the words seen.

    A byte-level BPE never joins across the words its pre-tokenizer makes, so a text's ids are those of
    its words.  Texts with code points whose class isn't settled here go to the library whole.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and spec["model"]["type"] == "BPE"
        letter, number, space = _char_class("L"), _char_class("N"), "\\t-\\r \\x85\\xa0\\u1680"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.odd = re.compile(f"[^{_known()}]").search
        self.loose = re.compile(f" (?:[{space}]|$)").search
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tok.model
        self.visible = Visible()
        self.space = self.visible[" "]
        self.by_word: dict[str, bytes] = {}
        self.by_piece: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        """The ids of one word that the pre-tokenizer leaves whole, by the library's BPE model."""
        shown = word.replace(" ", self.space) if word.isascii() and word.isprintable() else "".join(map(self.visible.__getitem__, word))
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece between two spaces, with the space before it."""
        if piece.isalpha():
            return self._ids(" " + piece)
        return b"".join(map(self._word, self.words(" " + piece)))

    def _word(self, word: str) -> bytes:
        found = self.by_word.get(word)
        if found is None:
            if len(self.by_word) >= CACHE_ENTRIES:
                self.by_word.clear()
            found = self.by_word[word] = self._ids(word)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as raw bytes."""
        split: list = [None] * len(texts)
        seen: set[str] = set()
        for k, t in enumerate(texts):
            if t and self.plain and not self.odd(t) and not self.loose(t):
                split[k] = t.split(" ")
                seen.update(split[k])
        if len(self.by_piece) + len(seen) > CACHE_ENTRIES:
            self.by_piece.clear()
        for p in seen.difference(self.by_piece):
            self.by_piece[p] = self._piece(p)
        get, out = self.by_piece.get, []
        for t, ps in zip(texts, split, strict=True):
            if ps is not None:
                out.append(b"".join([*map(self._word, self.words(ps[0])), *map(get, ps[1:])]))
            elif not t:
                out.append(b"")
            elif not self.plain or self.odd(t):
                out.append(array(self.code, self.tok.encode(t, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(self._word, self.words(t))))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _settle(fs: pafs.FileSystem, made: str, name: str) -> None:
    """Puts a finished file in its place; a second attempt at a task writes the same bytes."""
    try:
        fs.move(made, name)
    except OSError:
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(made)


def _write_shard(batches: Iterator[pa.RecordBatch], root: str, tokenizer: str, end_id: int, chunk: int = 512) -> Iterator[pa.RecordBatch]:
    enc = _encoder(tokenizer)
    fs, base = _place(root)
    end = np.array([end_id], dtype=enc.dtype).tobytes()
    shard = None
    lengths: list[int] = []
    ids: list[int | None] = []
    temp = f"{base}/.{uuid.uuid4().hex}"
    out = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            shard = batch.column("_range")[0].as_py()
            fs.create_dir(base, recursive=True)
            out = fs.open_output_stream(temp + ".bin")
        ids += batch.column("doc_id").to_pylist()
        texts = batch.column("text")
        for k in range(0, batch.num_rows, chunk):
            for raw in enc.encode(texts.slice(k, chunk).to_pylist()):
                out.write(raw)
                out.write(end)
                lengths.append(len(raw) // enc.dtype.itemsize + 1)
    if out is None:
        return
    out.close()
    with fs.open_output_stream(temp + ".idx") as f:
        f.write(MAGIC)
        f.write(np.array([enc.dtype.itemsize, len(lengths)], dtype="<i8").tobytes())
        f.write(np.concatenate([[0], np.cumsum(lengths, dtype="<i8")]).astype("<i8").tobytes())
        f.write(np.array([0 if i is None else i for i in ids], dtype="<i8").tobytes())
        f.write(np.array([i is None for i in ids], dtype="u1").tobytes())
    for kind in (".bin", ".idx"):
        _settle(fs, temp + kind, f"{base}/shard-{shard:06d}{kind}")
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["shard", "n_docs", "n_tokens"])


def write_token_files(spark: SparkSession, docs: DataFrame, root: str, tokenizer: str, end_id: int = END_ID) -> list[dict]:
    """Writes the shards under ``root`` in ascending document order and returns the manifest's rows."""
    ranged, _ = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", [F.xxhash64("text"), "text"])
    made = ranged.mapInArrow(lambda it: _write_shard(it, root, tokenizer, end_id), STATS).collect()  # a row for each shard
    rows, base, first = [], 0, 0
    for r in sorted(made, key=lambda r: r["shard"]):
        rows.append({"shard": r["shard"], "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "base": base, "first_doc": first})
        base, first = base + r["n_tokens"], first + r["n_docs"]
    fs, at = _place(root)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps({"end_id": end_id, "shards": rows}).encode())
    return rows


def open_shard(root: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids, null flags); the ids are memory-mapped where the store is a local path."""
    fs, base = _place(root)
    name = f"{base}/shard-{shard:06d}"
    with fs.open_input_file(name + ".idx") as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{name}.idx is no index of token ids")
    size, n = np.frombuffer(raw, "<i8", 2, 8).tolist()
    offsets = np.frombuffer(raw, "<i8", n + 1, 24)
    doc_ids = np.frombuffer(raw, "<i8", n, 24 + 8 * (n + 1))
    nulls = np.frombuffer(raw, "u1", n, 24 + 8 * (2 * n + 1))
    dtype = np.dtype(f"<u{size}")
    if isinstance(fs, pafs.LocalFileSystem):
        ids = np.memmap(name + ".bin", dtype=dtype, mode="r") if offsets[-1] else np.empty(0, dtype)
    else:
        with fs.open_input_file(name + ".bin") as f:
            ids = np.frombuffer(f.read_buffer(), dtype)
    return ids, offsets, doc_ids, nulls


def _read_shards(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
            ids, offsets, doc_ids, nulls = open_shard(root, shard)
            crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)), pa.array(offsets[:-1] + base, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, root: str, manifest: list[dict]) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.createDataFrame([(k, r["shard"], r["base"]) for k, r in enumerate(manifest)], "k int, shard int, base long")
    return shards.repartitionById(max(1, len(manifest)), F.col("k")).mapInArrow(lambda it: _read_shards(it, root), DOCS)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, root: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` as token files (in the shared folder, unless ``root`` says where) and reads them back."""
    root = root or scratch_uri(spark, "tokens")
    return read_token_files(spark, root, write_token_files(spark, docs, root, tokenizer, end_id))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


assert sys.byteorder == "little"
