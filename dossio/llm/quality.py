"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of PASSAGE words.  Each passage is encoded from its characters and words
(character-class shares, repetition, word shapes); a hidden layer turns the code into a representation; a
gated attention (a tanh branch times a sigmoid branch) weighs the passages, learned from document labels
alone; a logistic unit scores the weighted representation.

The model is fitted on the driver from SAMPLE_ROWS labelled documents at most (those with the smallest
hash of their id), from every passage of each.  The passages are kept in a mapped temporary file there, and
a step takes its bags in runs of STEP_ROWS passages.  Scoring encodes every passage of every text.

Defined results: a null, empty or blank text is one passage without words and gets that bag's score; a
missing or null label is not learned from; of a document labelled twice the larger label counts; with
labels of one class only, or none, every score is the share of 1 among the labels (0.5 where there are
none); repeated rows get equal scores; an empty table gives no rows; other columns are ignored or passed on.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
SAMPLE_ROWS = 20_000
#: Passages in memory at once while fitting (a longer bag is taken alone), and bytes of bags sent at once.
STEP_ROWS = 1 << 15
BAGS_BYTES = 8 << 20
HELD_OUT = 1
FOLDS = 3
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.01, 1e-4
CUT = 0.5
CHUNK = 256

#: Character classes: the bytes of each, the rest being one more class.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"|", b"*#$%&@", b";:'\"()-_/", bytes(range(0x80, 0x100)), b" ")
LETTER, UPPER, HIGH, SPACE = 0, 1, 9, 10
KINDS = len(CLASSES) + 1
CLASS_OF = np.full(256, KINDS - 1, np.uint8)
for _k, _bytes in enumerate(CLASSES):
    CLASS_OF[np.frombuffer(_bytes, np.uint8)] = _k
WIDTH = KINDS + 8


def passages(text: str | None) -> np.ndarray:
    """A row of WIDTH numbers for each passage; at least one row."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    n = -(-len(words) // PASSAGE)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    of_word = np.arange(len(words)) // PASSAGE
    raw = np.frombuffer(b" ".join(words), np.uint8)
    kind = CLASS_OF[raw]
    ends = np.cumsum(lengths + 1) - 1  # one past each word
    starts = ends - lengths
    owner = np.repeat(of_word, lengths + 1)[: len(raw)]
    counts = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    chars = counts.sum(axis=1)
    size = np.bincount(of_word, minlength=n).astype(np.float64)
    total = np.bincount(of_word, lengths, n)
    squares = np.bincount(of_word, lengths.astype(np.float64) ** 2, n)
    last, first = kind[ends - 1], kind[starts]
    mid = kind[starts + lengths // 2]
    letter = lambda k: (k == LETTER) | (k == UPPER) | (k == HIGH)
    share = lambda flag: np.bincount(of_word, flag.astype(np.float64), n) / size
    mean = total / size
    distinct = np.array([len(set(words[k : k + PASSAGE])) for k in range(0, len(words), PASSAGE)]) / size
    again = np.zeros(len(words), bool)
    again[1:] = [a == b for a, b in zip(words, words[1:], strict=False)]
    more = [distinct, share(again), mean / 10, np.sqrt(np.maximum(0, squares / size - mean**2)) / 10, share(~letter(last)), share((first == UPPER) & (mid == UPPER)), share(~letter(mid)), np.log1p(size) / 5]
    return np.column_stack([counts / chars[:, None], *more]).astype(np.float32)


class Model:
    """Gated-attention network over bags; ``fit`` and ``scores`` take rows of passages and the bags' first rows."""

    def __init__(self, prior: float = 0.5, seed: int = 7):
        self.prior, self.weights = prior, None
        self.rng = np.random.default_rng(seed)

    def _forward(self, x: np.ndarray, first: np.ndarray):
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        sizes = np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), sizes)
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        att = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(h * att[:, None], first, axis=0)
        return h, t, g, att, bag, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, last: np.ndarray | None = None) -> Model:
        """Bag k is the rows first[k] to last[k] of x, which may be a mapped file: only a step's rows are in memory."""
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(np.unique(y)) < 2:
            return self
        parts = lambda: (x[k : k + STEP_ROWS].astype(np.float64) for k in range(0, len(x), STEP_ROWS))
        self.shift = sum(p.sum(axis=0) for p in parts()) / len(x)
        self.scale = np.sqrt(sum(((p - self.shift) ** 2).sum(axis=0) for p in parts()) / len(x)) + 1e-3
        r = lambda *s: self.rng.normal(0, 1 / np.sqrt(s[0]), s)
        w = self.weights = {"W": r(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": r(HIDDEN, GATE), "U": r(HIDDEN, GATE), "a": r(GATE), "c": r(HIDDEN), "d": np.zeros(1)}
        last = np.append(first[1:], len(x)) if last is None else last
        weigh = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5  # eases the imbalance of the classes
        m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        step, steps = 0, EPOCHS * -(-len(y) // BATCH)
        for _ in range(EPOCHS):
            order = self.rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                pick = order[k : k + BATCH]
                grads = {n: np.zeros_like(v) for n, v in w.items()}
                for some in self._runs(pick, last - first):
                    rows = np.concatenate([np.arange(first[i], last[i]) for i in some])
                    start = np.concatenate([[0], np.cumsum(last[some] - first[some])[:-1]])
                    part = self._gradients((x[rows].astype(np.float64) - self.shift) / self.scale, start, y[some], weigh[some])
                    for n, g in part.items():
                        grads[n] += g * (len(some) / len(pick))
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for n, g in grads.items():
                    m1[n] = 0.9 * m1[n] + 0.1 * g
                    m2[n] = 0.999 * m2[n] + 0.001 * g * g
                    w[n] = w[n] * (1 - rate * DECAY) - rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
        return self

    @staticmethod
    def _runs(pick: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """``pick`` in runs of bags with STEP_ROWS rows together at most, or of one bag."""
        runs, n = [[]], 0
        for i in pick:
            if runs[-1] and n + sizes[i] > STEP_ROWS:
                runs.append([])
                n = 0
            runs[-1].append(i)
            n += sizes[i]
        return [np.array(r) for r in runs]

    def _gradients(self, x, first, y, weigh) -> dict[str, np.ndarray]:
        w = self.weights
        h, t, g, att, bag, z, p = self._forward(x, first)
        dlogit = (p - y) * weigh / len(y)
        dz = dlogit[:, None] * w["c"]
        dh = att[:, None] * dz[bag]
        datt = (h * dz[bag]).sum(axis=1)
        de = att * (datt - np.add.reduceat(att * datt, first)[bag])
        dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
        dh += dt @ w["V"].T + dg @ w["U"].T
        dpre = dh * (1 - h * h)
        return {"W": x.T @ dpre, "b": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ dlogit, "d": np.array([dlogit.sum()])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        if self.weights is None:
            return np.full(len(bags), self.prior)
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        found = self._forward((np.concatenate(bags).astype(np.float64) - self.shift) / self.scale, first)[-1]
        return np.round(found, 9)  # the last digits of a product depend on what else is in the batch


def held_out(doc_id):
    """Rows whose labels are never learned from: crc32 of the id as text, modulo FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        labels, found, held = [], [], 0
        for label, t in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
            labels.append(label)
            found.append(passages(t.as_py()).tobytes())
            held += len(found[-1])
            if held > BAGS_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(found, pa.binary())], ["label", "bag"])
                labels, found, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(found, pa.binary())], ["label", "bag"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the model to ``docs`` (doc_id, text) and ``labels`` (doc_id, label) without the held-out rows."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # so many rows at most
    bags = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text").mapInArrow(_bags, "label double, bag binary")
    keys, at = [], 0
    with tempfile.TemporaryFile() as file:  # all passages of the sampled texts, whatever their length
        for row in bags.toLocalIterator():
            bag = bytes(row["bag"])
            file.write(bag)
            n = len(bag) // (4 * WIDTH)
            keys.append((row["label"], bag[:4096], hashlib.sha256(bag).digest(), at, at + n))
            at += n
        if not keys:
            return Model()
        keys.sort()  # the fit doesn't depend on the order of rows
        file.flush()
        y, first, last = (np.array([k[i] for k in keys]) for i in (0, 3, 4))
        return Model().fit(np.memmap(file, np.float32, "r", shape=(at, WIDTH)), first, y, last)


def _scored(batches: Iterator[pa.RecordBatch], model: Model):
    for b in batches:
        for k in range(0, b.num_rows, CHUNK):
            part = b.slice(k, CHUNK)
            yield part, model.scores([passages(t) for t in part.column("text").to_pylist()])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for part, s in _scored(batches, sent.value):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The documents with a score of ``cut`` or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, s in _scored(batches, sent.value):
            yield part.filter(pa.array(s >= cut, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
