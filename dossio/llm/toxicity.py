"""Toxicity by a classifier chain: linear models that each see the earlier categories' probabilities.

Terms are a document's lower-cased words and their beginnings of PREFIXES bytes (inflected words share
those).  Terms tied to the label are found over the labelled sample by the likelihood-ratio statistic,
held to a bound that grows with the number of candidates, so chance doesn't add terms; all that pass are
kept.  The chain's categories, in order:

    abusive    the document is labelled toxic and one of its terms is tied to toxicity
    repeated   ... and REPEATED or more of its words are
    toxic      the label itself

The table has one label; the first two categories are its refinements by what was learned.  Each
category's logistic regression takes the terms and the earlier categories' probabilities.  While fitting,
those are out of fold: a fold's come from models of the other folds, whose terms and categories, too, were
found without it.  Folds are by text, so copies stay together.  Afterwards the models of all rows count.  The
ridge is the one of RIDGES with the least loss of the label out of fold; rows held out never count.

Fitting uses SAMPLE_ROWS labelled documents at most (smallest hash of the id), never the held-out ones.
Scoring reads every word of every text.

Defined results: a null, empty or wordless text has no terms and gets the intercepts' probabilities; null
labels aren't learned from; of a document labelled twice the larger label counts; with labels of one class
only, or none, all probabilities are the share of 1 (0 where there are none); repeated rows get equal
scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossio.llm.common import cut
from dossio.llm.decontaminate import FOLD
from dossio.llm.quality import held_out

PREFIXES = (4, 5, 6, 7)
SAMPLE_ROWS = 20_000
LEAST_DOCS = 4
REPEATED = 3
CATEGORIES = ("abusive", "repeated", "toxic")
OUT_OF = 5
ROUNDS = 400
RIDGES = (1e-4, 1e-5, 1e-6)
CUT = 0.5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings, marked, where it goes on."""
    return [word, *(word[:n] + b"~" for n in PREFIXES if len(word) > n)]


class Linear:
    """Logistic regression on sparse rows (row, column, 1) and dense extra columns."""

    def fit(self, rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, ridge: float) -> Linear:
        n = max(1, len(y))
        self.w, self.v = np.zeros(width), np.zeros(extra.shape[1])
        self.b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        m, s = np.zeros(width + extra.shape[1] + 1), np.zeros(width + extra.shape[1] + 1)
        for t in range(1, ROUNDS + 1):
            r = self.proba(rows, cols, extra, len(y)) - y
            g = np.concatenate([np.bincount(cols, r[rows], width) / n + ridge * self.w, extra.T @ r / n + ridge * self.v, [r.mean() if len(r) else 0.0]])
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            step = 0.1 * (1 - t / (ROUNDS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
            self.w -= step[:width]
            self.v -= step[width:-1]
            self.b -= step[-1]
        return self

    def proba(self, rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(rows, self.w[cols], n) + extra @ self.v + self.b if len(rows) else extra @ self.v + np.full(n, self.b)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """A classifier chain over CATEGORIES; ``terms`` maps a term to its column."""

    def __init__(self, terms: dict[bytes, int], prior: float):
        self.terms, self.prior, self.models, self.ridge = terms, prior, [], RIDGES[0]

    def columns(self, text: str | None) -> tuple[set[int], int]:
        """The columns of the text's terms, and how many of its words have any."""
        get, found, hits = self.terms.get, set(), 0
        for w, n in Counter(words_of(text)).items():
            own = [c for t in terms_of(w) if (c := get(t)) is not None]
            if own:
                found.update(own)
                hits += n
        return found, hits

    @staticmethod
    def _sparse(sets: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([c for s in sets for c in sorted(s)], np.int64)

    @staticmethod
    def _aims(y: np.ndarray, hits: np.ndarray) -> dict[str, np.ndarray]:
        return {"abusive": ((y == 1) & (hits > 0)).astype(float), "repeated": ((y == 1) & (hits >= REPEATED)).astype(float), "toxic": (y == 1).astype(float)}

    @staticmethod
    def _unseen(sets: list[list[set[int]]], hits: np.ndarray, y: np.ndarray, fold: np.ndarray, width: int, ridge: float) -> np.ndarray:
        """A row for each document, a column for each category: the probabilities by models that haven't seen the document's fold.

        ``sets[k]`` and ``hits[:, k]`` are by the terms found without fold k.
        """
        found = np.zeros((len(y), 0))
        for c in CATEGORIES:
            column = np.zeros(len(y))
            for k in range(OUT_OF):
                there = fold == k
                if not there.any():
                    continue
                rows, cols = Chain._sparse(sets[k])
                extra = np.column_stack([np.log1p(hits[:, k]), found])
                use, new = ~there[rows], np.cumsum(~there) - 1
                part = Linear().fit(new[rows[use]], cols[use], extra[~there], Chain._aims(y, hits[:, k])[c][~there], width, ridge)
                column[there] = part.proba(rows, cols, extra, len(y))[there]
            found = np.column_stack([found, column])
        return found

    def fit(self, sets: list[list[set[int]]], hits: np.ndarray, y: np.ndarray, fold: np.ndarray, width: int) -> Chain:
        """``sets[k]`` and ``hits[:, k]`` for k below OUT_OF are by the terms found without fold k, the last by those of all rows."""

        def loss(p: np.ndarray) -> float:
            p = np.clip(p[:, -1], 1e-9, 1 - 1e-9)
            return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

        tried = [(self._unseen(sets, hits, y, fold, width, r), r) for r in RIDGES]
        unseen, self.ridge = min(tried, key=lambda x: loss(x[0]))
        rows, cols = self._sparse(sets[OUT_OF])
        extra, aims = np.log1p(hits[:, OUT_OF])[:, None].astype(float), self._aims(y, hits[:, OUT_OF])
        for k, c in enumerate(CATEGORIES):
            self.models.append(Linear().fit(rows, cols, extra, aims[c], len(self.terms), self.ridge))
            extra = np.column_stack([extra, unseen[:, k]])
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, a column for each category."""
        if not self.models:
            return np.full((len(texts), len(CATEGORIES)), self.prior)
        found = [self.columns(t) for t in texts]
        rows, cols = self._sparse([s for s, _ in found])
        extra = np.log1p(np.array([h for _, h in found], float))[:, None]
        for m in self.models:
            extra = np.column_stack([extra, m.proba(rows, cols, extra, len(texts))])
        return np.round(extra[:, 1:], 9)  # the last digits of a product depend on what else is in the batch


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, fold, documents, toxic documents) of each batch."""
    for b in batches:
        n, toxic = Counter(), Counter()
        for fold, label, text in zip(b.column("fold").to_pylist(), b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
            own = {(t, fold) for w in set(words_of(text)) for t in terms_of(w)}
            n.update(own)
            if label:
                toxic.update(own)
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.binary()), pa.array([f for _, f in keys], pa.int32()), pa.array([n[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["term", "fold", "n", "n_toxic"])


def _tied_terms(sample: DataFrame) -> list[tuple[bytes, list[bool]]]:
    """Terms with more toxic documents than chance gives, and for each fold whether they pass without it, at last whether they pass over all rows.

    Equal texts count once.  The strongest over all rows come first.
    """
    sample = sample.dropDuplicates(["text", "label"])
    per = {r["fold"]: (r["n"], r["k"]) for r in sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect()}  # a row a fold
    rows, toxic = sum(n for n, _ in per.values()), sum(k for _, k in per.values())
    parts = [*range(OUT_OF), None]
    counted = sample.mapInArrow(_term_counts, "term binary, fold int, n long, n_toxic long")
    left = lambda c, f: F.sum(F.col(c) if f is None else F.when(F.col("fold") != f, F.col(c)).otherwise(0))
    sums = [left(c, f).alias(f"{c}_{i}") for i, f in enumerate(parts) for c in ("n", "n_toxic")]
    counts = cut(counted.groupBy("term").agg(*sums).where(F.col(f"n_{OUT_OF}") >= LEAST_DOCS))
    candidates = counts.agg(*[F.count_if(F.col(f"n_{i}") >= LEAST_DOCS).alias(f"c{i}") for i in range(len(parts))]).first()
    part = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)

    def passes(i: int, f: int | None):
        all_n, all_k = (rows, toxic) if f is None else (rows - per.get(f, (0, 0))[0], toxic - per.get(f, (0, 0))[1])
        if not all_k or all_k == all_n:
            return F.lit(False), F.lit(0.0)
        q, n, k = all_k / all_n, F.col(f"n_{i}"), F.col(f"n_toxic_{i}")
        rest_n, rest_k = F.lit(all_n) - n, F.lit(all_k) - k
        ratio = 2 * (part(k, n * q) + part(n - k, n * (1 - q)) + part(rest_k, rest_n * q) + part(rest_n - rest_k, rest_n * (1 - q)))
        return (n >= LEAST_DOCS) & (k / n > q) & (ratio >= 2 * math.log(max(2, candidates[f"c{i}"])) + 4), ratio

    found = [passes(i, f) for i, f in enumerate(parts)]
    tied = counts.select("term", F.array(*[F.coalesce(p, F.lit(False)) for p, _ in found]).alias("passes"), found[-1][1].alias("g")).where(F.exists("passes", lambda p: p))
    return [(bytes(r["term"]), list(r["passes"])) for r in tied.orderBy(F.desc("g"), "term").collect()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Chain:
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # so many rows at most
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(OUT_OF)).cast("int").alias("fold"), "label", "text"))
    rows, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    chain = Chain({}, float(toxic or 0) / rows if rows else 0.0)
    if not rows or not toxic or toxic == rows:
        return chain
    tied = _tied_terms(sample)
    tied.sort(key=lambda x: not x[1][OUT_OF])  # the chain's own terms take the first columns
    chain.terms = {t: k for k, (t, p) in enumerate(tied) if p[OUT_OF]}
    of_part = [Chain({t: k for k, (t, p) in enumerate(tied) if p[i]}, 0.0) for i in range(OUT_OF + 1)]
    sent = docs.sparkSession.sparkContext.broadcast(of_part)  # as many terms as the sample has at most

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[part.columns(t) for part in sent.value] for t in b.column("text").to_pylist()]
            cols = pa.array([[sorted(s) for s, _ in f] for f in found], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("label"), cols, pa.array([[h for _, h in f] for f in found], pa.list_(pa.int64()))], ["fold", "label", "cols", "hits"])

    got = sorted(((r["fold"], r["label"], r["cols"], r["hits"]) for r in sample.mapInArrow(bags, "fold int, label double, cols array<array<int>>, hits array<long>").toLocalIterator()))
    fold, y, hits = (np.array([r[i] for r in got]) for i in (0, 1, 3))
    return chain.fit([[set(r[2][k]) for r in got] for k in range(OUT_OF + 1)], hits, y, fold, len(tied))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """A row for each document: doc_id, held_out, a probability for each category, score (that of toxic), predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = sent.value.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.float64()) for c in p.T)], ["doc_id", *CATEGORIES])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))
    flag = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return made.select("doc_id", flag, *CATEGORIES[:-1], F.col("toxic").alias("score"), (F.col("toxic") >= CUT).cast("int").alias("predicted"))
