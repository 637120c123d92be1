"""Scores of op9 and op10 against plain Python on small models, and op10's folds."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from dossio.llm import quality, toxicity

DOCS = "doc_id long, text string"


def test_quality_scores_against_plain_python():
    rng = np.random.default_rng(5)
    texts = ["One two, three.", None, "a " * 200 + "END!", "x | y * z " * 40]
    m = quality.Model()
    bags = [quality.passages(t) for t in texts]
    m.fit(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1], np.array([1.0, 0, 1, 0]))
    for bag, got in zip(bags, m.scores(bags), strict=True):
        w, held, weights = m.weights, [], []
        for row in bag:
            x = [(float(v) - s) / d for v, s, d in zip(row, m.shift, m.scale, strict=True)]
            h = [math.tanh(sum(a * b for a, b in zip(x, w["W"][:, j], strict=True)) + w["b"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(a * b for a, b in zip(h, w["V"][:, j], strict=True))) / (1 + math.exp(-sum(a * b for a, b in zip(h, w["U"][:, j], strict=True)))) for j in range(quality.GATE)]
            held.append(h)
            weights.append(math.exp(sum(a * b for a, b in zip(gate, w["a"], strict=True))))
        z = [sum(wt * h[j] for wt, h in zip(weights, held, strict=True)) / sum(weights) for j in range(quality.HIDDEN)]
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["d"][0])))
        assert abs(want - got) < 1e-6
    assert rng is not None


def test_toxicity_scores_against_plain_python():
    chain = toxicity.Chain({b"scum": 0, b"moro~": 1, b"moron": 2}, 0.1)
    rng = np.random.default_rng(2)
    for k in range(3):
        m = toxicity.Linear()
        m.w, m.v, m.b = rng.normal(size=3), rng.normal(size=1 + k), -1.0
        chain.models.append(m)
    for text in ("you Scum, scum!", "morons all", "moron", "nothing here", None, ""):
        words = [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()]
        own = lambda w: {c for t, c in chain.terms.items() if t == w.encode() or (t.endswith(b"~") and len(w) > 4 and w.encode()[:4] == t[:-1])}
        cols, hits = set().union(*map(own, words)) if words else set(), sum(bool(own(w)) for w in words)
        extra = [math.log1p(hits)]
        for m in chain.models:
            z = sum(m.w[c] for c in cols) + sum(a * b for a, b in zip(extra, m.v, strict=True)) + m.b
            extra.append(1 / (1 + math.exp(-z)))
        assert np.allclose(chain.scores([text])[0], extra[1:], atol=1e-8)


def test_terms_of_a_fold_are_found_without_it(spark):
    """A word that only one fold's toxic documents have isn't tied to the label without that fold."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["river", "house", "blue"]) for _ in range(8)) + f" t{i}" + (" vile" if i % 2 else "") for i in range(400)]
    fold = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(toxicity.OUT_OF)).cast("int")
    d = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("fold", fold).withColumn("label", (F.col("doc_id") % 2).cast("double"))
    d = d.withColumn("text", F.when((F.col("fold") == 2) & (F.col("label") == 1), F.concat("text", F.lit(" uniquely"))).otherwise(F.col("text")))
    tied = dict(toxicity._tied_terms(d.select("fold", "label", "text")))
    assert all(tied[b"vile"])
    assert tied[b"uniquely"] == [True, True, False, True, True, True]
