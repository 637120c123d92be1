"""The pipeline's dedup against brute force: groups of near copies, some of them large, none lost and no unlike text dropped."""

import random

from dossio.llm import simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = (text or "").lower().split()
    n = min(k, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def test_near_copies_against_brute_force(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \t"]
    for size in (1, 1, 2, 3, 5, 40):
        base = [word() for _ in range(rnd.choice([60, 200, 400]))]
        texts.append(" ".join(base))
        for _ in range(size - 1):
            w = list(base)
            for _ in range(max(1, len(w) // 60)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(70)) + " " + passage for _ in range(30)]  # a passage that many share makes no copies
    texts += [texts[5], texts[5].upper().replace(" ", "\n")]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [(i, texts[k], "en", "a", 1) for i, k in enumerate(order)]
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (a == b or len(a & b) >= 0.8 * len(a | b)) and root(i) != root(j):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    want = {root(i) for i in range(len(rows))}
    left = simhash_dedup.deduplicate(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {r["doc_id"] for r in left.collect()} == want and left.count() == len(want)


def test_parts_follow_the_number_of_fingerprints():
    sizes = [simhash_dedup.parts_for(n, 3) for n in (10, 10**5, 10**7, 10**9, 10**11)]
    assert sizes == sorted(sizes) and sizes[0] == 4 and sizes[-1] > 8
