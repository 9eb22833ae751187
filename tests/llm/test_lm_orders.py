"""The backoff automaton's n-grams of all words against a plain version."""

import math
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from lexmill.llm import lm_score


def backoff(rows, order, discount=0.5, min_count=4):
    """Model score by row position: nested dictionaries, one n-gram after the other."""
    grams = [Counter() for _ in range(order + 1)]
    marked = [["<s>", *brute.words(t), None] for _, t, _ in rows]
    for (_, _, train), x in zip(rows, marked, strict=True):
        for i in range(1, len(x)) if train else ():
            for k in range(1, min(order, i + 1) + 1):
                grams[k][tuple(x[i - k + 1 : i + 1])] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    docs = grams[1][None,]
    arcs, alpha = {}, {}

    def log(h, w):
        if not h:
            return math.log10((grams[1][w,] + 1) / (n + v + 1))
        return arcs[*h, w] if (*h, w) in arcs else alpha.get(h, 0.0) + log(h[1:], w)

    for k in range(2, order + 1):
        new, mass = {}, {}
        for g, c in grams[k].items():
            h = docs if g[:-1] == ("<s>",) else grams[k - 1][g[:-1]]
            p = math.log10((c - discount) / h) if c >= min_count else 0.0
            low = log(g[1:-1], g[-1])
            if c >= min_count and c * (p - low) >= 1:
                new[g] = p
                a = mass.setdefault(g[:-1], [0.0, 0.0])
                a[0] += 10**p
                a[1] += 10**low
        arcs |= new
        alpha |= {h: math.log10((1 - a) / (1 - b)) for h, (a, b) in mass.items()}
    score = [sum(log(tuple(x[max(0, i - order + 1) : i]), x[i]) for i in range(1, len(x))) for x in marked]
    return score, arcs


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_all_words_and_orders_match_a_plain_model(spark, order):
    r = random.Random(5)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(300)]
    phrases = [[r.choice(rare) for _ in range(5)] for _ in range(40)]  # rare words that always follow one another
    text = lambda: " ".join(w for _ in range(12) for w in (r.choice(phrases) if r.random() < 0.5 else r.choices(common + rare, k=4)))
    rows = [(i, text(), i % 7 != 2) for i in range(400)] + [(400, "", True), (401, None, True), (402, "r1 r2 unseen", False)]
    plain, arcs = backoff(rows, order)
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(5)
    out = lm_score.score_texts(df, F.col("train"), order=order).collect()
    assert sorted(x["doc_id"] for x in out) == list(range(len(rows)))
    for x in out:
        assert x["score"] == pytest.approx(plain[x["doc_id"]], rel=1e-5)
    if order > 1:  # arcs between words far below a ten-thousandth of a real corpus, and of every order
        assert any(g[0] in rare and g[-1] in rare for g in arcs) and {len(g) for g in arcs} == set(range(2, order + 1))


def test_default_counts_words_below_any_share(spark):
    rows = [(i, "rare pair " + " ".join(f"w{i}x{j}" for j in range(3000))) for i in range(8)]
    out = lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.lit(True)).collect()
    plain, arcs = backoff([(*x, True) for x in rows], 3)
    assert ("rare", "pair") in arcs and ("<s>", "rare") in arcs
    assert sorted(x["score"] for x in out) == pytest.approx(sorted(plain), rel=1e-6)
