"""Models of every order from 2 on, against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortry.llm import ngram

R = np.random.default_rng(3)
TEXTS = [" ".join(R.choice(list("abcdefgh"), int(n))) for n in R.integers(0, 40, 60)] + ["a b c d e f g h"] * 3


def brute(texts, order):
    """Log10 probability of the tokens after a history, and the words."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        x = ["<b>"] * (order - 1) + t.split() + [None]
        for i in range(order - 1, len(x)):
            grams[order][tuple(x[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = [[0, *ngram.discounts([sum(c == n for c in g.values()) for n in (1, 2, 3, 4)])] for g in grams]
    follow = [defaultdict(list) for _ in grams]
    for k in range(1, order + 1):
        for g, c in grams[k].items():
            follow[k][g[:-1]].append(c)

    def p(h, w):
        k = len(h) + 1
        lower = p(h[1:], w) if h else 1 / (len(grams[1]) + 1)
        own = follow[k].get(h)
        if not own:
            return lower
        c = grams[k][(*h, w)]
        return (c - d[k][min(c, 3)] + sum(d[k][min(x, 3)] for x in own) * lower) / sum(own)

    return p, [g[0] for g in grams[1]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_order(spark, order):
    p, vocabulary = brute(TEXTS, order)
    h = ("a", "b", "c")[: order - 1]
    assert sum(p(h, w) for w in vocabulary) + p(h, "new") == pytest.approx(1)
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "a b new c d e", "c d e f", None]], "text string")
    model = ngram.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"), order=order)
    for r in ngram.score(df, model).collect():
        x = ["<b>"] * (order - 1) + (r.text or "").split() + [None]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(x[i - order + 1 : i]), x[i])) for i in range(order - 1, len(x))))


def test_longer_contexts_count(spark):
    df = spark.createDataFrame([("x a y",), ("z a w",)] * 20, "text string")
    two, three = ({r.text: r.score for r in ngram.score(df, ngram.train(df, order=k)).collect()} for k in (2, 3))
    assert all(three[t] > two[t] + 0.1 for t in two)


def test_order_is_at_least_two(spark):
    with pytest.raises(ValueError):
        ngram.train(spark.createDataFrame([("a",)], "text string"), order=1)
