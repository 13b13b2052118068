"""Selection, search and text operators against numpy and plain Python."""

import html
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import scalars as S
from cohortry.operators import frames as R
from cohortry.operators import models as M
from cohortry.operators import search as V
from cohortry.operators import selection as L
from cohortry.operators import text as T
from cohortry.operators import topics as P

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def rows(spark):
    x = RNG.normal(size=(400, 4))
    y = (x[:, 0] * 2 + x[:, 1] + RNG.normal(size=400) > 0).astype(int)
    data = [(i, *map(float, v), int(c), i % 4) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, t_a double, t_b double, u_c double, u_d double, y int, fold int").cache(), x, y


def test_intercept_alone(rows):
    df, _, y = rows
    p = y.mean()
    ll = len(y) * (p * math.log(p) + (1 - p) * math.log(1 - p))
    assert L.fitted(df, [], "y", "binomial")["aic"] == pytest.approx(-2 * ll + 2)
    g = L.fitted(df, ["t_a"], "y", "gaussian")
    x = np.column_stack((np.ones(400), np.array(df.select("t_a").toPandas())[:, 0]))
    r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert g["r2"] == pytest.approx(1 - (r @ r) / ((y - p) @ (y - p)), abs=1e-6)


def test_stepwise_by_p(rows):
    df, _, _ = rows
    cols = ["u_c", "t_b", "u_d", "t_a"]
    forward = L.stepwise_by_p(df, cols, "y")
    assert forward[0][0] == [] and forward[1][0] == ["t_a"] and set(forward[2][0]) == {"t_a", "t_b"}
    assert all(b[1]["aic"] < a[1]["aic"] for a, b in zip(forward, forward[1:]))
    backward = L.stepwise_by_p(df, cols, "y", backward=True, guard=None)
    assert {"t_a", "t_b"} <= set(backward[-1][0]) and all(p <= 0.05 for p in backward[-1][1]["p"].values())


def test_backward_logistic(rows):
    df, _, _ = rows
    got = L.backward_logistic(df, ["t_a", "t_b", "u_c", "u_d"], "y", "fold")
    assert {"t_a", "t_b"} <= set(got[-1]["columns"]) and all(b["aic"] < a["aic"] for a, b in zip(got, got[1:]))
    assert all(0.7 < r["auc_mean"] <= 1 and r["auc_sd"] >= 0 and sum(r["families"].values()) == len(r["columns"]) for r in got)


def test_grid_and_mixtures(rows):
    df, _, _ = rows
    got = L.grid_auc(df, ["t_a", "u_c"], "y", "fold", "tree", {"maxDepth": [1, 4]}, k=2)
    assert len(got) == 2 and got[0]["auc_mean"] >= got[1]["auc_mean"]
    grid = L.mixture_grid(df, ["t_a"], ["y"], [2, 3], iterations=6)
    assert [r["k"] for r in grid] == sorted((2, 3), key=lambda k: next(r["aic"] for r in grid if r["k"] == k))
    table, nested = L.nested_mixture(df, "id", [(grid[0]["model"], ["t_a"], ["y"], "m")], ["y"], [2], iterations=4)
    own = [c for c in table.columns if re.fullmatch(r"c\d+_m", c)]
    assert len(own) == grid[0]["k"] - 1 and table.count() == 400 and nested[0]["k"] == 2


def test_class_weights_and_cutoff(rows):
    df, _, y = rows
    w = L.class_weights(df, "y")
    assert w[1] * y.sum() == pytest.approx(w[0] * (len(y) - y.sum()))
    taken, share = L.captured_share([(0.4, 0.05), (0.2, 0.05), (0.01, 0.9)])
    base = 0.4 * 0.05 + 0.2 * 0.05 + 0.009
    assert taken == 2 and share == pytest.approx(0.03 / base)


def test_knee_and_families():
    assert L.smoothed_knee([10, 4, 2, 1.5, 1.2, 1, 0.9, 0.8], 1) in (1, 2)
    ranked = [(f"a_{i}", 1 / (i + 1)) for i in range(20)] + [(f"b_{i}", 0.001) for i in range(4)]
    got = L.pick_by_family(ranked, lambda c: c[0], least=3, width=1)
    assert [c for c in got if c[0] == "b"] == ["b_0", "b_1", "b_2"] and got[0] == "a_0"


def test_singular_scores(rows):
    df, x, _ = rows
    scores, values = L.singular_scores(df, "id", ["t_a", "t_b", "u_c"], 2)
    z = x[:, :3] / np.abs(x[:, :3]).max(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert values == pytest.approx(s[:2])
    got = np.array([r.scores for r in scores.orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(z @ vt[:2].T))


def test_search(spark):
    v = RNG.normal(size=(30, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"w{i}", x.tolist()) for i, x in enumerate(v)], "word string, vector array<double>")
    q = v[0] + v[1] - v[2]
    s = v @ (q / np.linalg.norm(q))
    want = [f"w{i}" for i in np.argsort(-s) if i > 2][:5]
    assert [r.word for r in V.similar_words(df, ["w0", "w1"], ["w2"], 5).collect()] == want
    with pytest.raises(KeyError):
        V.similar_words(df, ["none"])
    assert V.by_text(df, "word", "vector", "x", lambda t: v[4], 1).first().word == "w4"
    texts = spark.createDataFrame([("a b c d e",), (None,)], "t string")
    enc = V.windows_encoder(lambda cuts: np.array([[len(c), 1.0] for c in cuts]), 3, 1)
    assert [r.vector for r in V.embedded(texts, "t", enc).collect()] == [[6.0, 2.0], [0.0, 1.0]]


def test_model_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0])], "topic int, vector array<double>")
    V.save_model({"topics": df}, str(tmp_path))
    assert V.load_model(spark, ["topics"], str(tmp_path))["topics"].collect() == df.collect()


def test_silhouette_and_counts(spark):
    centre = np.eye(6)
    x = np.concatenate([centre[i] + RNG.normal(scale=0.15, size=(30, 6)) for i in range(4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "d long, v array<double>")
    t = np.concatenate((centre[:4], -centre[5:]))
    s = (x @ t.T + 1) / 2
    best = s.argmax(axis=1)
    want = []
    for k in range(len(t)):
        own = best == k
        if not own.any():
            want.append(0.5)
            continue
        a, b = 1 - s[own, k].mean(), 1 - np.delete(s[own], k, axis=1).mean()
        want.append(((b - a) / max(a, b) + 1) / 2)
    score, size = P.silhouette(docs, "d", "v", t)
    assert score == pytest.approx(np.mean(want)) and size == np.bincount(best, minlength=5).tolist()
    best_k, seen = P.best_topic_count(docs, "d", "v", t, size)
    assert best_k == max(seen, key=lambda k: (seen[k], -k)) and set(seen) == {2, 3, 4, 5} and best_k == 4


def test_metrics_count_positive_scores(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 1.0), (1, 0, -0.2, 0.5), (1, 0, 0.3, 0.25)], "p int, topic int, s double, w double")
    r = P.patient_topics(df, "p", "s", "w", 1).first()
    assert (r.dit, r.twdit, r.ps) == (2.0, 1.25, pytest.approx(0.6)) and r.twdit50 == pytest.approx(1.625)


def test_entities(spark):
    texts = ["a &amp;lt; b", "&#8217;s &hellip; &euml;&#x41;", None, "plain & simple", "&amp;amp;amp;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.t for r in df.select("i", S.html_unescape(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == [None if t is None else html.unescape(html.unescape(t)) for t in texts]


@pytest.mark.parametrize(("substitute", "ignore"), [((), ()), (("number", "punctuation"), ()), (("contraction", "hyphenation", "meta_token"), ("punctuation",)), (("number",), ("hyphenation", "contraction"))])
def test_additive_tokens(spark, substitute, ignore):
    texts = ["It`s a well-known <NAME-12> value: 3,5 or 12. e.g. done!", "don’t stop; 1.2.3 <DATE> x-y-z", "", None, "a <b-1>2 c>d 4"]
    want = []
    for t in texts:
        t, kinds = re.sub("[’`]", "'", t or ""), []
        for name, token, old, new in T.CLASSES:
            if name in substitute:
                t = re.sub((f"(?:{old})" if "|" not in old else old) + T.SPARE_META, re.sub(r"\$(\d)", r"\\\1", new), t)
            elif name not in ignore:
                kinds.append(token)
        want.append(re.findall("|".join([*kinds, T.WORD]), t))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.k for r in df.select("i", T.additive_tokens(F.col("t"), substitute, ignore).alias("k")).orderBy("i").collect()] == want


def test_dutch_modifiers(spark):
    df = spark.createDataFrame([("geen koorts hoest".split(),), ("hoest neg".split(),), ("goede conditie".split(),), ("conditie geen goed".split(),)], "tok array<string>")
    assert [" ".join(r.tok) for r in T.bind_dutch_modifiers(df, "tok").collect()] == ["koorts_NEG hoest", "hoest_NEG", "conditie_POS", "conditie_NEG"]


def test_sentence_vectors(spark):
    w = {"a": [3.0, 4.0], "b": [0.0, 2.0]}
    tok = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "unknown"), (2, "a")], "id int, word string")
    words = spark.createDataFrame(list(w.items()), "word string, v array<double>")
    got = {r.id: r for r in T.sentence_vectors(tok, "id", "word", words, "v").collect()}
    assert got[1].vec == pytest.approx([0.2, (0.8 + 2) / 3]) and got[1].n == 3 and got[2].vec == pytest.approx([0.6, 0.8])


def test_columns(spark):
    df = spark.createDataFrame([(0, 1, 2.0, None), (1, 1, 0.0, 3.0)], "index int, level_0 int, x double, y double")
    assert R.drop_helpers(df).columns == ["x", "y"]
    assert R.type_census(["0_24_n_eps", "t_hf", "mx_a", "age"]) == {"count": 1, "condition": 1, "maximum": 1, "other": 1}
    assert R.drop_shadowed(["t_copd", "copd", "t_af"]) == ["copd", "t_af"]
    assert R.split_sparse(df, ["level_0", "x", "y"]) == (["level_0"], ["x", "y"])
    f = R.frame_of(spark, {"r": {"a": 1, "b": 2}, "s": {"b": 3}})
    assert sorted(map(tuple, f.collect()), key=str) == [("r", 1.0, 2.0), ("s", None, 3.0)]
    assert sorted(map(tuple, R.transposed(f, "key", ["r", "s"]).collect())) == [("a", 1.0, None), ("b", 2.0, 3.0)]
    v = R.stacked([["x"], ["level_0"]]).transform(df.fillna(0)).first().features
    assert v.toArray().tolist() == [2.0, 1.0]


def test_stepwise_starts_from_the_intercept(rows):
    df, _, _ = rows
    got = M.stepwise(df.withColumn("noise", F.lit(1.0) * F.pmod(F.xxhash64("id"), F.lit(7))), ["noise"], "y", backward=False)
    assert got[0][0] == [] and math.isfinite(got[0][1])


@pytest.mark.parametrize("narrow", [5, 1_000_000])
def test_quantiles_and_auc(spark, narrow):
    x = np.concatenate((np.round(RNG.normal(size=500), 1), np.full(300, 0.5)))
    y = (x + RNG.normal(size=800) > 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 1)], "x double, y int")
    at = (0.0, 0.25, 0.333, 0.5, 0.75, 1.0)
    got = R.quantiles(df, ["x"], at, narrow)["x"]
    assert got == pytest.approx(np.quantile(x, at).tolist())
    assert R.quantiles(df.where("x is null"), ["x"], at)["x"] == [None] * 6
    pairs = (x[y == 1][:, None] > x[y == 0][None, :]).mean() + 0.5 * (x[y == 1][:, None] == x[y == 0][None, :]).mean()
    assert R.auc(df, "x", "y", 8).first().auc == pytest.approx(pairs)


def test_folds_and_even_split(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(200)], "i long, y boolean")
    f = R.folds(df, 4, "y", "i").collect()
    for y in (True, False):
        n = np.bincount([r.fold for r in f if r.y == y], minlength=4)
        assert n.max() - n.min() <= 1
    parts = {r.i: r.part for r in R.even_split(df.select("i"), "i", 7, 16).collect()}
    size = np.bincount(list(parts.values()))[1:]
    assert [parts[i] for i in range(200)] == sorted(parts.values()) and size.tolist() == sorted(size, reverse=True) and size.max() - size.min() <= 1


def test_cox(spark):
    x = RNG.normal(size=(300, 2))
    t = np.ceil(RNG.exponential(np.exp(-(x @ [0.8, -0.5]))) * 20)
    e = RNG.random(300) < 0.8
    df = spark.createDataFrame([(*map(float, a), float(b), bool(c)) for a, b, c in zip(x, t, e, strict=True)], "a double, b double, t double, e boolean")
    got = L.cox(df, ["a", "b"], "t", "e")

    def likelihood(b):
        s = x @ b
        return sum(s[i] - np.log(np.exp(s[t >= t[i]]).sum()) for i in np.flatnonzero(e))

    best = np.array(list(got["coefficients"].values()))
    assert got["log_likelihood"] == pytest.approx(likelihood(best))
    assert all(likelihood(best + h) < likelihood(best) for h in 0.02 * np.array([[1, 0], [-1, 0], [0, 1], [0, -1]]))
    assert np.abs(best - [0.8, -0.5]).max() < 0.3 and len(got["baseline"]) == len(set(t))


def test_sampled_and_prefixes(spark):
    df = spark.range(2000)
    one = R.sampled(df, 50, "id").collect()
    assert len({r.id for r in one}) == 50 == len(one) and sorted(one) == sorted(R.sampled(df, 50, "id").collect())
    many = R.sampled(df, 3000, "id", replacement=True).collect()
    assert 2700 < len(many) < 3300 and len({r.id for r in many}) < 2000
    x = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, 4.0)], "k int, v double")
    assert tuple(x.groupBy("k").agg(*R.aggregates({"0_24_mx_v": "v", "m_v": "v", "n_v": "v", "v": "v"})).first()) == (1, 4.0, 3.0, 2, 6.0)
