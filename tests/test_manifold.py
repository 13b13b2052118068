import math

import numpy as np
from pyspark.sql import functions as F

from cohortry.operators import manifold as M
from cohortry.operators import neighbours as N
from cohortry.operators.models import reduce_dimensions

DIR = "/root/testdata/sf0.001"


def vectors(spark):
    return spark.read.parquet(f"{DIR}/embeddings.parquet")


def brute_graph(x, k):
    """Memberships row by row, by plain bisection, and their union."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : k - 1]
    w = np.zeros((n, n))
    mean = sum(d[i, near[i]].sum() for i in range(n)) / (n * k)
    for i in range(n):
        own = d[i, near[i]]
        pos = own[own > 0]
        rho = pos[0] if len(pos) else 0.0
        lo, hi, s = 0.0, math.inf, 1.0
        for _ in range(64):
            total = sum(math.exp(-max(v - rho, 0) / s) for v in own)
            if abs(total - math.log2(k)) < 1e-5:
                break
            if total > math.log2(k):
                hi = s
                s = (lo + hi) / 2
            else:
                lo = s
                s = s * 2 if hi == math.inf else (lo + hi) / 2
        s = max(s, 1e-3 * (own.sum() / k if rho > 0 else mean))
        for j, v in zip(near[i], own):
            w[i, j] = math.exp(-max(v - rho, 0) / s)
    return w + w.T - w * w.T


def test_graph(spark):
    x = np.random.default_rng(3).normal(size=(120, 5))
    x[7] = x[3]  # a copy
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, x array<double>, w double")
    near = N.neighbours(N.blocks(df, block_rows=20), 9)
    got = np.zeros((120, 120))
    for r in M.fuzzy_graph(M.memberships(near, 10)).collect():
        got[r.a, r.b] = got[r.b, r.a] = r.w
    assert np.allclose(got, brute_graph(x, 10), atol=1e-4)


def test_curve():
    a, b = M.curve(0.1)
    assert abs(a - 1.5769) < 0.01 and abs(b - 0.8951) < 0.01


def test_neighbours_of(spark):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(150, 3)), rng.normal(size=(40, 3))
    base = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, x array<double>, w double")
    ask = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>")
    got = {}
    for r in N.neighbours_of(ask, N.blocks(base, block_rows=16), 4).orderBy("id", "rank").collect():
        got.setdefault(r.id - 1000, []).append(r.other)
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert got == {i: np.argsort(d[i])[:4].tolist() for i in range(40)}


def roll(spark):
    rng = np.random.default_rng(5)
    t, h = rng.uniform(0, 9, 400), rng.uniform(0, 10, 400)
    return spark.createDataFrame([(i, [float(a * np.cos(a)), float(a * np.sin(a)), float(b)]) for i, (a, b) in enumerate(zip(t, h))], "id long, v array<double>")


def test_layout_keeps_neighbours(spark):
    """A rolled sheet: unrolled by blocks whose points see each other between rounds, and with half of the points placed later."""
    df = roll(spark)
    pca = M.trustworthiness(reduce_dimensions(df, "v", 2), "id", "v", "reduced")
    for share in (1.0, 0.5):
        both = M.reduce_manifold(df, "id", "v", 2, cosine=False, share=share, rounds=8, epochs=12, block_rows=64).join(df, "id")
        assert both.count() == 400
        ours = M.trustworthiness(both, "id", "v", "reduced")
        assert ours > pca + 0.02, (share, ours, pca)


def test_embeddings(spark):
    df = vectors(spark)
    both = M.reduce_manifold(df, "vec_id", "embedding", 2, share=1.0).join(df, "vec_id")
    pca = M.trustworthiness(reduce_dimensions(df, "embedding", 2), "vec_id", "embedding", "reduced")
    assert M.trustworthiness(both, "vec_id", "embedding", "reduced") > pca


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [float("nan"), 1.0], 0), (None, [1.0, 2.0], 0), (3, [1.0, 2.0], 0)], "id long, v array<double>, w int")
    assert [tuple(r) for r in M.reduce_manifold(df, "id", "v", 2).collect()] == [(3, [0.0, 0.0])]
    assert M.reduce_manifold(df.where("false"), "id", "v", 2).count() == 0


def graphs(spark):
    rng = np.random.default_rng(8)
    out = []
    for _ in range(2):
        w = np.where(rng.random((25, 25)) < 0.25, rng.random((25, 25)), 0.0)
        w = np.triu(w, 1)
        out.append((w + w.T, spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "a long, b long, w double")))
    return out


def dense(df):
    out = np.zeros((25, 25))
    for r in df.collect():
        out[r.a, r.b] = out[r.b, r.a] = r.w
    return out


def reset(m):
    m = m / np.where(m.max(axis=1, keepdims=True) > 0, m.max(axis=1, keepdims=True), 1)
    return m + m.T - m * m.T


def test_algebra(spark):
    (u, gu), (v, gv) = graphs(spark)
    lu, lv = (max(x[x > 0].min() / 2, 1e-8) for x in (u, v))
    either = (u > 0) | (v > 0)
    fu, fv = np.where(u > 0, u, lu), np.where(v > 0, v, lv)
    assert np.allclose(dense(M.union(gu, gv)), np.where(either, fu + fv - fu * fv, 0))
    fv = np.where(v > 0, v, min(lv, 1e-4))
    for weight in (0.5, 0.3, 0.8):
        p = fu * fv ** (weight / (1 - weight)) if weight < 0.5 else fu ** ((1 - weight) / weight) * fv
        assert np.allclose(dense(M.intersection(gu, gv, weight)), reset(np.where(either, p, 0)))
    low = min(max(1 - v.max(), 1e-8) / 2, 1e-4)
    fv = np.where(v > 0, 1 - v, low)
    assert np.allclose(dense(M.difference(gu, gv)), reset(np.where(u > 0, np.where((u > lu) | (fv > low), u * fv, u), 0)))
    back = dense(M.intersection(gu, gu))
    assert np.allclose(back[u > 0].max(), 1.0)
    assert M.union(gu, gv.where("false")).agg(F.count("*")).first()[0] == np.count_nonzero(np.triu(u))


def test_neighbours_of_in_runs(spark, monkeypatch):
    """Rows are packed and compared by runs, not sent to every ball: at most k rows a row and run; ties by id; no rows at all."""
    made, real = [], N.runs
    monkeypatch.setattr(N, "RUNS", 1)
    monkeypatch.setattr(N, "runs", lambda *a: made.append(real(*a)) or made[-1])
    x = np.array([(i, j) for i in range(12) for j in range(12)], float)
    base = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, x array<double>, w double")
    ask = spark.createDataFrame([(1000 + i, (v + 0.5).tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    space = N.blocks(base, block_rows=16)
    got = {}
    for r in N.neighbours_of(ask, space, 3).orderBy("id", "rank").collect():
        got.setdefault(r.id - 1000, []).append(r.other)
    d = np.round(np.sqrt((((x + 0.5)[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    assert got == {i: np.argsort(d[i], kind="stable")[:3].tolist() for i in range(144)}
    assert made[0][0].count() == 3 * 144
    assert N.neighbours_of(ask.where("false"), space, 3).count() == 0


def test_algebra_side_by_side(spark):
    (_, gu), (_, gv) = graphs(spark)
    got = M.algebra(gu, gv)
    for name in ("union", "intersection", "difference"):
        own = got.select("a", "b", F.col(name).alias("w")).where("w is not null")
        want = getattr(M, name)(gu, gv)
        assert own.count() == want.count() and np.allclose(dense(own), dense(want), rtol=1e-12)


def test_united_graphs_compare_vectors_once(spark):
    """What is left to do after the graphs of the halves are written reads these, and compares no vectors again."""
    import __spark_entry__ as entry

    df = entry.queries()["emb_07_united_graphs"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan
    assert {r.kind for r in df.collect()} == {"union", "intersection", "difference"}


def test_neighbours_are_measured_exactly(spark):
    """Copies are at distance 0 and go by id; the filter of single precision loses none, far from the origin or for vectors whose squares are not finite."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 32)), 5, axis=0)
    x = np.concatenate((x, 1e4 + 1e-6 * rng.normal(size=(60, 32)), np.full((2, 32), 1e200)))
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, x array<double>, w double")
    got = {i: [] for i in range(len(x))}
    for r in N.neighbours(N.blocks(df, block_rows=32), 4).collect():
        got[r.id].append((r["rank"], r.other, r.dist))
    for i in range(260):
        d = np.sqrt(((x[:260] - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        near = np.lexsort((np.arange(260), d))[:4]
        mine = sorted(got[i])
        assert [o for _, o, _ in mine] == near.tolist() and np.allclose([v for *_, v in mine], d[near], rtol=1e-12, atol=0)
    assert not got[260] and not got[261]
