from collections import defaultdict

import numpy as np
import pytest

from cohortry.operators import density as D
from cohortry.operators import neighbours as N


def brute(x, least, k):
    """Top down on the whole distance matrix: at each weight the edges go that are as heavy, what falls apart is looked at anew."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(k, len(x) - 1)]
    m = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    np.fill_diagonal(m, core)

    def parts(own, w):
        """Components of points by edges lighter than w."""
        own, out = set(own), []
        while own:
            todo, seen = [own.pop()], []
            while todo:
                p = todo.pop()
                seen.append(p)
                near = [q for q in own if m[p, q] < w]
                own -= set(near)
                todo += near
            out.append(seen)
        return out

    def spanning(own):
        """Weights of a spanning tree, heaviest first."""
        own, best, out = list(own), {}, []
        best = {p: m[own[0], p] for p in own[1:]}
        while best:
            p = min(best, key=best.get)
            out.append(best.pop(p))
            for q in best:
                best[q] = min(best[q], m[p, q])
        return sorted(set(out), reverse=True)

    def look(own, birth):
        """(stability, chosen clusters, points) of a cluster."""
        total, left = 0.0, list(own)
        for w in spanning(own):
            lam = 1 / max(w, 1e-12)
            found = parts(left, w)
            big = [p for p in found if len(p) >= least]
            gone = sum(len(p) for p in found) - sum(map(len, big))
            total += gone * (lam - birth)
            if len(big) >= 2:
                total += sum(map(len, big)) * (lam - birth)
                inner = [look(p, lam) for p in big]
                below = sum(v[0] for v in inner)
                return (total, [list(own)]) if total >= below else (below, [c for v in inner for c in v[1]])
            if not big:
                return total, [list(own)]
            left = big[0]
        return total, [list(own)]

    out = np.full(len(x), -1)
    # the whole is never chosen: its children are
    left = list(range(len(x)))
    for w in spanning(left):
        big = [p for p in parts(left, w) if len(p) >= least]
        if len(big) >= 2:
            chosen = [c for p in big for c in look(p, 1 / max(w, 1e-12))[1]]
            for i, c in enumerate(sorted(chosen, key=min)):
                out[c] = i
            break
        if not big:
            break
        left = big[0]
    return out


def sample(n=420):
    rng = np.random.default_rng(11)
    parts = [rng.normal(c, s, (k, 3)) for c, s, k in (((0, 0, 0), 0.3, 120), ((3, 0, 0), 0.5, 90), ((3, 1.8, 0), 0.2, 60), ((-4, 2, 1), 0.05, 40))]
    return np.concatenate([*parts, rng.uniform(-6, 6, (n - 310, 3))])


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def labels(df, n):
    rows = {r.id: r.cluster for r in df.collect()}
    return np.array([rows[i] for i in range(n)])


def test_neighbours(spark):
    x = sample()[::2]
    space = N.blocks(frame(spark, x).selectExpr("id", "v as x", "1.0d as w"), block_rows=16)
    assert len(space.centres) > 8
    got = defaultdict(list)
    for r in N.neighbours(space, 5).orderBy("id", "rank").collect():
        got[r.id].append(r.other)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert all(got[i] == np.argsort(d[i])[:5].tolist() for i in range(len(x)))


def test_spanning_forest(spark):
    rng = np.random.default_rng(5)
    e = {(min(a, b), max(a, b)): float(w) for a, b, w in zip(rng.integers(0, 300, 1500).tolist(), rng.integers(0, 300, 1500).tolist(), rng.integers(1, 50, 1500).tolist()) if a != b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], "a long, b long, w double").repartition(5)
    rounds = []
    got = {(r.a, r.b, r.w) for r in N.spanning_forest(df, one_task=40, rounds=rounds).collect()}
    of = list(range(300))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    want = set()
    for w, a, b in sorted((w, a, b) for (a, b), w in e.items()):
        if find(a) != find(b):
            of[find(a)] = find(b)
            want.add((a, b, w))
    assert got == want
    n = [r["edges"] for r in rounds]
    assert 2 <= len(n) <= 9 and all(y < x for x, y in zip(n, n[1:])), n


@pytest.mark.parametrize("least, limit, rows", [(10, 1 << 18, 1024), (25, 60, 48)])
def test_clusters(spark, least, limit, rows):
    """All in one task, and cut into small blocks, tasks and chunks."""
    x = sample()
    rounds = []
    got = labels(D.density_clusters(frame(spark, x), "id", "v", least, block_rows=rows, one_task=limit, rounds=rounds), len(x))
    want = brute(x, least, least)
    assert got.tolist() == want.tolist() and want.max() >= 2 and (want < 0).any()
    pairs = next(r for r in rounds if "pairs" in r)
    if rows < 100:
        assert pairs["pairs"] <= pairs["blocks"] * (pairs["blocks"] + 1) / 2
        nodes = [r["nodes"] for r in rounds if "nodes" in r]
        assert nodes[1] < nodes[0] / 2
        assert all(r["edges"] <= len(x) * least for r in rounds if "edges" in r)


def test_odd_rows(spark):
    """Many copies, null and non-finite vectors, an empty table, clashing names."""
    x = np.concatenate([np.zeros((40, 2)), np.random.default_rng(2).normal(3, 0.2, (30, 2)), [[9.0, 9.0]]])
    rows = [(i, v.tolist(), "c", 1.0) for i, v in enumerate(x)] + [(100, None, "c", 1.0), (101, [float("nan"), 1.0], "c", 1.0), (102, [], None, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, cluster string, w double")
    got = {r.id: r.cluster for r in D.density_clusters(df, "id", "x", 8).collect()}
    assert len(got) == len(rows) and {got[i] for i in range(40)} == {0} and {got[i] for i in (70, 100, 101, 102)} == {-1}
    assert {got[i] for i in range(40, 70)} <= {1, -1} and sum(got[i] == 1 for i in range(40, 70)) >= 25
    assert D.density_clusters(df.where("false"), "id", "x", 8).count() == 0


@pytest.mark.parametrize("runs", [1, 64])
def test_neighbours_of_a_lattice(spark, monkeypatch, runs):
    """Equal distances by id, and no more rows out of the runs of block pairs than each run's ``k`` a point."""
    monkeypatch.setattr(N, "RUNS", runs)
    made, real = [], N.runs
    monkeypatch.setattr(N, "runs", lambda *a: made.append(real(*a)) or made[-1])
    x = np.array([(i, j) for i in range(16) for j in range(16)], float)
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, x array<double>, w double")
    space = N.blocks(df, block_rows=16)
    got = defaultdict(list)
    for r in N.neighbours(space, 6).orderBy("id", "rank").collect():
        got[r.id].append((r.rank, r.other))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert all(got[i] == list(enumerate(np.argsort(d[i], kind="stable")[:6].tolist(), 1)) for i in range(256))
    assert made[0][1] == (runs == 1) and made[0][0].count() <= 6 * 256 * (1 if runs == 1 else 64)


@pytest.mark.parametrize("same", [False, True])
def test_tree_of_a_pair(same):
    """Many edges, which aren't sorted, against few and sorted ones."""
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(50, 3)), rng.normal(size=(70, 3))
    m = N.distances(a, a if same else b)
    p, q = (v.ravel() for v in np.indices(m.shape))
    if same:
        p, q = p[p < q], q[p < q]
    for bound in (np.inf, 1.2, 0.4, 0.0):
        ok = m[p, q] < bound
        keep = N.forest(p[ok], q[ok] + (0 if same else 50), m[p, q][ok])
        got = D.pair_tree(m, same, bound)
        assert sorted(zip(*(v.tolist() for v in got))) == sorted(zip(p[ok][keep].tolist(), q[ok][keep].tolist()))
