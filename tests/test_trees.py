import heapq

import numpy as np

from cohortry.operators import trees as T


def table(n=1200):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[rng.random((n, 4)) < 0.1] = np.nan
    p = 1 / (1 + np.exp(-(np.nan_to_num(x[:, 0]) * 2 + (np.nan_to_num(x[:, 1], nan=3.0) > 1) * 1.5 - 1)))
    return x, (rng.random(n) < p).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double")


def splits(x, w, stats, features, gain, least):
    """All cuts between values, one after the other."""
    best = None
    for j in features:
        top = int(x[:, j].max(initial=0))
        for cut in range(1, top):
            for side in (True, False) if (x[:, j] == 0).any() else (True,):
                left = np.where(x[:, j] == 0, side, x[:, j] <= cut)
                a, b = stats[left].sum(axis=0), stats[~left].sum(axis=0)
                if least(a, b) and gain(a, b) > 1e-9 and (best is None or gain(a, b) > best[0] + 1e-9):
                    best = (gain(a, b), j, cut, side, left)
    return best


def test_forest_is_best_first(spark):
    x, y = table()
    df = frame(spark, x, y)
    rows, _ = T.binned(df, list("abcd"), "y", 16)
    got = rows.collect()
    bx, by, key = np.array([r.x for r in got]), np.array([r.y for r in got]), np.array([r.key for r in got])
    gini = lambda c: c.sum() - (c * c).sum() / max(c.sum(), 1e-300)
    gain = lambda a, b: gini(a[:2] + b[:2]) - gini(a[:2]) - gini(b[:2])
    for t, tree in enumerate(T.forest(df, list("abcd"), "y", trees=3, depth=4, least_rows=40, leaves=6, tried=2, bins=16, group=2)):
        w = T.bootstrap(key, t, 42)
        cls = np.stack([w * (by != 1), w * (by == 1)], axis=1)
        weight = cls.sum() / 2 / cls.sum(axis=0)
        stats = np.concatenate((cls * weight, (w > 0)[:, None]), axis=1)

        def look(rows_, name, depth):
            if depth == 4 or stats[rows_, 2].sum() < 40:
                return None
            return splits(bx[rows_], None, stats[rows_], T._features(t, name, 4, 2, 42), gain, lambda a, b: a[2] >= 1 and b[2] >= 1)

        heap, made, order = [], [], 0
        first = look(np.flatnonzero(w), 1, 0)
        heapq.heappush(heap, (-first[0], order, 1, np.flatnonzero(w), 0, first))
        leaves = 1
        while heap and leaves < 6:
            _, _, name, own, depth, s = heapq.heappop(heap)
            made.append((name, s[1], s[2], s[3], round(s[0], 6)))
            leaves += 1
            for k, part in enumerate((own[s[4]], own[~s[4]])):
                below = look(part, 2 * name + k, depth + 1)
                if below:
                    order += 1
                    heapq.heappush(heap, (-below[0], order, 2 * name + k, part, depth + 1, below))
        mine = [(T._path(tree, i), n.feature, n.bin, n.missing_left, round(n.gain, 6)) for i, n in enumerate(tree.nodes) if n.children]
        assert sorted(mine) == sorted(made) and len(mine) <= 5
    ranked = T.forest_importance(T.forest(df, list("abcd"), "y", trees=6, bins=16, least_rows=40), list("abcd"))
    assert ranked[0][0] == "a" and abs(sum(v for _, v in ranked) - 1) < 1e-9


def test_boosting(spark):
    x, y = table()
    df = frame(spark, x, y)
    m = T.boosted(df, list("abcd"), "y", trees=3, depth=2, sample=1.0, bins=16)
    rows = T.binned(df, list("abcd"), "y", 16)[0].collect()
    bx, by = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    score = lambda s: s[0] ** 2 / (s[1] + 1)
    gain = lambda a, b: 0.5 * (score(a) + score(b) - score(a + b))
    margin = np.zeros(len(bx))
    for tree in m.trees:
        p = 1 / (1 + np.exp(-margin))
        stats = np.stack([p - by, p * (1 - p)], axis=1)
        at = tree.route(bx)
        for i, n in enumerate(tree.nodes):
            below, todo = {i}, [i]
            while todo:
                kids = tree.nodes[todo.pop()].children or ()
                below |= set(kids)
                todo += kids
            own = np.flatnonzero(np.isin(at, list(below)))
            if n.children:
                s = splits(bx[own], None, stats[own], range(4), gain, lambda a, b: a[1] >= 1 and b[1] >= 1)
                assert (s[1], s[2], s[3]) == (n.feature, n.bin, n.missing_left) and abs(s[0] - n.gain) < 1e-6
            total = stats[own].sum(axis=0)
            assert abs(n.value + total[0] / (total[1] + 1)) < 1e-9
        margin += 0.3 * np.array([n.value for n in tree.nodes])[at]
    loss = lambda f: np.logaddexp(0, np.where(by == 1, -f, f)).mean()
    assert loss(margin) < loss(np.zeros(len(by)))
    pred = m.predict(df.selectExpr("*", "1L as id"), "id").toPandas()
    assert pred["probability"].between(0, 1).all() and len(pred) == len(x)
    assert m.importance()[0][0] in "ab"


def test_families():
    ranked = [("x_atc_1", 0.5), ("o1", 0.2), ("x_icpc_1", 0.1), ("x_atc_2", 0.08), ("o2", 0.07), ("x_icpc_2", 0.05)]
    assert T.families(ranked, {"_atc_": 1, "_icpc_": 1}, 1, 2) == ["x_atc_1", "o1", "x_icpc_1"]
    assert T.families(ranked, {"_atc_": 1, "_icpc_": 1}, 1, 5) == ["x_atc_1", "o1", "x_icpc_1", "x_atc_2", "o2"]


def test_boosting_counts_equal_rows(spark):
    """A table of few different rows: one row each, with numbers that add up, and the trees that all rows make."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (900, 4)).astype(float)
    x[rng.random((900, 4)) < 0.1] = np.nan
    y = (rng.random(900) < 0.2 + 0.3 * (np.nan_to_num(x[:, 0]) > 0)).astype(float)
    df = frame(spark, x, y)
    rows, _ = T.binned(df, list("abcd"), "y", 16, grouped=True)
    got = rows.collect()
    assert sum(r.n for r in got) == 900 and len(got) == len({(*np.nan_to_num(v, nan=-1.0), t) for v, t in zip(x, y)})
    m = T.boosted(df, list("abcd"), "y", trees=1, depth=1, bins=16)
    all_ = T.binned(df, list("abcd"), "y", 16)[0].collect()
    own = T.hash01(np.array([r.key for r in all_]), 42 * 7919) < 0.9
    g = np.array([0.5 - r.y for r in all_])[own]
    assert 0 < own.sum() < 900 and np.allclose(m.trees[0].nodes[0].totals, [g.sum(), 0.25 * own.sum()])


def test_boosting_in_one_task_or_all(spark, monkeypatch):
    """A small table is boosted by one task, a large one by all, with margins written anew now and then: the same trees."""
    x, y = table()
    df = frame(spark, x, y)
    one = T.boosted(df, list("abcd"), "y", trees=5, depth=3, bins=16)
    monkeypatch.setattr(T, "ONE_TASK", 0)
    monkeypatch.setattr(T, "STORED", 2)
    all_ = T.boosted(df, list("abcd"), "y", trees=5, depth=3, bins=16)
    assert len(one.trees) == len(all_.trees) == 5
    for a, b in zip(one.trees, all_.trees):
        assert [(n.feature, n.bin, n.missing_left, n.children) for n in a.nodes] == [(n.feature, n.bin, n.missing_left, n.children) for n in b.nodes]
        assert np.allclose([n.value for n in a.nodes], [n.value for n in b.nodes], rtol=1e-9) and np.allclose([n.gain for n in a.nodes], [n.gain for n in b.nodes], rtol=1e-9)
    monkeypatch.undo()
    none = T.boosted(df.where("false"), list("abcd"), "y", trees=2)
    assert len(none.trees) == 2 and not any(n.children or n.value for t in none.trees for n in t.nodes)


def test_second_order_query_grows_all_trees(spark, monkeypatch):
    import __spark_entry__ as entry
    from cohortry.plans import q_text

    made = []
    monkeypatch.setattr(q_text, "boosted", lambda *a, **k: made.append(T.boosted(*a, **k)) or made[-1])
    rows = entry.queries()["ml_08_second_order"](spark, "/root/testdata/sf0.001").collect()
    assert len(made[0].trees) == 100 and abs(sum(r.importance for r in rows) - 1) < 1e-9
