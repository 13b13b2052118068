import numpy as np
import pytest

from cohortry.operators import topics as P


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def by_hand(x, v, n, count, interval, weighted):
    """The same on whole arrays, with topics as parallel lists."""
    v, n, of = [*v], [*n], [[i] for i in range(len(v))]
    step = 0
    while len(v) > count:
        i = int(np.argmin(n))
        sim = [-9 if j == i else float(np.dot(v[i], v[j])) for j in range(len(v))]
        j = int(np.argmax(sim))
        w = (n[i], n[j]) if weighted else (1, 1)
        new, size, both = unit(v[i] * w[0] + v[j] * w[1]), n[i] + n[j], of[i] + of[j]
        for k in sorted((i, j), reverse=True):
            del v[k], n[k], of[k]
        v, n, of = v + [new], n + [size], of + [both]
        if step % interval == 0:
            best = (x @ np.array(v).T).argmax(axis=1)
            n = [max(1, int((best == k).sum())) for k in range(len(v))]
        step += 1
    best = (x @ np.array(v).T).argmax(axis=1)
    v = np.array([unit(x[best == k].mean(axis=0)) if (best == k).any() else v[k] for k in range(len(v))])
    best = (x @ v.T).argmax(axis=1)
    n = [int((best == k).sum()) for k in range(len(v))]
    order = sorted(range(len(v)), key=lambda k: (-n[k], k))
    return v[order], [sorted(of[k]) for k in order], [n[k] for k in order]


@pytest.mark.parametrize(("interval", "weighted"), [(1, True), (3, True), (100, False)])
def test_refreshed_reduction(spark, interval, weighted):
    rng = np.random.default_rng(interval)
    centre = unit(rng.normal(size=(9, 6)))
    x = unit(centre[rng.integers(0, 9, 400)] + 0.3 * rng.normal(size=(400, 6)))
    size = np.bincount((x @ centre.T).argmax(axis=1), minlength=9).tolist()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)]
    docs = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    v, groups, n = P.refreshed_reduction(docs, "v", centre, size, 4, interval, weighted)
    want_v, want_groups, want_n = by_hand(x, centre, size, 4, interval, weighted)
    assert groups == want_groups and n == want_n and sum(n) == 400
    np.testing.assert_allclose(v, want_v, atol=1e-9)


def test_topics_without_documents_stay(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    v, groups, n = P.refreshed_reduction(docs, "v", np.eye(2), [1, 1], 2)
    assert groups == [[0], [1]] and n == [1, 0]
    np.testing.assert_allclose(v, np.eye(2))
    v, groups, n = P.refreshed_reduction(docs.limit(0), "v", np.eye(2), [0, 0], 1)
    assert groups == [[0, 1]] and n == [0]


def chained(v, e):
    root = list(range(len(v)))
    for i in range(len(v)):
        for j in range(i):
            if v[i] @ v[j] >= 1 - e:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return len(set(root))


def test_stable_distance():
    v = unit(np.random.default_rng(4).normal(size=(30, 8)))
    steps = [i / 50 for i in range(101)]
    left = [chained(v, e) for e in steps]
    assert left == [30 - int((P.spanning_similarities(v) >= 1 - e).sum()) for e in steps]
    first, one = next(i for i, n in enumerate(left) if n < 30), left.index(1)
    assert P.stable_distance(v, steps[::-1]) == steps[first + round((one - first) * 0.9)]


def test_stable_distance_without_merges():
    assert P.stable_distance(np.eye(3), [0.1, 0.2]) == 0.1
    assert P.stable_distance(np.eye(1), [0.1, 0.2]) == 0.1
    assert P.stable_distance(np.array([[1.0, 0], [1.0, 0], [0, 1.0]]), [0.1, 0.2]) == 0.2  # never one: the last step, nine tenths of the way to it
