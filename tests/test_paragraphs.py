import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import paragraphs as P

DIR = "/root/testdata/sf0.001"


def test_huffman():
    counts = [40, 30, 10, 8, 7, 5]
    t = P.huffman(counts)
    codes = ["".join(str(int(c)) for c, n in zip(t.codes[i], t.nodes[i]) if n >= 0) for i in range(6)]
    assert len(set(codes)) == 6 and not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert sum(n * len(c) for n, c in zip(counts, codes)) == 40 * 1 + 30 * 2 + 10 * 4 + 8 * 4 + 7 * 4 + 5 * 4
    assert t.nodes.max() == 4


@pytest.mark.parametrize("kind", ["tree", "drawn"])
def test_gradients(kind):
    """Against finite differences."""
    rng = np.random.default_rng(1)
    h, out = rng.normal(size=(3, 5)), rng.normal(size=(6, 5))
    if kind == "tree":
        t = P.huffman([9, 7, 5, 3, 2, 1])
        rows, labels = t.nodes[[0, 3, 5]], t.codes[[0, 3, 5]]
    else:
        rows, labels = np.array([[0, 2, -1], [1, 0, 3], [5, 4, 4]]), np.array([[0.0, 1, 1]] * 3)
    loss, gh, go = P.pair_gradients(h, out, rows, labels)
    total = np.zeros_like(out)
    np.add.at(total, rows[rows >= 0], go[rows >= 0])
    for x, g in ((h, gh), (out, total)):
        for i in np.ndindex(x.shape):
            old = x[i]
            x[i] = old + 1e-6
            up = P.pair_gradients(h, out, rows, labels)[0]
            x[i] = old - 1e-6
            down = P.pair_gradients(h, out, rows, labels)[0]
            x[i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


@pytest.mark.parametrize("negatives", [0, 5])
def test_copies_are_nearest(spark, negatives):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("n_chars < 3000").select("doc_id", F.split(F.lower("text"), r"\W+").alias("tok"))
    some = docs.where("doc_id % 10 = 0 and size(tok) > 60").limit(12)
    ids = [r.doc_id for r in some.collect()]
    both = docs.union(docs.where(F.col("doc_id").isin(ids)).select((F.col("doc_id") + 100_000).alias("doc_id"), "tok"))
    both = both.union(spark.createDataFrame([(None, ["a"]), (900_000, None)], both.schema))
    m = P.paragraph_vectors(both, "doc_id", "tok", size=24, window=3, least=5, rounds=6, alpha=0.1, negatives=negatives, parts=3)
    assert all(b < a for a, b in zip(m.losses, m.losses[1:])), m.losses
    rows = {r.doc_id: np.array(r.vector) for r in m.documents.collect()}
    assert len(rows) == both.where("doc_id is not null").count()
    names = list(rows)
    x = np.stack([rows[i] / max(np.linalg.norm(rows[i]), 1e-9) for i in names])
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    hit = [sim[names.index(i), names.index(i + 100_000)] >= np.sort(sim[names.index(i)])[-3] for i in ids]
    assert np.mean(hit) >= 0.8, hit


def test_sums_of_shared_rows():
    """Rows of many and of few places, two inputs each, against a plain loop; more than ``most`` count as so many."""
    rng = np.random.default_rng(4)
    rows = np.concatenate((np.zeros(40, np.int64), rng.integers(0, 30, 60)))
    at, g, h = rng.integers(0, 20, 100), rng.normal(size=(100, 2)), rng.normal(size=(20, 2, 3))
    want, got = np.ones((30, 3)), np.ones((30, 3))
    for r in range(30):
        own = np.flatnonzero(rows == r)
        if len(own):
            want[r] += sum(g[i, s] * h[at[i], s] for i in own for s in (0, 1)) * min(1, 16 / len(own))
    P._add(got, rows, at, g, h, 16.0)
    assert np.allclose(got, want)


def test_every_word_of_long_documents():
    """Documents longer than a run: each word is foretold once, the last of them beside its own neighbours."""
    rng = np.random.default_rng(6)
    size = np.array([3 * P.RUN + 5, 0, 7])
    flat = rng.integers(0, 6, size.sum()).astype(np.int32)
    seen = []
    real, P._move = P._move, lambda vec, docs, inputs, around, target, *rest: seen.extend(zip(docs, target, around)) or 0.0
    try:
        assert P.train(np.zeros((3, 4)), flat, size, None, None, None, None, 2, 0, [1.0, 0.1], 2, rng)[1] == len(flat)
    finally:
        P._move = real
    for d, lo in ((0, 0), (2, size[0])):
        assert np.bincount([t for i, t, _ in seen if i == d], minlength=6).tolist() == np.bincount(flat[lo : lo + size[d]], minlength=6).tolist()
    assert sum((a < 0).any() for *_, a in seen) <= 2 * 2 * 2  # only at the ends of a document


def test_numbers_of_words():
    import pyarrow as pa

    got = P.numbers(pa.array([["b", "x", None, "a"], None, [], ["a", "a"]], pa.list_(pa.string())), pa.array(["a", "b"]))
    assert got.to_pylist() == [[1, 0], [], [], [0, 0]]
