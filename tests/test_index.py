"""Recall of the vector index against brute force, and matched draws."""

import numpy as np
from pyspark.sql import functions as F

from cohortry.operators import cohort as C
from cohortry.operators.index import build_index


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows["embedding"].to_numpy()).astype(np.float64), rows["vec_id"].to_numpy()
    index = build_index(df, "vec_id", "embedding", chunk_rows=50)
    assert index.rows.select("id").distinct().count() == len(ids)
    got = {}
    for r in index.search(df.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.id, r.score))
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        want = set(ids[np.argsort(-(x[i].astype(np.float32).astype(np.float64) @ x.T), kind="stable")[:10]].tolist())
        own = sorted(got[ids[i]])
        assert [k for k, _, _ in own] == list(range(1, 11)) and all(a[2] >= b[2] for a, b in zip(own, own[1:]))
        hits.append(len(want & {j for _, j, _ in own}) / 10)
    assert len(got) == (ids % 100 == 0).sum() and np.mean(hits) >= 0.9


def test_empty_index(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert build_index(df, "vec_id", "embedding").search(df, "vec_id", "embedding").count() == 0


def test_matched_draws(spark):
    cases = spark.createDataFrame([("a", d) for d in (1000, 1000, 2000)], "s string, day long")
    controls = spark.createDataFrame([(1, "a", d) for d in (950, 1200, 1500)] + [(2, "a", 1990), (2, "a", 2100)] + [(3, "b", 1000), (3, "b", 1500)] + [(4, "a", 5000), (4, "a", 5500)], "pid long, s string, day long")
    got = {r.pid: (r.drawn, r.day) for r in C.match_draws(cases, controls, ["s"]).collect()}
    assert got == {1: (1000, 950)} == {r.pid: (r.drawn, r.day) for r in C.match_draws(cases, controls, ["s"]).collect()}
    loose = {r.pid: r.drawn for r in C.match_draws(cases, controls, ["s"], least_days=0).collect()}
    assert loose == {1: 1000, 2: 2000}
    assert C.match_draws(cases.where("false"), controls, ["s"]).count() == 0 and C.match_draws(cases, controls.where(F.lit(False)), ["s"]).count() == 0
