"""An inverted-list index of vectors: coarse centres from a bounded sample, every row in its nearest list, queries look into a few lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class VectorIndex:
    """Centres of the lists, how many lists a query looks into, and the rows: (list, chunk, id, vector)."""

    centres: np.ndarray
    probes: int
    chunks: dict[int, int]
    rows: DataFrame

    def search(self, queries: DataFrame, key: str, vector: str, top: int = 10) -> DataFrame:
        """(key, id, score, rank): the ``top`` rows by inner product among the lists looked into.

        Queries meet the rows of a list chunk by chunk, in blocks; a chunk returns its best
        ``top`` of each query, so a long list is neither one task nor a long result.
        """
        centres, probes, chunks = self.centres, self.probes, self.chunks
        kind = queries.schema[key].dataType.simpleString()

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                s = np.stack(f["v"].to_numpy()).astype(np.float64) @ centres.T
                near = np.argpartition(-s, min(probes, s.shape[1]) - 1, axis=1)[:, :probes]
                at = [(i, int(k), c) for i, own in enumerate(near) for k in own for c in range(chunks.get(int(k), 0))]
                rows, lists, parts = (np.array([a[j] for a in at], np.int64) for j in range(3))
                for b in range(0, len(at), 20_000):
                    r = rows[b : b + 20_000]
                    yield pd.DataFrame({"q": f["q"].to_numpy()[r], "v": f["v"].to_numpy()[r], "list": lists[b : b + 20_000], "chunk": parts[b : b + 20_000]})

        def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"q": [], "id": [], "score": []})
            vectors, ids = np.stack(x["v"].to_numpy()).astype(np.float64), x["id"].to_numpy()
            out = []
            for b in range(0, len(q), 512):
                own = q.iloc[b : b + 512]
                s = np.stack(own["v"].to_numpy()).astype(np.float64) @ vectors.T
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :top]
                out.append(pd.DataFrame({"q": np.repeat(own["q"].to_numpy(), order.shape[1]), "id": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()}))
            return pd.concat(out, ignore_index=True)

        dealt = queries.select(F.col(key).alias("q"), F.col(vector).cast("array<float>").alias("v")).mapInPandas(deal, f"q {kind}, v array<float>, list long, chunk long")
        found = dealt.groupBy("list", "chunk").cogroup(self.rows.groupBy("list", "chunk")).applyInPandas(compare, f"q {kind}, id long, score double")
        w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(F.col("q").alias(key), "id", "score", "rank")


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on the driver's sample."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-12), centres)
    return centres


def build_index(df: DataFrame, key: str, vector: str, *, lists: int | None = None, sample_rows: int = 16_384, chunk_rows: int = 16_384, recall: float = 0.97, top: int = 10, seed: int = 7) -> VectorIndex:
    """Indexes every row of ``df`` (unit vectors; null ones are left out).

    Centres, about the root of the rows but 1024 at most, are fitted on at most
    ``sample_rows`` rows, by a hash.  On these rows the number of lists a query looks into is
    doubled until their ``top`` neighbours are found to the share ``recall``.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    n = rows.count()
    some = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows).collect()
    x = np.array([r.v for r in some], np.float64)
    if not len(x):
        return VectorIndex(np.zeros((1, 1)), 1, {}, rows.select(F.lit(0).cast("long").alias("list"), F.lit(0).cast("long").alias("chunk"), "id", "v"))
    k = min(lists or max(1, min(1024, math.isqrt(n))), len(x))
    centres = _lloyd(x, k, seed)
    near = x @ centres.T
    own = near.argmax(axis=1)
    test = x[: min(256, len(x))]
    best = np.argsort(-(test @ x.T), axis=1)[:, : top + 1]
    probes = 1
    while probes < k:
        look = np.argsort(-near[: len(test)], axis=1)[:, :probes]
        if (own[best][:, :, None] == look[:, None, :]).any(axis=2).mean() >= recall:
            break
        probes *= 2
    probes = min(probes, k)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(list=(np.stack(f["v"].to_numpy()).astype(np.float64) @ centres.T).argmax(axis=1))[["list", "id", "v"]]

    placed = rows.mapInPandas(place, "list long, id long, v array<float>")
    size = {r["list"]: -(-r["n"] // chunk_rows) for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    parts = F.element_at(F.lit([size.get(i, 1) for i in range(k)]), (F.col("list") + 1).cast("int"))
    return VectorIndex(centres, probes, size, placed.withColumn("chunk", F.pmod(F.xxhash64("id"), parts)).select("list", "chunk", "id", "v"))


def recall_of(found: DataFrame, exact: DataFrame, key: str) -> float:
    """Share of exact (key, id) pairs that were found."""
    n = exact.count()
    return found.select(key, "id").join(exact.select(key, "id"), [key, "id"], "left_semi").count() / n if n else 1.0
