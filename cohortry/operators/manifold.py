"""Manifold reduction: fuzzy neighbour graphs, their algebra, and layouts by stochastic gradient over blocks of edges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalise
from .models import reduce_dimensions
from .neighbours import Blocks, blocks, neighbours, neighbours_of, written

# Fixed values of the published method.
TOLERANCE, LEAST_SCALE, STEPS, CLIP, REPEL = 1e-5, 1e-3, 64, 4.0, 1e-3


def bandwidths(d: np.ndarray, k: int, local: float, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """rho and sigma of rows of rising distances (inf: no neighbour): rho to the ``local``-th neighbour that is not a copy, sigma such that memberships add up to log2(k)."""
    some = np.isfinite(d)
    rho = np.zeros(len(d))
    for i, row in enumerate(d):
        far = row[(row > 0) & some[i]]
        whole, part = int(math.floor(local)), local - math.floor(local)
        if len(far) >= local:
            rho[i] = far[whole - 1] if whole else part * far[0]
            if whole and part > TOLERANCE:
                rho[i] += part * (far[whole] - far[whole - 1])
        elif len(far):
            rho[i] = far.max()
    over = np.maximum(np.where(some, d, np.inf) - rho[:, None], 0.0)
    lo, hi, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    open_ = np.ones(len(d), bool)
    for _ in range(STEPS):
        total = np.where(some, np.exp(-over / mid[:, None]), 0.0).sum(axis=1)
        open_ &= np.abs(total - math.log2(k)) >= TOLERANCE
        if not open_.any():
            break
        above = open_ & (total > math.log2(k))
        below = open_ & ~above
        hi[above] = mid[above]
        lo[below] = mid[below]
        mid = np.where(open_, np.where(np.isinf(hi), mid * 2, (lo + np.where(np.isinf(hi), lo, hi)) / 2), mid)
    count = some.sum(axis=1) + 1  # itself at 0
    own = np.where(some, d, 0.0).sum(axis=1) / count
    return rho, np.maximum(mid, LEAST_SCALE * np.where(rho > 0, own, mean))


def memberships(near: DataFrame, k: int, *, local: float = 1.0) -> DataFrame:
    """(id, other, w): how much each of a row's neighbours belongs to it; ``near`` has id, other, dist, rank of k - 1 others."""
    total, n, ids = near.agg(F.sum("dist"), F.count("*"), F.countDistinct("id")).first()
    mean = (total or 0.0) / max(1, n + ids)
    listed = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "other"))).alias("l"))  # k - 1 at most

    def run(batches):
        for f in batches:
            if not f.num_rows:
                continue
            flat = f.column("l").flatten()
            size = f.column("l").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            d = np.full((len(size), size.max()), np.inf)
            o = np.zeros(d.shape, np.int64)
            d[row, place] = flat.field("dist").to_numpy()
            o[row, place] = flat.field("other").to_numpy()
            rho, sigma = bandwidths(d, k, local, mean)
            i, j = np.nonzero(np.isfinite(d))
            w = np.exp(-np.maximum(d[i, j] - rho[i], 0.0) / sigma[i])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f.column("id").to_numpy()[i], o[i, j], w)], ["id", "other", "w"])

    return listed.mapInArrow(run, "id long, other long, w double")


def fuzzy_graph(directed: DataFrame, mix: float = 1.0) -> DataFrame:
    """(a, b, w), a < b: union of both directions' memberships, u + v - uv; ``mix`` below 1 takes so much of the union and the rest of uv."""
    g = directed.where("id <> other").groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    g = g.agg(F.sum("w").alias("s"), F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0).alias("p"))
    return g.select("a", "b", (mix * (F.col("s") - F.col("p")) + (1 - mix) * F.col("p")).alias("w")).where("w > 0")


# ---- algebra of graphs (a, b, w)


def _side(g: DataFrame, most: float | None = None) -> float:
    """What stands for a missing edge: half of the least weight."""
    low = max((g.agg(F.min("w")).first()[0] or 0.0) / 2, 1e-8)
    return min(low, most) if most else low


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("a", "b", F.col("w").alias("u")).join(right.select("a", "b", F.col("w").alias("v")), ["a", "b"], "full")


def _weighed(u: Column, v: Column, weight: float) -> Column:
    return u * F.pow(v, F.lit(weight / (1 - weight))) if weight < 0.5 else F.pow(u, F.lit((1 - weight) / weight)) * v


def _united(left: DataFrame, right: DataFrame) -> Column:
    u, v = F.coalesce("u", F.lit(_side(left))), F.coalesce("v", F.lit(_side(right)))
    return u + v - u * v


def _intersected(left: DataFrame, right: DataFrame, weight: float) -> Column:
    lu, lv = _side(left), _side(right, 1e-4)
    u, v = F.coalesce("u", F.lit(lu)), F.coalesce("v", F.lit(lv))
    return F.when((u > lu) | (v > lv), _weighed(u, v, weight)).otherwise(F.coalesce("u", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)))


def _without(left: DataFrame, right: DataFrame, weight: float) -> Column:
    lu = _side(left)
    low = min(max(1 - (right.agg(F.max("w")).first()[0] or 0.0), 1e-8) / 2, 1e-4)  # of the right side's complement
    u, v = F.col("u"), F.coalesce(1 - F.col("v"), F.lit(low))
    return F.when(u.isNotNull(), F.when((u > lu) | (v > low), _weighed(u, v, weight)).otherwise(u))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """u + v - uv on the edges of either; a missing one has half of its side's least weight."""
    return _both(left, right).select("a", "b", _united(left, right).alias("w"))


def intersection(left: DataFrame, right: DataFrame, weight: float = 0.5) -> DataFrame:
    """Product of the weights, that of the right side counting ``weight`` of both, local connectivity reset."""
    return reset_local(_both(left, right).select("a", "b", _intersected(left, right, weight).alias("w")))


def difference(left: DataFrame, right: DataFrame, weight: float = 0.5) -> DataFrame:
    """The left side's edges, weakened where the right side has them too, local connectivity reset."""
    return reset_local(_both(left, right).select("a", "b", _without(left, right, weight).alias("w")))


def algebra(left: DataFrame, right: DataFrame, weight: float = 0.5) -> DataFrame:
    """(a, b, union, intersection, difference): the three graphs side by side from one join of the sides, null where one has no such edge."""
    g = _both(left, right).select("a", "b", _united(left, right).alias("union"), _intersected(left, right, weight).alias("intersection"), _without(left, right, weight).alias("difference"))
    return _reset(g, "intersection", "difference")


def reset_local(g: DataFrame) -> DataFrame:
    """Every row's strongest edge is 1 again: weights over the largest of each end, united.  ``g`` has an edge (a < b) once."""
    return _reset(g.where("w > 0"), "w").where("w > 0")


def _reset(g: DataFrame, *cols: str) -> DataFrame:
    """The edges of each of these weights, null where none is above 0; the other columns stay."""
    g = g.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in cols})
    top = g.select(F.explode(F.array("a", "b")).alias("id"), *cols).groupBy("id").agg(*(F.max(c).alias(c) for c in cols))
    for end in ("a", "b"):
        g = g.join(top.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in cols)), end)
    x, y = (lambda c, end=end: F.col(c) / F.col(f"{c}_{end}") for end in ("a", "b"))
    own = {c: x(c) + y(c) - x(c) * y(c) for c in cols}
    return g.withColumns({c: F.when(v > 0, v) for c, v in own.items()}).drop(*(f"{c}_{end}" for c in cols for end in ("a", "b")))


# ---- layout


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^2b) nearest to 1 up to ``min_dist`` and exponential decay from there, by damped Gauss-Newton steps."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-2
    f = lambda p: 1 / (1 + p[0] * x ** (2 * p[1]))
    err = ((f(p) - y) ** 2).sum()
    for _ in range(200):
        z = f(p)
        jac = np.stack([-(z**2) * x ** (2 * p[1]), -(z**2) * p[0] * 2 * np.log(x) * x ** (2 * p[1])], axis=1)
        new = p - np.linalg.solve(jac.T @ jac + damp * np.eye(2), jac.T @ (z - y))
        e = ((f(new) - y) ** 2).sum() if (new > 0).all() else np.inf
        if e < err:
            done = err - e < 1e-14
            p, err, damp = new, e, damp / 3
            if done:
                break
        else:
            damp *= 4
    return float(p[0]), float(p[1])


def descend(y: np.ndarray, head: np.ndarray, tail: np.ndarray, outer: np.ndarray, chance: np.ndarray, pool: np.ndarray, a: float, b: float, alphas: list[float], negatives: int, rng: np.random.Generator, own: float = 0.0) -> np.ndarray:
    """Epochs over the edges of some heads: each edge with its chance, one edge of every head at a time.

    ``tail``: position of a tail among the heads, or -1, where ``outer`` has its coordinates,
    which stay.  After an edge pulled its head, ``negatives`` points push it: a share of ``own`` are heads
    where they are now, the others are of the ``pool``.
    """
    for alpha in alphas:
        used = np.flatnonzero(rng.random(len(head)) < chance)
        used = used[np.lexsort((rng.random(len(used)), head[used]))]
        if not len(used):
            continue
        h = head[used]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        nth = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
        order = np.argsort(nth, kind="stable")
        for part in np.split(used[order], np.cumsum(np.bincount(nth))[:-1]):
            i, t = head[part], tail[part]
            other = np.where((t >= 0)[:, None], y[t], outer[part])
            diff = y[i] - other
            d2 = (diff * diff).sum(axis=1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-300) ** (b - 1) / (1 + a * d2**b), 0.0)
            y[i] += alpha * np.clip(pull[:, None] * diff, -CLIP, CLIP)
            for _ in range(negatives if len(pool) else 0):
                near = rng.random(len(i)) < own
                diff = y[i] - np.where(near[:, None], y[rng.integers(0, len(y), len(i))], pool[rng.integers(0, len(pool), len(i))])
                d2 = (diff * diff).sum(axis=1)
                push = np.where(d2 > 1e-12, 2 * b / ((REPEL + d2) * (1 + a * d2**b)), 0.0)
                y[i] += alpha * np.clip(push[:, None] * diff, -CLIP, CLIP)
    return y


def layout(edges: DataFrame, start: DataFrame, fixed: DataFrame | None, *, min_dist: float, rounds: int, epochs: int, alpha: float = 1.0, negatives: int = 5, pool_rows: int = 4096, seed: int = 42) -> DataFrame:
    """(id, y) after ``rounds`` x ``epochs`` epochs.

    ``edges``: head, tail, w; ``start``: id, block, y of the heads; ``fixed``: id, y of tails that
    don't move, if they are not the heads themselves.  A round deals heads and edges to blocks;
    within one, tails of the same block move along, others stand where the round before left them.  The
    driver holds ``pool_rows`` positions, picked anew each round, that push.
    """
    a, b = curve(min_dist)
    total = rounds * epochs
    top = edges.agg(F.max("w")).first()[0] or 1.0
    known = edges.where(F.col("w") >= top / total).join(start.select(F.col("id").alias("head"), "block"), "head")
    known = written(known.select("block", "head", "tail", (F.col("w") / top).alias("p")), "layout-edges")
    now = written(start.select("id", "block", "y"), "layout")
    n = now.count()
    for r in range(rounds):
        stand = now.select("id", "y") if fixed is None else fixed.select("id", "y")
        pool = np.array([x.y for x in stand.orderBy(F.xxhash64("id", F.lit(seed * 1000 + r)), "id").limit(pool_rows).collect()], np.float64)
        alphas = [alpha * (1 - (r * epochs + e) / total) for e in range(epochs)]
        inside = fixed is None

        def run(key, heads, links):  # sent at once, within this round
            if not len(heads):
                return pd.DataFrame({"id": pd.Series([], dtype="int64"), "block": pd.Series([], dtype="int32"), "y": pd.Series([], dtype=object)})
            heads = heads.sort_values("id")
            links = links.sort_values(["head", "tail"])
            ids = heads["id"].to_numpy()
            y = np.stack(heads["y"].to_numpy()).astype(np.float64)
            if len(links):
                h, t = np.searchsorted(ids, links["head"].to_numpy()), links["tail"].to_numpy()
                at = np.minimum(np.searchsorted(ids, t), len(ids) - 1)
                at = np.where((ids[at] == t) & inside, at, -1)
                y = descend(y, h, at, np.stack(links["ty"].to_numpy()).astype(np.float64), links["p"].to_numpy(), pool, a, b, alphas, negatives, np.random.default_rng([seed, int(key[0]), r]), len(ids) / n if inside else 0.0)
            return pd.DataFrame({"id": ids, "block": heads["block"].to_numpy(np.int32), "y": list(y)})

        placed = known.join(stand.select(F.col("id").alias("tail"), F.col("y").alias("ty")), "tail").select("block", "head", "tail", "p", "ty")
        now = written(now.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(run, "id long, block int, y array<double>"), "layout")
    return now.select("id", "y")


def _points(df: DataFrame, key: str, vector: str, cosine: bool) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), (normalise(x) if cosine else x).alias("x"), F.lit(1.0).alias("w"))


def _metric(near: DataFrame, cosine: bool) -> DataFrame:
    """Of unit vectors, half the squared distance is 1 - cosine; neighbours and their order are the same."""
    return near.withColumn("dist", F.col("dist") * F.col("dist") / 2) if cosine else near


def reduce_manifold(df: DataFrame, key: str, vector: str, dims: int = 8, *, k: int = 15, min_dist: float = 0.1, cosine: bool = True, share: float = 0.5, rounds: int = 20, epochs: int = 10, block_rows: int = 1024, seed: int = 42) -> DataFrame:
    """(key, reduced array<double> of ``dims``) by uniform manifold approximation and projection.

    A ``share`` of the rows, by hash of the key, is fitted: exact neighbours, memberships, fuzzy union, and a
    layout that starts from principal components.  The others are placed in blocks: each starts at
    the mean of its ``k`` nearest fitted rows, by membership, and is moved while those stand.  ``key`` is a long, unique;
    rows without key or finite vector are left out; equal vectors are neighbours at distance 0.
    """
    points = written(_points(df, key, vector, cosine), "manifold-points")
    chosen = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else F.lit(True)
    fit = points.where(chosen)
    if fit.limit(2).count() < 2:
        fit, chosen = points, F.lit(True)
    if fit.limit(2).count() < 2:
        return points.select(F.col("id").alias(key), F.array(*[F.lit(0.0)] * dims).alias("reduced"))
    space = blocks(fit, block_rows=block_rows)
    near = _metric(neighbours(space, k - 1), cosine)
    graph = written(fuzzy_graph(memberships(near, k)), "fuzzy-graph")
    base = reduce_dimensions(fit, "x", min(dims, len(fit.first().x))).select("id", "reduced")
    top = base.agg(F.max(F.array_max(F.transform("reduced", F.abs)))).first()[0] or 1.0
    noise = lambda j: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j)), F.lit(1 << 16)) / (1 << 16) - 0.5) * 1e-3
    coords = F.array(*(F.coalesce(F.get("reduced", F.lit(j)), F.lit(0.0)) * (10 / top) + noise(j) for j in range(dims)))
    block_of = space.rows.select("block", "ids").mapInPandas(_ids, "block int, id long")
    start = base.select("id", coords.alias("y")).join(block_of, "id")
    edges = graph.select(F.col("a").alias("head"), F.col("b").alias("tail"), "w").union(graph.select("b", "a", "w"))
    made = layout(edges, start, None, min_dist=min_dist, rounds=rounds, epochs=epochs, seed=seed)
    if share < 1:
        made = made.union(place(points.where(~chosen), space, made, k, cosine=cosine, min_dist=min_dist, seed=seed))
    return made.select(F.col("id").alias(key), F.col("y").alias("reduced"))


def place(queries: DataFrame, space: Blocks, made: DataFrame, k: int, *, cosine: bool, min_dist: float, rounds: int = 3, epochs: int = 10, seed: int = 42) -> DataFrame:
    """(id, y) of rows beside a finished layout of the points of ``space``."""
    near = _metric(neighbours_of(queries, space, k), cosine)
    w = written(memberships(near, k), "placing")
    mean = w.join(made.select(F.col("id").alias("other"), "y"), "other").select("id", "w", F.posexplode("y").alias("j", "v"))
    mean = mean.groupBy("id", "j").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    start = mean.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("l")).select("id", F.transform("l", lambda x: x["v"]).alias("y"))
    start = start.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, len(space.centres)))).cast("int"))
    return layout(w.select(F.col("id").alias("head"), F.col("other").alias("tail"), "w"), start, made, min_dist=min_dist, rounds=rounds, epochs=epochs, alpha=0.25, seed=seed)


def _ids(frames):
    for f in frames:
        for block, ids in zip(f["block"], f["ids"], strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pd.DataFrame({"block": np.full(len(ids), block, np.int32), "id": ids})


def trustworthiness(df: DataFrame, key: str, vector: str, reduced: str, k: int = 10) -> float:
    """1 less the share of false neighbours in the reduction, by their true ranks.  Compares every row with all: a measure for samples."""
    rows = df.orderBy(key).select(vector, reduced).collect()
    x, y = (np.array([r[j] for r in rows], np.float64) for j in (0, 1))
    n = len(rows)
    true, near = (((v[:, None] - v[None]) ** 2).sum(axis=2) for v in (x, y))
    for m in (true, near):
        np.fill_diagonal(m, np.inf)
    rank = true.argsort(axis=1).argsort(axis=1) + 1
    got = near.argsort(axis=1)[:, :k]
    over = np.maximum(np.take_along_axis(rank, got, 1) - k, 0).sum()
    return float(1 - 2 * over / (n * k * (2 * n - 3 * k - 1)))
