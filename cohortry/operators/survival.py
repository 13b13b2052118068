"""Survival: proportional hazards with Efron's ties and an elastic penalty, concordance, and censoring weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import written


def _ranges(df: DataFrame, col: str, most: int) -> list[float]:
    """Cuts of a column into at most ``most`` ranges of about equal numbers of rows."""
    found = df.stat.approxQuantile(col, [i / most for i in range(1, most)], 0.25 / most) if most > 1 else []
    return sorted(set(found))


def _range_of(col: str, cuts: Sequence[float]):
    """Which range a value is in: how many cuts lie below it (a table of cuts, found by one pass of pandas)."""
    at = np.array(cuts)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, v.to_numpy(), side="left").astype(np.int32))

    return place(F.col(col))


def penalised_cox(df: DataFrame, cols: Sequence[str], time: str, event: str, *, penalty: float = 0.0, l1_ratio: float = 1.0, iterations: int = 50, tolerance: float = 1e-9, ranges: int = 64) -> dict:
    """Proportional hazards: the mean log partial likelihood (Efron) less penalty x (l1_ratio |b| + (1 - l1_ratio) / 2 b^2), of standardised columns.

    A step is proximal Newton: rows are added up by time (partial aggregates, so a time that very many
    rows share is a row a task), times lie in ``ranges``; the totals of the ranges give each range the
    sums of all later times, and each returns its share of likelihood, gradient and curvature.  The driver holds a row of
    sums a range, never one a time.  Coordinate descent solves the quadratic model; a step is halved until the
    penalised likelihood does not fall.  Scores are shifted by their mean, so exp can't overflow for standardised
    columns of moderate effect.  Returns coefficients of the given columns, the log likelihood and the steps taken.
    """
    d = len(cols)
    raw = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols))).dropna()
    m = raw.agg(F.count("*"), *(F.avg(f"x{i}") for i in range(d)), *(F.stddev_samp(f"x{i}") for i in range(d))).first()
    n, mean = m[0], np.array(m[1 : 1 + d], np.float64)
    scale = np.array([s if s else 1.0 for s in m[1 + d :]], np.float64)
    cuts = _ranges(raw, "t", ranges)
    rows = written(raw.select("t", "e", *(((F.col(f"x{i}") - F.lit(float(mean[i]))) / F.lit(float(scale[i]))).alias(f"x{i}") for i in range(d))).withColumn("range", _range_of("t", cuts)), "survival")
    places = [(i, j) for i in range(d) for j in range(i, d)]
    width = 1 + d + len(places)

    def moments(beta: np.ndarray) -> DataFrame:
        score = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        w = F.exp(score)
        kinds = [w, *(F.col(f"x{i}") * w for i in range(d)), *(F.col(f"x{i}") * F.col(f"x{j}") * w for i, j in places)]
        sums = [F.sum(k).alias(f"r{i}") for i, k in enumerate(kinds)] + [F.sum(F.col("e") * k).alias(f"d{i}") for i, k in enumerate(kinds)]
        return rows.groupBy("range", "t").agg(F.sum("e").alias("m"), F.sum(F.col("e") * score).alias("s"), *(F.sum(F.col("e") * F.col(f"x{i}")).alias(f"v{i}") for i in range(d)), *sums)

    def likelihood(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        at = written(moments(beta), "risk-sets")
        totals = {r["range"]: np.array([r[f"r{i}"] for i in range(width)]) for r in at.groupBy("range").agg(*(F.sum(f"r{i}").alias(f"r{i}") for i in range(width))).collect()}
        later, run = {}, np.zeros(width)
        for k in sorted(totals, reverse=True):
            later[k] = run
            run = run + totals[k]

        def share(key, f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("t", ascending=False)
            risk = np.cumsum(f[[f"r{i}" for i in range(width)]].to_numpy(), axis=0) + later[int(key[0])]
            dead, count = f[[f"d{i}" for i in range(width)]].to_numpy(), f["m"].to_numpy()
            total = efron(risk, dead, count, d, places)
            total[0] += f["s"].sum()
            total[1 : 1 + d] += f[[f"v{i}" for i in range(d)]].to_numpy().sum(axis=0)
            return pd.DataFrame({"v": [total]})

        parts = at.groupBy("range").applyInPandas(share, "v array<double>").collect()  # a row a range
        total = np.sum([np.array(r.v) for r in parts], axis=0)
        h = np.zeros((d, d))
        for v, (i, j) in zip(total[1 + d :], places, strict=True):
            h[i, j] = h[j, i] = v
        return float(total[0]), total[1 : 1 + d], h

    def goal(ll: float, b: np.ndarray) -> float:
        return ll / n - penalty * (l1_ratio * np.abs(b).sum() + (1 - l1_ratio) / 2 * (b @ b))

    beta, steps = np.zeros(d), 0
    ll, grad, hess = likelihood(beta)
    for steps in range(1, iterations + 1):
        new = _descend(beta, grad / n, hess / n, penalty * l1_ratio, penalty * (1 - l1_ratio))
        size, now = 1.0, goal(ll, beta)
        while True:
            trial = beta + size * (new - beta)
            found = likelihood(trial)
            if goal(found[0], trial) >= now - 1e-12 or size < 1e-4:
                break
            size /= 2
        moved = goal(found[0], trial) - now
        beta, (ll, grad, hess) = trial, found
        if moved < tolerance:
            break
    return {"coefficients": dict(zip(cols, (beta / scale).tolist(), strict=True)), "log_likelihood": ll, "steps": steps, "means": dict(zip(cols, mean.tolist(), strict=True))}


def efron(risk: np.ndarray, dead: np.ndarray, count: np.ndarray, d: int, places: Sequence[tuple[int, int]]) -> np.ndarray:
    """Minus the risk sets' part of log likelihood and gradient, and the curvature, of some times (rows).

    Of m deaths at a time, the l-th sees the risk set less l / m of those who die.
    """
    out = np.zeros(1 + d + len(places))
    ii, jj = (np.array([p[k] for p in places], np.int64) for k in (0, 1))
    for r, x, m in zip(risk, dead, count.astype(np.int64).tolist(), strict=True):
        s = np.zeros(6)  # log(phi), 1/phi, a/phi, 1/phi^2, a/phi^2, a^2/phi^2
        for lo in range(0, m, 1 << 16):
            a = np.arange(lo, min(m, lo + (1 << 16))) / m
            phi = r[0] - a * x[0]
            s += [np.log(phi).sum(), (1 / phi).sum(), (a / phi).sum(), (1 / phi**2).sum(), (a / phi**2).sum(), (a * a / phi**2).sum()]
        out[0] -= s[0]
        r1, x1 = r[1 : 1 + d], x[1 : 1 + d]
        out[1 : 1 + d] -= r1 * s[1] - x1 * s[2]
        square = r1[ii] * r1[jj] * s[3] - (r1[ii] * x1[jj] + x1[ii] * r1[jj]) * s[4] + x1[ii] * x1[jj] * s[5]
        out[1 + d :] += r[1 + d :] * s[1] - x[1 + d :] * s[2] - square
    return out


def _descend(beta: np.ndarray, grad: np.ndarray, hess: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The largest value of the quadratic model less l1 |b| + l2 / 2 b^2, one coordinate at a time."""
    b = beta.copy()
    for _ in range(1000):
        before = b.copy()
        for j in range(len(b)):
            h = hess[j, j] + 1e-12
            slope = grad[j] - hess[j] @ (b - beta) + h * b[j]
            b[j] = np.sign(slope) * max(abs(slope) - l1, 0.0) / (h + l2)
        if np.abs(b - before).max(initial=0) < 1e-12:
            break
    return b


def censoring_weights(df: DataFrame, time: str, event: str, *, ranges: int = 64) -> DataFrame:
    """(t, g): for each time, the chance (Kaplan-Meier) of not being censored before it.

    Times lie in ranges: each range gives the product of its own factors, and these products give the others where they start.
    """
    raw = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e")).dropna()
    cuts = _ranges(raw, "t", ranges)
    by = written(raw.groupBy("t").agg(F.count("*").alias("n"), F.sum(1 - F.col("e")).alias("c")).withColumn("range", _range_of("t", cuts)), "times")
    size = {r["range"]: r.n for r in by.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row a range
    later, run = {}, 0
    for k in sorted(size, reverse=True):
        later[k] = run
        run += size[k]

    def factors(f: pd.DataFrame, k: int) -> pd.DataFrame:
        f = f.sort_values("t")
        risk = f["n"].to_numpy()[::-1].cumsum()[::-1] + later[k]
        # who dies at a time is no longer at risk of being censored there
        safe = np.maximum(risk - (f["n"] - f["c"]).to_numpy(), 1)
        return f.assign(f=1 - f["c"].to_numpy() / safe)

    first = by.groupBy("range").applyInPandas(lambda key, f: pd.DataFrame({"range": [int(key[0])], "p": [factors(f, int(key[0]))["f"].prod()]}), "range int, p double").collect()
    start, p = {}, 1.0
    for r in sorted(first, key=lambda r: r["range"]):
        start[r["range"]] = p
        p *= r.p

    def chances(key, f: pd.DataFrame) -> pd.DataFrame:
        x = factors(f, int(key[0]))
        before = np.concatenate(([1.0], x["f"].to_numpy().cumprod()[:-1])) * start[int(key[0])]
        return pd.DataFrame({"t": x["t"], "g": before})

    return by.groupBy("range").applyInPandas(chances, "t double, g double")


def concordance(df: DataFrame, time: str, event: str, score: str, *, weighted: bool = False, ranges: int = 64) -> dict:
    """Of the pairs in which one is known to have its event first, the share in which it has the higher score (ties count half).

    ``weighted``: pairs weigh 1 / g^2, g the chance that the first one is not censored before its time.

    Rows that agree in time, event and score are one with a count.  Times and scores lie in ranges, a grid whose counts
    give all pairs of different ranges in both; pairs of one range of times, or of one range of scores but different
    times' ranges, are counted inside tasks by sorting.  No pair is listed, and the driver holds the grid.
    """
    cols = [F.col(time).cast("double").alias("t"), (F.col(event).cast("double") > 0).cast("int").alias("e"), F.col(score).cast("double").alias("s")]
    raw = df.select(*cols).dropna().groupBy("t", "e", "s").agg(F.count("*").cast("double").alias("n"))
    raw = written(raw, "concordance")
    tc, sc = _ranges(raw, "t", ranges), _ranges(raw, "s", ranges)
    rows = raw.withColumn("i", _range_of("t", tc)).withColumn("j", _range_of("s", sc))
    rows = rows.withColumn("w", F.col("n") * F.col("e"))
    if weighted:
        g = censoring_weights(df, time, event, ranges=ranges).withColumnRenamed("t", "gt")
        rows = rows.join(g, F.col("t") == F.col("gt"), "left").withColumn("w", F.col("w") / F.pow("g", 2)).drop("g", "gt")
    rows = written(rows, "concordance")
    grid = np.zeros((2, len(tc) + 1, len(sc) + 1))
    for r in rows.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect():  # ranges x ranges
        grid[:, r.i, r.j] = r.n, r.w
    after = np.cumsum(grid[0][::-1], axis=0)[::-1] - grid[0]  # later ranges of time
    lower = np.cumsum(after, axis=1) - after
    higher = after.sum(axis=1, keepdims=True) - lower - after
    good, bad, even = float((grid[1] * lower).sum()), float((grid[1] * higher).sum()), 0.0

    def same_times(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [_pairs(*(f[c].to_numpy() for c in ("t", "e", "s", "n", "w")), None)]})

    def same_scores(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [_pairs(*(f[c].to_numpy() for c in ("t", "e", "s", "n", "w")), f["i"].to_numpy())]})

    for by, job in (("i", same_times), ("j", same_scores)):
        for r in rows.groupBy(by).applyInPandas(job, "v array<double>").collect():  # a row a range
            good, bad, even = good + r.v[0], bad + r.v[1], even + r.v[2]
    total = good + bad + even
    return {"concordance": (good + even / 2) / total if total else 0.5, "concordant": good, "discordant": bad, "tied": even}


def _pairs(t: np.ndarray, e: np.ndarray, s: np.ndarray, n: np.ndarray, w: np.ndarray, far: np.ndarray | None) -> list[float]:
    """Weights of concordant, discordant and tied pairs: a row with an event against rows that last longer (the same time without event counts as longer).

    ``far``: only rows of a larger number there count.  From the last time back, counts by score stand in a binary indexed tree.
    """
    rank = np.unique(s, return_inverse=True)[1] + 1
    size = int(rank.max(initial=0))
    tree = np.zeros(size + 1)

    def add(i: int, v: float) -> None:
        while i <= size:
            tree[i] += v
            i += i & -i

    def upto(i: int) -> float:
        out = 0.0
        while i:
            out += tree[i]
            i -= i & -i
        return out

    key = t if far is None else far.astype(np.float64)
    late = (1 - e) if far is None else np.zeros(len(e))
    order = np.lexsort((-late, -key))  # last times first; at one time, those without event first
    good = bad = even = seen = 0.0
    k = 0
    while k < len(order):
        stop = k
        while stop < len(order) and key[order[stop]] == key[order[k]] and late[order[stop]] == late[order[k]]:
            stop += 1
        for i in order[k:stop]:
            if w[i] > 0:
                below, at = upto(rank[i] - 1), upto(rank[i])
                good += w[i] * below
                even += w[i] * (at - below)
                bad += w[i] * (seen - at)
        for i in order[k:stop]:
            add(int(rank[i]), float(n[i]))
            seen += float(n[i])
        k = stop
    return [good, bad, even]
