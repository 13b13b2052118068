"""Model selection: mixture grids and their class weights, nested mixtures, stepwise rounds by p-value or AIC with fold AUCs, picks by family, singular vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from .frames import bic, knee, max_abs
from .models import assembled, cross_validated_auc, mixed_mixture, posterior

# The grid of cluster counts.
CLUSTER_COUNTS = tuple(range(3, 30))


def mixture_grid(df: DataFrame, numeric: Sequence[str], binary: Sequence[str], counts: Sequence[int] = CLUSTER_COUNTS, **options) -> list[dict]:
    """Mixed mixtures over a grid of cluster counts, highest -AIC first; each has k, aic, bic and the model."""
    out = [{"k": k, "model": (m := mixed_mixture(df, numeric, binary, k, **options)), "aic": m["aic"], "bic": m["bic"]} for k in counts]
    return sorted(out, key=lambda r: (r["aic"], r["k"]))


def class_weights(df: DataFrame, label: str) -> dict[int, float]:
    """Weight of each class so that all weigh alike: rows / (classes x rows of the class)."""
    n = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}  # a row a class
    return {k: sum(n.values()) / (len(n) * v) for k, v in n.items()}


def captured_share(shares: Sequence[tuple[float, float]], ratio: float = config.HIGH_RISK_RATIO) -> tuple[int, float]:
    """How many clusters, by falling incidence, together stay at ``ratio`` times the base incidence, and the share of all positives they hold.

    shares: (incidence, mass) of each cluster.
    """
    base = sum(i * m for i, m in shares) / (sum(m for _, m in shares) or 1.0)
    mass = positive = held = 0.0
    taken = 0
    for i, m in sorted(shares, reverse=True):
        mass, positive = mass + m, positive + i * m
        if mass == 0 or positive / mass < base * ratio:
            break
        taken, held = taken + 1, positive
    return taken, held / base if base else 0.0


def nested_mixture(df: DataFrame, key: str, first: Sequence[tuple[Mapping, Sequence[str], Sequence[str], str]], extra: Sequence[str], counts: Sequence[int], **options) -> tuple[DataFrame, list[dict]]:
    """A second mixture on the hard labels of first ones: a dummy for each cluster but the last of each model, and the ``extra`` binary columns.

    first: (model, numeric, binary, name) of each; returns the table with dummies ``c<i>_<name>`` and the grid.
    """
    table, dummies = df, []
    for model, numeric, binary, name in first:
        labels = posterior(df, model, numeric, binary, key).select(F.col(key).alias("_k"), F.col("cluster").alias("_c"))
        own = [f"c{i}_{name}" for i in range(len(model["weights"]) - 1)]
        table = table.join(labels, F.col(key) == F.col("_k"))
        table = table.withColumns({c: (F.col("_c") == i).cast("double") for i, c in enumerate(own)}).drop("_k", "_c")
        dummies += own
    grid = [{"k": k, "model": (m := mixed_mixture(table, [], [*extra, *dummies], k, **options)), "aic": m["aic"], "bic": m["bic"]} for k in counts]
    return table, sorted(grid, key=lambda r: (r["aic"], r["k"]))


def fitted(df: DataFrame, cols: Sequence[str], label: str, family: str) -> dict:
    """AIC, BIC, R2, adjusted R2 and p-value of each column of a generalised linear model; no columns: the intercept alone."""
    y = F.col(label).cast("double")
    if not cols:
        r = df.agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")).first()
        if family == "binomial":
            ll = r.n * sum(p * math.log(p) for p in (r.m, 1 - r.m) if p > 0)
            return {"aic": -2 * ll + 2, "bic": -2 * ll + math.log(r.n), "r2": 0.0, "adjr2": 0.0, "p": {}}
        ll = -0.5 * r.n * (math.log(2 * math.pi * max(r.v, 1e-300)) + 1)
        return {"aic": -2 * ll + 4, "bic": bic(ll / r.n, r.n, 1), "r2": 0.0, "adjr2": 0.0, "p": {}}
    model = GeneralizedLinearRegression(family=family, labelCol="_y", maxIter=25).fit(assembled(df.withColumn("_y", y), cols))
    s = model.summary
    n, k = s.numInstances, len(cols)
    free = k + 1 + (family != "binomial")
    r2 = 1 - s.deviance / s.nullDeviance if s.nullDeviance else 0.0
    return {"aic": s.aic, "bic": s.aic - 2 * free + math.log(n) * (k + 1), "r2": r2, "adjr2": 1 - (1 - r2) * (n - 1) / max(1, n - k - 1), "p": dict(zip(cols, s.pValues, strict=False))}


def stepwise_by_p(df: DataFrame, cols: Sequence[str], label: str, *, backward: bool = False, family: str = "gaussian", guard: str | None = "aic", level: float = 0.05) -> list[tuple[list[str], dict]]:
    """Rounds of stepwise selection by p-value, each with its fit.

    Forward: the column with the smallest p-value comes in while that is at most ``level``;
    backward: the one with the largest goes out while that is above it.  ``guard`` (aic, bic,
    r2, adjr2 or None) ends the rounds where a step makes that measure worse.
    """
    better = (lambda a, b: True) if guard is None else (lambda a, b: a[guard] < b[guard]) if guard in ("aic", "bic") else (lambda a, b: a[guard] > b[guard])
    now = list(cols) if backward else []
    out = [(now, fitted(df, now, label, family))]
    while True:
        if backward:
            worst = max(now, key=lambda c: out[-1][1]["p"][c], default=None)
            if worst is None or out[-1][1]["p"][worst] <= level:
                return out
            step = [c for c in now if c != worst]
            fit = fitted(df, step, label, family)
        else:
            tries = [([*now, c], fitted(df, [*now, c], label, family), c) for c in cols if c not in now]
            if not tries:
                return out
            step, fit, new = min(tries, key=lambda t: t[1]["p"][t[2]])
            if fit["p"][new] > level:
                return out
        if not better(fit, out[-1][1]):
            return out
        now = step
        out.append((now, fit))


def backward_logistic(df: DataFrame, cols: Sequence[str], label: str, fold: str, k: int = 4, family_of: Callable[[str], str] = lambda c: c.split("_")[0]) -> list[dict]:
    """Backward selection by AIC on all rows, one column a round; of each round the mean and deviation of the fold AUCs and how many columns each family has."""

    def row(own: list[str], fit: dict) -> dict:
        auc = cross_validated_auc(df, own, label, fold, k)
        families: dict[str, int] = {}
        for c in own:
            families[family_of(c)] = families.get(family_of(c), 0) + 1
        return {"columns": own, "aic": fit["aic"], "auc_mean": float(np.mean(auc)), "auc_sd": float(np.std(auc)), "families": families}

    now = list(cols)
    fit = fitted(df, now, label, "binomial")
    out = [row(now, fit)]
    while len(now) > 1:
        tries = [(own, fitted(df, own, label, "binomial")) for own in ([c for c in now if c != d] for d in now)]
        own, new = min(tries, key=lambda t: t[1]["aic"])
        if new["aic"] >= fit["aic"]:
            break
        now, fit = own, new
        out.append(row(now, fit))
    return out


def smoothed_knee(values: Sequence[float], width: int = 5) -> int:
    """Knee of falling values after a moving mean of ``width`` (no padding): half way between the knee of all and that of the first half up to it, which sees no tail."""
    v = np.convolve(values, np.ones(width) / width, mode="valid") if len(values) >= width else np.array(values, float)
    late = knee(v.tolist())
    early = knee(v[: max(3, 2 * late + 1)].tolist())
    return (late + early) // 2


def pick_by_family(ranked: Sequence[tuple[str, float]], family_of: Callable[[str], str], least: int = 10, width: int = 5) -> list[str]:
    """Columns up to the knee of their importances, and of each family its best ``least`` at any rate, in the order of importance."""
    upto = smoothed_knee([x for _, x in ranked], width) + 1
    have: dict[str, int] = {}
    out = []
    for i, (c, _) in enumerate(ranked):
        n = have.get(family_of(c), 0)
        if i < upto or n < least:
            out.append(c)
            have[family_of(c)] = n + 1
    return out


def grid_auc(df: DataFrame, cols: Sequence[str], label: str, fold: str, kind: str = "logistic", grid: Mapping[str, Sequence] | None = None, k: int = 4, seed: int = 42) -> list[dict]:
    """Mean fold AUC of a classifier (logistic with L1, tree, or perceptron) for each point of a parameter grid, best first."""
    x = assembled(df, cols).withColumn("_y", F.col(label).cast("double"))
    made = {
        "logistic": lambda p: LogisticRegression(labelCol="_y", elasticNetParam=1.0, **p),
        "tree": lambda p: DecisionTreeClassifier(labelCol="_y", seed=seed, **p),
        "perceptron": lambda p: MultilayerPerceptronClassifier(labelCol="_y", seed=seed, **{"layers": [len(cols), 8, 2], **p}),
    }[kind]
    points = [{}]
    for name, values in (grid or {}).items():
        points = [{**p, name: v} for p in points for v in values]
    ev = BinaryClassificationEvaluator(labelCol="_y")
    out = []
    for p in points:
        auc = [ev.evaluate(made(p).fit(x.where(F.col(fold) != i)).transform(x.where(F.col(fold) == i))) for i in range(k)]
        out.append({"parameters": p, "auc_mean": float(np.mean(auc)), "auc_sd": float(np.std(auc))})
    return sorted(out, key=lambda r: -r["auc_mean"])


def singular_scores(df: DataFrame, key: str, cols: Sequence[str], k: int = 100) -> tuple[DataFrame, np.ndarray]:
    """(key, scores) of the first ``k`` right singular vectors of a block scaled by its largest absolute values (not centred), and the singular values.

    Tasks return one Gram matrix a batch, columns x columns, summed in a partial aggregate on
    the driver; rows are projected where they are.
    """
    scaled, _ = max_abs(df, cols)
    scaled = scaled.select(key, *cols)

    def gram(frames):
        total = np.zeros((len(cols), len(cols)))
        for f in frames:
            x = np.nan_to_num(f[list(cols)].to_numpy(np.float64))
            total += x.T @ x
        yield pd.DataFrame({"g": [total.ravel()]})

    g = np.sum([np.array(r.g) for r in scaled.mapInPandas(gram, "g array<double>").collect()], axis=0).reshape(len(cols), -1)  # a matrix a task
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)[: min(k, len(cols))]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    kind = df.schema[key].dataType.simpleString()

    def project(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "scores": list(np.nan_to_num(f[list(cols)].to_numpy(np.float64)) @ vectors)})

    return scaled.mapInPandas(project, f"{key} {kind}, scores array<double>"), np.sqrt(np.maximum(values[order], 0))


def cox(df: DataFrame, cols: Sequence[str], time: str, event: str, *, ridge: float = 0.0, iterations: int = 25, tolerance: float = 1e-8) -> dict:
    """Proportional hazards by Newton steps on the partial likelihood (Breslow's ties).

    Each step is one aggregate: for every distinct time the sums of exp(xb), x exp(xb) and
    xx' exp(xb) of the rows that end there.  The driver holds a row a time; risk sets are its
    running sums from the last time back.  Returns coefficients, their errors, the log
    likelihood and the baseline hazard by time.
    """
    d = len(cols)
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols))).dropna()
    beta, last = np.zeros(d), -math.inf
    places = [(i, j) for i in range(d) for j in range(i, d)]
    for _ in range(iterations):
        score = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        w = F.exp(score)
        sums = [F.sum(w), F.sum("e"), F.sum(F.col("e") * score)]
        sums += [F.sum(F.col(f"x{i}") * w) for i in range(d)] + [F.sum(F.col(f"x{i}") * F.col("e")) for i in range(d)]
        sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}") * w) for i, j in places]
        got = rows.groupBy("t").agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).collect()
        s = np.array(sorted(tuple(r) for r in got), np.float64).reshape(len(got), len(sums) + 1)
        risk = np.cumsum(s[::-1, 1:], axis=0)[::-1]  # of all rows that end at a time or later
        events, total = s[:, 2], risk[:, 0]
        mean = risk[:, 3 : 3 + d] / total[:, None]
        second = np.zeros((len(s), d, d))
        for k, (i, j) in enumerate(places):
            second[:, i, j] = second[:, j, i] = risk[:, 3 + 2 * d + k] / total
        likelihood = s[:, 3].sum() - (events * np.log(total)).sum() - 0.5 * ridge * beta @ beta
        gradient = s[:, 4 + d : 4 + 2 * d].sum(axis=0) - (events[:, None] * mean).sum(axis=0) - ridge * beta
        hessian = (events[:, None, None] * (second - mean[:, :, None] * mean[:, None, :])).sum(axis=0) + ridge * np.eye(d)
        if abs(likelihood - last) < tolerance:
            break
        last = likelihood
        beta = beta + np.linalg.solve(hessian + 1e-12 * np.eye(d), gradient)
    return {"coefficients": dict(zip(cols, beta.tolist(), strict=True)), "errors": np.sqrt(np.diag(np.linalg.inv(hessian))).tolist(), "log_likelihood": float(likelihood), "baseline": list(zip(s[:, 0].tolist(), (events / total).tolist(), strict=True))}
