"""Models: mixture clustering, importance, stepwise selection, embeddings, reductions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import aic, bic
from .neighbours import written


def assembled(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def gaussian_grid(df: DataFrame, cols: Sequence[str], counts: Sequence[int], seed: int = 222, iterations: int = 50) -> list[dict]:
    """Gaussian mixtures over a grid of cluster counts, with AIC and BIC, best AIC first."""
    x = assembled(df, cols).select("features").cache()
    n, d = x.count(), len(cols)
    out = []
    for k in counts:
        m = GaussianMixture(k=k, seed=seed, maxIter=iterations).fit(x)
        p = k - 1 + k * d + k * d * (d + 1) // 2
        ll = m.summary.logLikelihood / n
        out.append({"k": k, "aic": aic(ll, n, p), "bic": bic(ll, n, p), "model": m})
    x.unpersist()
    return sorted(out, key=lambda r: r["aic"])


def mixed_mixture(df: DataFrame, numeric: Sequence[str], binary: Sequence[str], k: int, *, iterations: int = 50, tolerance: float = 1.0, seed: int = 222) -> dict:
    """EM for full-covariance Gaussians of numeric and Bernoullis of binary columns.

    Each iteration is one pass over a narrow table, written once: tasks add up the sufficient statistics
    of their rows, Spark adds these up place by place, and the driver gets one number a place.
    """
    d, b = len(numeric), len(binary)
    cols = [*numeric, *binary]
    narrow = written(df.select(*(F.col(c).cast("double") for c in cols)).dropna(), "mixture")
    first = narrow.orderBy(F.xxhash64(F.lit(seed), *cols)).limit(max(50 * k, 200)).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    mu = first[rng.permutation(len(first))[:k], :d].copy()
    cov = np.stack([np.cov(first[:, :d].T).reshape(d, d) + 1e-6 * np.eye(d)] * k)
    q = np.clip(np.stack([first[:, d:].mean(axis=0)] * k) + rng.uniform(-0.1, 0.1, (k, b)), 0.05, 0.95)
    pi, last, history = np.full(k, 1 / k), -np.inf, []
    for _ in range(iterations):
        par = (pi, mu, cov, q)

        def run(frames, par=par):
            total = 0.0
            for f in frames:
                x = f.to_numpy(np.float64)
                if not len(x):
                    continue
                lp = log_density(x, par, d)
                top = lp.max(axis=1, keepdims=True)
                r = np.exp(lp - top)
                ll = (top[:, 0] + np.log(r.sum(axis=1))).sum()
                r /= r.sum(axis=1, keepdims=True)
                s2 = np.einsum("nk,ni,nj->kij", r, x[:, :d], x[:, :d])
                total = total + np.concatenate([[ll, len(x)], r.sum(axis=0), (r.T @ x).ravel(), s2.ravel()])
            if np.ndim(total):
                yield pd.DataFrame({"s": [total]})

        sums = narrow.mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        total = np.array([r.v for r in sums.orderBy("i").collect()])
        ll, n = float(total[0]), int(total[1])
        w = total[2 : 2 + k]
        s1 = total[2 + k : 2 + k + k * (d + b)].reshape(k, d + b)
        s2 = total[2 + k + k * (d + b) :].reshape(k, d, d)
        w = np.maximum(w, 1e-9)
        pi, mu = w / w.sum(), s1[:, :d] / w[:, None]
        cov = s2 / w[:, None, None] - np.einsum("ki,kj->kij", mu, mu) + 1e-6 * np.eye(d)
        q = np.clip(s1[:, d:] / w[:, None], 1e-6, 1 - 1e-6)
        history.append(ll)
        if abs(ll - last) < tolerance:
            break
        last = ll
    free = k - 1 + k * d + k * d * (d + 1) // 2 + k * b
    return {"weights": pi, "means": mu, "covariances": cov, "probabilities": q, "history": history, "aic": float(aic(history[-1] / n, n, free)), "bic": float(bic(history[-1] / n, n, free))}


def log_density(x: np.ndarray, par: tuple, d: int) -> np.ndarray:
    pi, mu, cov, q = par
    out = np.empty((len(x), len(pi)))
    for j in range(len(pi)):
        low = np.linalg.cholesky(cov[j])
        z = np.linalg.solve(low, (x[:, :d] - mu[j]).T)
        out[:, j] = np.log(pi[j]) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
        y = x[:, d:]
        out[:, j] += (y * np.log(q[j]) + (1 - y) * np.log(1 - q[j])).sum(axis=1)
    return out


def posterior(df: DataFrame, model: dict, numeric: Sequence[str], binary: Sequence[str], key: str) -> DataFrame:
    """(key, cluster, probability array) of every row."""
    par, d = (model["weights"], model["means"], model["covariances"], model["probabilities"]), len(numeric)
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            lp = log_density(f[[*numeric, *binary]].to_numpy(np.float64), par, d)
            r = np.exp(lp - lp.max(axis=1, keepdims=True))
            r /= r.sum(axis=1, keepdims=True)
            yield pd.DataFrame({key: f[key], "cluster": r.argmax(axis=1).astype(np.int32), "probability": list(r)})

    return df.select(key, *(F.col(c).cast("double").alias(c) for c in (*numeric, *binary))).mapInPandas(run, f"{key} {kind}, cluster int, probability array<double>")


def importance(df: DataFrame, cols: Sequence[str], label: str, *, trees: int = 100, depth: int = 5, seed: int = 42, boosted: bool = False) -> list[tuple[str, float]]:
    """Columns by falling importance in a forest (or boosted trees), classes weighted to balance."""
    n = df.agg(F.avg(F.col(label).cast("double")).alias("p")).first().p
    x = assembled(df, cols).withColumn("_w", F.when(F.col(label) == 1, 0.5 / max(n, 1e-9)).otherwise(0.5 / max(1 - n, 1e-9))).withColumn("_y", F.col(label).cast("double"))
    est = GBTClassifier(labelCol="_y", maxDepth=depth, maxIter=min(trees, 20), seed=seed, weightCol="_w") if boosted else RandomForestClassifier(labelCol="_y", numTrees=trees, maxDepth=depth, minInstancesPerNode=10, seed=seed, weightCol="_w")
    return sorted(zip(cols, est.fit(x).featureImportances.toArray().tolist(), strict=True), key=lambda r: -r[1])


def cross_validated_auc(df: DataFrame, cols: Sequence[str], label: str, fold: str, k: int = 4, l1: float = 0.0) -> list[float]:
    x = assembled(df, cols).withColumn("_y", F.col(label).cast("double"))
    ev = BinaryClassificationEvaluator(labelCol="_y")
    return [ev.evaluate(LogisticRegression(labelCol="_y", regParam=l1, elasticNetParam=1.0).fit(x.where(F.col(fold) != i)).transform(x.where(F.col(fold) == i))) for i in range(k)]


def stepwise(df: DataFrame, cols: Sequence[str], label: str, *, backward: bool = True, family: str = "binomial") -> list[tuple[list[str], float]]:
    """Stepwise selection by AIC, one column a round: the column sets tried best, with their AIC."""

    from .selection import fitted

    def fit(own: Sequence[str]) -> float:
        return fitted(df, own, label, family)["aic"]

    now = list(cols) if backward else []
    out = [(now, fit(now))]
    while True:
        near = [[c for c in now if c != d] for d in now] if backward else [[*now, c] for c in cols if c not in now]
        near = [n for n in near if n]
        if not near:
            return out
        best = min(((n, fit(n)) for n in near), key=lambda r: r[1])
        if best[1] >= out[-1][1]:
            return out
        now = best[0]
        out.append(best)


def word_vectors(docs: DataFrame, tok: str, size: int = 300, least: int = 5, seed: int = 42, iterations: int = 1):
    """Word embedding; a document's vector is the mean of its words'."""
    return Word2Vec(inputCol=tok, outputCol="vector", vectorSize=size, minCount=least, seed=seed, maxIter=iterations).fit(docs)


def reduce_dimensions(df: DataFrame, vector: str, k: int = 8) -> DataFrame:
    """Principal components of an array column."""
    x = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(x).transform(x).withColumn("reduced", vector_to_array("_p")).drop("_v", "_p")
