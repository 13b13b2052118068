import numpy as np
import pytest

from cohortry.operators import survival as S


def sample(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 2, n), rng.normal(size=n) * 3], axis=1)
    t = np.ceil(rng.exponential(np.exp(-(0.8 * x[:, 0] + 0.5 * x[:, 1]))) * 20)  # many ties
    c = np.ceil(rng.uniform(1, 60, n))
    return x, np.minimum(t, c), (t <= c).astype(float)


def frame(spark, x, t, e):
    return spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, t, e)], "a double, b double, c double, t double, e double")


def efron(x, t, e, beta):
    """Log likelihood, gradient and curvature, one death after the other."""
    w = np.exp(x @ beta)
    ll, g, h = 0.0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
    for at in np.unique(t[e == 1]):
        risk, dead = t >= at, (t == at) & (e == 1)
        m = int(dead.sum())
        ll += (x[dead] @ beta).sum()
        g += x[dead].sum(axis=0)
        for k in range(m):
            v = w * risk - k / m * w * dead
            ll -= np.log(v.sum())
            mean = v @ x / v.sum()
            g -= mean
            h += (x * v[:, None]).T @ x / v.sum() - np.outer(mean, mean)
    return ll, g, h


@pytest.mark.parametrize("penalty", [0.0, 0.05])
def test_cox(spark, penalty):
    x, t, e = sample()
    got = S.penalised_cox(frame(spark, x, t, e), ["a", "b", "c"], "t", "e", penalty=penalty, ranges=7)
    sd = x.std(axis=0, ddof=1)
    z, n = (x - x.mean(axis=0)) / sd, len(t)
    beta = np.array([got["coefficients"][c] for c in "abc"]) * sd
    ll, g, _ = efron(z, t, e, beta)
    assert abs(ll - got["log_likelihood"]) < 1e-6
    # the conditions of an optimum: the slope is the penalty's where a coefficient is not zero, and within it where it is
    g /= n
    if penalty:
        assert beta[2] == 0 and abs(g[2]) <= penalty + 1e-9
        assert np.allclose(g[:2], penalty * np.sign(beta[:2]), atol=1e-5)
    else:
        assert np.abs(g).max() < 1e-5


def km_censoring(t, e):
    out, g = {}, 1.0
    for at in np.unique(t):
        out[at] = g
        risk = (t >= at).sum() - ((t == at) & (e == 1)).sum()
        g *= 1 - ((t == at) & (e == 0)).sum() / max(risk, 1)
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_concordance(spark, weighted):
    x, t, e = sample(300)
    x[:, 0] = np.round(x[:, 0], 1)
    got = S.concordance(frame(spark, x, t, e), "t", "e", "a", weighted=weighted, ranges=6)
    g = km_censoring(t, e)
    good = bad = even = 0.0
    for i in range(len(t)):
        if e[i]:
            v = 1 / g[t[i]] ** 2 if weighted else 1.0
            for j in range(len(t)):
                if t[j] > t[i] or t[j] == t[i] and not e[j]:
                    good += v * (x[i, 0] > x[j, 0])
                    bad += v * (x[i, 0] < x[j, 0])
                    even += v * (x[i, 0] == x[j, 0])
    assert np.allclose([got["concordant"], got["discordant"], got["tied"]], [good, bad, even])
    assert abs(got["concordance"] - (good + even / 2) / (good + bad + even)) < 1e-9
    if weighted:
        w = {r.t: r.g for r in S.censoring_weights(frame(spark, x, t, e), "t", "e", ranges=5).collect()}
        assert w.keys() == g.keys() and all(abs(w[k] - g[k]) < 1e-9 for k in g)


def test_empty(spark):
    df = frame(spark, *sample(5)).where("false")
    assert S.concordance(df, "t", "e", "a")["concordance"] == 0.5
