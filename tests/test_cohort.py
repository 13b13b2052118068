import pytest
from pyspark.sql import functions as F

from cohortry.functions import scalars as S
from cohortry.operators import cohort as C
from cohortry.operators import features as X
from cohortry.operators import frames as R
from cohortry.operators import models as M
from cohortry.operators import tagging as G
from cohortry.operators import text as T
from cohortry.operators import topics as P


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_time_weight(spark):
    df = spark.createDataFrame([(-5,), (0,), (100,), (365,), (730,)], "t long")
    assert [r.w for r in df.select(S.time_weight(F.col("t")).alias("w")).collect()] == [0.5, 0.5, 0.5685, 0.75, 1.0]


def test_acceleration(spark):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("a", 40), ("b", 1), ("b", 2), ("c", 5), ("c", 5), ("c", 5)], "pid string, t long")
    got = {r.pid: r.acceleration for r in X.acceleration(df).collect()}
    assert got["a"] == pytest.approx(6.061667, abs=1e-6) and got["b"] == 0 and got["c"] == 0


def test_band_censor_follow_up(spark):
    df = spark.createDataFrame([(1000,), (180,), (179,), (1001,)], "d long")
    assert [r.k for r in df.select(C.in_band(F.col("d"), F.lit(1000)).alias("k")).collect()] == [True, True, False, False]
    df = spark.createDataFrame([(909,), (910,)], "d long")
    assert [r.k for r in df.select(C.not_censored(F.col("d"), F.lit(1000)).alias("k")).collect()] == [True, False]
    df = spark.createDataFrame([(17270,), (17269,)], "d long")
    assert [r.k for r in df.select(C.in_follow_up(F.col("d"), F.lit(18000), 14610).alias("k")).collect()] == [True, False]


def test_keys_and_codes(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a long, b long")
    assert [r.k for r in df.select(S.key("a", "b").alias("k")).collect()] == ["1|<NA>", "2|3"]
    df = spark.createDataFrame([("K74.01",), ("K75",), (None,)], "c string")
    assert [r.k for r in df.select(G.has_code(["c"], "K74").alias("k")).collect()] == [True, False, False]
    assert one(spark, S.atc_level(F.lit("C03CA01"))) == "C03C___"
    assert one(spark, S.parse_icpc(F.lit("zie k77.01 nu"))) == "K77.01" and one(spark, S.parse_icpc(F.lit("K00"))) is None
    assert one(spark, S.parse_atc(F.lit("c03ca01"))) == "C03CA01"
    assert one(spark, S.html_unescape(F.lit("a &amp;lt; b"))) == "a < b"
    assert R.period_name(0, 730) == "0_24" and R.period_name(730, 820) == "24_27"


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        (G.HEART_FAILURE, ["hartfalen", "Thartfalen", "hey dit is Hartfalen"], ["falen", "angst voor hartfalen", "a angst voor hartfalen", "geen hartfalen", "Angst voor bananen"]),
        (G.AF, ["atrium f", "atriumf", "atrium   f", "Natrium f", "fibr", "fibra", "as980ry8932w04b6 jto04fibrsed opter09m-oyt", "Angst  afibrali"], ["atrium  lepel f", "Angst voor fibr", "fibro"]),
        (G.VHD, ["aklep", "i like valv", "Mitrialis", "aortak", "aorta   koo", "insufficient vespine gas", "stenorka"], ["Angst voor stenorka", "stent"]),
    ],
)
def test_clinical_patterns(spark, pattern, yes, no):
    df = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no] + [(None, False)], "t string, want boolean")
    assert [r.t for r in df.where(G.matches("t", pattern) != F.col("want")).collect()] == []


def test_negation(spark):
    df = spark.createDataFrame([("geen koorts hoest".split(),), ("hoest neg".split(),), ("goede conditie".split(),), ("conditie geen goed".split(),)], "tok array<string>")
    df = T.bind_modifiers(df, "tok", neg_prefix=["geen"], pos_prefix=["goede"], neg_suffix=["neg"])
    assert [" ".join(r.tok) for r in df.collect()][:3] == ["koorts_NEG hoest", "hoest_NEG", "conditie_POS"]


def test_cluster_shares(spark):
    df = spark.createDataFrame([("A", y) for y in (1, 0, 0, 0)] + [("B", y) for y in (1, 1, 0, 0)], "c string, y int")
    got = {r.c: (r.incidence, r.mass, round(r.support, 4)) for r in R.cluster_shares(df, "c", "y").collect()}
    assert got == {"A": (0.25, 0.5, 0.5556), "B": (0.5, 0.5, 1.6667)}


def test_lift_aic_knee_prune(spark):
    df = spark.createDataFrame([(0.0,), (0.6,), (1.0,)], "v double")
    assert [round(r.v, 6) for r in R.lift_scores(df, ["v"]).collect()] == [0.0, 0.2, 1.0]
    assert R.aic(-2, 100, 5) == 410 and round(R.bic(-2, 100, 5), 4) == 423.0259
    assert R.knee([10, 4, 2, 1.5, 1.2, 1]) == 2
    assert R.redundant_categories(["a_0", "a_1", "b"]) == ["a_1"]
    assert [round(float(x), 4) for x in P.combined_query([[1, 0], [0, 1]], [[0, 0]])] == [0.7071, 0.7071]


def test_nest_and_merge(spark):
    p = spark.createDataFrame([(1,), (2,)], "k long")
    c = spark.createDataFrame([(1, 5, "x"), (1, 3, "y")], "k long, d long, v string")
    got = {r.k: [x.d for x in r.cs] for r in C.nest(p, c, "k", "cs", ["d"]).collect()}
    assert got == {1: [3, 5], 2: []}
    with pytest.raises(ValueError, match="share"):
        C.merge_disjoint(p, p, "k")


def test_mixture_increases(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(float(rng.normal(m, 1)), float(rng.normal(-m, 1)), float(rng.random() < 0.2 + 0.1 * m)) for m in (0, 6) for _ in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    m = M.mixed_mixture(df, ["a", "b"], ["c"], 2, iterations=12)
    assert all(y >= x - 1e-6 for x, y in zip(m["history"], m["history"][1:]))
    df = df.withColumn("k", F.monotonically_increasing_id())
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in M.posterior(df, m, ["a", "b"], ["c"], "k").collect())


def test_topics_reduce():
    import numpy as np

    v = np.array([[1, 0], [0.99, 0.14], [0, 1]])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups, _ = P.deduplicate([0, 1, 2], v)
    assert groups == [[0, 1], [2]]
    assert sorted(map(sorted, P.reduce_topics(v, [5, 1, 5], 2)[1])) == [[0, 1], [2]]
