"""Clinical patterns against another regex engine, over beginnings and endings that deny, doubt, fear or ask."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from cohortry.operators import tagging as G
from cohortry.plans import q_clinical as Q


def says(pattern, text):
    if isinstance(pattern, str):
        return re.search(pattern, text, re.I) is not None
    op, *parts = pattern
    got = [says(p, text) for p in parts]
    return not got[0] if op == "not" else all(got) if op == "and" else any(got)


MORE = ["dec. cordis", "d.d. dec cordis", "vochtophoping aan de benen", "geen dikke enkels", "opgezwollen enkels", "kort van adem", "adem te kort", "cardio miopathie", "pbf", "abfib", "Natrium f?", "aorta  klepstenose?", "mitralis?", "valvulair ?", "geen benauwdheid", "drukkend gevoel", "beklemmend", "fibroom en fibrilleren"]


@pytest.mark.parametrize("name", list(Q.PATTERNS))
def test_patterns(spark, name):
    texts = ["".join(x) for x in itertools.product(Q.BEFORE, [x for x, _, _ in Q.TERMS], Q.AFTER)] + MORE
    df = spark.createDataFrame([(x,) for x in texts] + [(None,)], "t string")
    got = {r.t for r in df.where(G.matches("t", Q.PATTERNS[name])).collect()}
    assert got == {x for x in texts if says(Q.PATTERNS[name], x)} and got


def test_examples(spark):
    df = spark.createDataFrame([("niet hartfalen",), ("verdenking hartfalen",), ("hartfalen?",), ("geen koorts, wel hartfalen",), ("cardiomyopathie",), ("decompensatio cordis",)], "t string")
    assert [r.k for r in df.select(G.matches("t", G.HEART_FAILURE).alias("k")).collect()] == [False, False, False, True, True, True]


def test_codes(spark):
    assert len(G.RISK_FACTORS) == 14 and len(G.RISK_COEFFICIENTS) == 16 and set(G.RISK_COEFFICIENTS) == {"decades_age", "male", *G.RISK_FACTORS}
    df = spark.createDataFrame([(1, "U99.01"), (2, "U99"), (3, "K84.03"), (4, "R91.1"), (4, None)], "p long, code string")
    got = {r.p: r for r in G.risk_flags(df, "p", "code", {**G.RISK_FACTORS, **G.OUTCOMES}).collect()}
    assert got[1].chronic_kidney_disease and not got[2].chronic_kidney_disease and got[3].HF and got[4].copd and not got[4].HF
