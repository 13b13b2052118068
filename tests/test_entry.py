import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = sorted(entry._queries.ORACLE_SQL)
OTHERS = sorted(set(entry._queries.QUERIES) - set(SQL))
#: Tested at length elsewhere.
SLOW = {"emb_01_document_vectors", "emb_04_manifold", "emb_05_density_clusters", "ml_08_second_order", "ml_06_leaf_limited_forest"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    cols = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in cols]
    norm = lambda v: v if v is None or isinstance(v, (str, bool)) else round(float(v), 6) + 0.0
    # sums of doubles in another order may round to the next digit
    order = lambda row: (str(tuple(v if v is None or isinstance(v, (str, bool)) else f"{v:.4g}" for v in row)), str(row))
    b = sorted((tuple(norm(r[i]) for i in place) for r in want.fetchall()), key=order)
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == cols
    a = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=order)
    if a != b:
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for u, v in zip(x, y):
                assert u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-5, abs_tol=2e-6), (x, y)


@pytest.mark.parametrize("name", [n for n in OTHERS if n not in SLOW])
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert len(df.columns) > 0 and df.count() >= 0


def test_names_are_taken_once():
    from cohortry.plans.registry import query

    with pytest.raises(ValueError):
        query(SQL[0])(lambda t: None)
