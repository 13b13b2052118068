import pytest
from pyspark.sql import functions as F

from cohortry.functions import scalars as S
from cohortry.functions import tables


@pytest.mark.parametrize(("length", "overlap"), [(5, 0.2), (4, 0.0), (3, 0.9), (1, 0.5)])
def test_chunks_as_from_arrays(spark, length, overlap):
    tables.register(spark)
    texts = [(i, [f"w{j}" for j in range(n)]) for i, n in enumerate([0, 1, 4, 5, 6, 9, 10, 11, 500])]
    docs = spark.createDataFrame(texts, "id long, tok array<string>").repartition(3)
    rows = docs.select("id", F.posexplode_outer("tok").alias("place", "token")).orderBy(F.rand(1))
    got = spark.sql(f"select * from token_chunks(table({{rows}}) partition by id order by (place), {length}, {overlap}D)", rows=rows)
    want = docs.select("id", F.posexplode(S.chunks(F.col("tok"), length, overlap)).alias("chunk", "tokens"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chunks_of_nothing(spark):
    tables.register(spark)
    rows = spark.createDataFrame([], "id long, place int, token string")
    assert spark.sql("select * from token_chunks(table({rows}) partition by id order by (place), 5, 0.2D)", rows=rows).count() == 0
    rows = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (2, 0, None)], "id long, place int, token string")
    got = spark.sql("select * from token_chunks(table({rows}) partition by id order by (place), 5, 0.2D)", rows=rows)
    assert sorted(map(tuple, got.collect())) == [(1, 0, ["a"]), (2, 0, [])]


def test_flat_days(spark):
    tables.register(spark)
    n = spark.createDataFrame([(1, [(5, "x"), (7, None)]), (2, []), (3, None)], "id int, j array<struct<day: long, flag: string>>")
    got = spark.sql("select id, day, flag from {n}, lateral flat_days(j)", n=n)
    assert sorted(map(str, got.collect())) == ["Row(id=1, day=5, flag='x')", "Row(id=1, day=7, flag=None)"]


@pytest.mark.parametrize("run", [1, 3, 7, 1000])
def test_chunks_of_runs_of_tokens(spark, run):
    """Rows of several tokens, nulls among them, as rows of one."""
    tables.register(spark)
    texts = [(i, [f"w{j}" if j % 5 else None for j in range(n)]) for i, n in enumerate([0, 1, 6, 11, 60])]
    rows = [(i, p, tok[p : p + run]) for i, tok in texts for p in range(0, max(1, len(tok)), run)] + [(9, 0, None)]
    df = spark.createDataFrame(rows, "id long, place int, tokens array<string>").repartition(3)
    got = spark.sql("select * from token_chunks(table({df}) partition by id order by (place), 5, 0.2D)", df=df)
    docs = spark.createDataFrame([*((i, [w for w in tok if w]) for i, tok in texts), (9, [])], "id long, tok array<string>")
    want = docs.select("id", F.posexplode(S.chunks(F.col("tok"), 5, 0.2)).alias("chunk", "tokens"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
