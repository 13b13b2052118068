"""Topic words come from all vectors, 50 a topic, as the SQL says."""

import duckdb

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_all_vectors_can_be_words(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["top_05_all_topic_words"]).fetchall())
    got = sorted(map(tuple, entry.queries()["top_05_all_topic_words"](spark, FOLDER).collect()))
    assert got == want and max(v for _, v in got) >= 50


def test_weights_of_all_documents(spark):
    """The SQL of top_10_patient_topics sums the weights of all documents, also of those whose best score is below 0."""
    from cohortry.operators import topics

    df = spark.createDataFrame([(1, 0, 0.5, 1.0), (1, 0, -0.1, 0.2)], "pid int, topic int, score double, w double")
    all_, some = (topics.patient_topics(df, "pid", "score", "w", 1, positive=p).first() for p in (False, True))
    assert (round(all_.twdit, 6), all_.dit) == (1.2, 2.0) and (round(some.twdit, 6), some.dit) == (1.0, 1.0)
