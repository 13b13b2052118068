"""The first stage where no language was learned."""

import corpus_pipeline as P


def test_nothing_learned(spark):
    rows = [(1, "a clean text", None, "s", 12), (2, "123 456", None, "s", 7), (3, None, None, "s", 0), (4, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.language_id(spark, docs, "").collect()
    assert [(r.doc_id, r.lang) for r in got] == [(1, "und")]
