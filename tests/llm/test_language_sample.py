"""The sample is the lowest hashes of a language, and few rows reach its window."""

from pyspark.sql import functions as F

from cohortry.llm import langid


def test_threshold_comes_before_the_window(spark, monkeypatch):
    rows = [(f"text {i}", "en") for i in range(3000)] + [("the same", "de")] * 300 + [("fr", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").cache()
    seen, lowest = [], langid._lowest
    monkeypatch.setattr(langid, "_lowest", lambda r, n: seen.append(r.where("lang = 'en'").count()) or lowest(r, n))
    texts, langs = langid.sample(df, per_lang=20, most_chars=100)
    assert seen[0] < 200
    want = df.where("lang = 'en'").orderBy(F.xxhash64(F.lit(3), "text", "lang"), "text").limit(20)
    assert [t for t, n in zip(texts, langs) if n == "en"] == [r.text for r in want.collect()]
    assert langs.count("de") == 20 and langs.count("fr") == 1
