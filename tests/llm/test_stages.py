"""Stages of the pipeline and the text operators on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cohortry.llm import imatch, langid, ngram, pieces, quality, repeats
from cohortry.llm.common import saved

R = np.random.default_rng(9)
EN = "the and house over nice with then some other words that people say".split()
DE = "der die und schön über haus mit dann einige andere wörter die leute".split()
LONG = " ".join(R.choice(EN, 200_000))  # a megabyte
PASSAGE = "zwölf boxkämpfer jagen viktor quer über den großen sylter deich � wirklich"
EXTRA = ["size", "words", "taken", "target", "draws", "own", "score", "lang_pred", "_letter", "d", "k", "h", "key", "cut", "row", "kept", "shard", "epoch", "predicted", "pieces", "n_tokens", "_t", "_b"]


def rows():
    R = np.random.default_rng(9)
    out = []
    for i in range(1, 40):
        out.append((i, " ".join(R.choice(EN if i % 2 else DE, 40 + i)), "en" if i % 2 else "de", f"s{i % 3}", 0))
    out += [out[0], out[0], (1, "another text " + out[4][1], "en", "s1", 0), (100, out[2][1], None, None, 0), (101, out[2][1] + " more", "en", "s0", 0)]
    out += [(200, None, "en", "s0", None), (201, "", None, "s0", 0), (202, " \t\n ", "de", None, 0), (203, "12 34 !", "en", "s1", 0), (None, "der text ohne nummer und die leute sagen dann", "de", "s2", 0), (None, None, None, None, None)]
    out += [(300, "ä" * 30 + PASSAGE + "x" * 30, "de", "s0", 0), (301, "wörter " + PASSAGE + " � ende", "de", "s0", 0), (302, "kein � passiert", "de", "s1", 0), (400, LONG, "en", "s2", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    return saved(df.withColumns({c: F.lit(i) for i, c in enumerate(EXTRA)}), "stage-docs")


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage(spark, docs, name):
    stage = dict(P.STAGES)[name]
    got = saved(stage(spark, docs, ""), name)
    none = saved(stage(spark, docs.where("false"), ""), name)
    assert none.count() == 0 and none.columns == got.columns
    if name in ("language_id", "near_duplicates", "mix_sources"):
        assert got.columns == docs.columns and got.where(" or ".join(f"`{c}` <> {i}" for i, c in enumerate(EXTRA))).count() == 0
    if name == "repeated_passages":
        assert got.columns == P.COLUMNS
    out = got.select("doc_id", *(["text", "n_chars"] if "text" in got.columns else [])).collect()
    if name == "language_id":
        assert Counter(r.doc_id for r in out) == Counter(i for i, t, *_ in rows() if any(c.isalpha() for c in t or ""))
        assert got.where("lang is null").count() == 0
    if name == "near_duplicates":
        n = Counter(r.doc_id for r in out)
        assert n[100] == 0 and n[101] == 0 and n[1] == 2 and n[3] == 1 and all(n[i] == 1 for i in (200, 201, 202, 203, 400))
    if name == "repeated_passages":
        text = {}
        for r in out:
            assert r.n_chars == len(r.text) > 0
            text.setdefault(r.doc_id, []).append(r.text)
        assert len(text[1]) == 4 and 200 not in text and 201 not in text
        assert text[302] == ["kein � passiert"] and PASSAGE in text[300][0] and text[301] == ["wörter  � ende"]
    if name == "mix_sources":
        size = Counter()
        for i, t, *_ in rows():
            size[i] += len((t or "").split())
        taken = Counter()
        for r in out:
            assert r.n_chars == len(r.text) and r.text.split()
            taken[r.doc_id] += len(r.text.split())
        assert all(taken[i] <= 2 * size[i] for i in taken) and sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.34)
    if name == "encode_pieces":
        assert got.where("not exact").count() == 0 and got.count() == len(rows())


def test_marks_decode(spark):
    texts = ["▁\U0010ffff", "x▁y\U0010ffffz", "▁", "a ▁ b", "\U0010ffff", " ▁▁ \U0010fffe"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = pieces.decode(pieces.encode(df, "text", verify=True), "pieces").collect()
    assert all(r.exact and r.decoded == r.text for r in out)


def test_operators_replace_columns_they_add(spark, docs):
    small = docs.where("doc_id < 20")
    assert langid.predict(small, langid.train(small)).columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    labels = small.select("doc_id", (F.col("lang") == "en").cast("int").alias("label"))
    scored = quality.score(docs, quality.train(docs, labels))
    assert scored.columns[-2:] == ["score", "predicted"] and scored.count() == docs.count() and scored.where("score is null or not score between 0 and 1").count() == 0
    model = ngram.train(small.select("text"))
    assert ngram.score(docs, model).where("score is null or score >= 0").count() == 0
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fp = imatch.with_fingerprint(d, F.col("text"), imatch.lookup(imatch.lexicon(d)), "fp")
    assert fp.where("fp is null").count() == 0 and fp.where("text = ''").select("fp").distinct().count() == 1
    once = repeats.remove_repeats(docs, as_text=True)
    assert once.groupBy("doc_id", "text_md5").count().where("count > 1").count() == 0
    assert repeats.remove_repeats(docs).count() == docs.count()
