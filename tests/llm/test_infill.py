import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from cohortry.llm import infill
from cohortry.llm.queries import op12_fill_in_middle

DIR = "/root/testdata/sf0.001"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def expected(i, text):
    t = text or ""
    n, h = len(t), sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = op12_fill_in_middle(spark, DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        n, form, a, m, out = expected(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, m, sha(out), sha(docs[r.doc_id]))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    texts = [None, "", "a", "<P> here", "x<S", "a<", "<M", "😀é\n\r z" * 50, "same", "same", "q" * 1_000_000]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "without id", "c", 1), (8, "same", "clash", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    found = df.select("*", infill.fill_in_middle(F.col("text"), F.col("doc_id")).alias("x")).collect()
    assert len(found) == len(rows)
    for r in found:
        n, form, a, m, out = expected(r.doc_id, r.text)
        assert (r.x.n, r.x.form, r.x.prefix_chars, r.x.middle_chars, r.x.output) == (n, form, a, m, out)
        assert r.x.restored_sha256 == sha(r.text or "") and infill.restore(out, form) == (r.text or "")
    assert df.where("false").select(infill.fill_in_middle(F.col("text"), F.col("doc_id"))).count() == 0


def test_bytes_that_are_not_text(spark):
    df = spark.sql("select 5L as doc_id, cast(x'41ff42c3' as string) as text")
    r = df.select(infill.fill_in_middle(F.col("text"), F.col("doc_id")).alias("x")).first().x
    assert r.n == 4 and r.restored_sha256 == hashlib.sha256(bytes.fromhex("41ff42c3")).hexdigest()


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_restore_beside_markers(form):
    for text in ["<P", "<S<S", "a<M", "<", ">", "P>", "<<<", "S><P"]:
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                p, m, s = text[:a], text[a:b], text[b:]
                out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
                assert infill.restore(out, form) == text


def test_units():
    words = regex.compile(r"\w+\W*")
    text = "  one two, three"
    assert list(infill.unit_ends(text, words)) == [6, 11, 16]
    for k in range(40):
        n, form, a, m, out = infill.cut(text, str(k), words, infill.Markers(), 1, 100, 50)
        assert n == 3 and infill.restore(out, form) == text
    with pytest.raises(ValueError):
        infill.Markers("<P>", "<P>x", "<M>")
