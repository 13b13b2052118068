"""Candidate groups of every size, equal doc_ids and null doc_ids, against brute force."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import partenum

R = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(3000)]


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if root[a] != root[b] and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            hi, lo = max(root[a], root[b]), min(root[a], root[b])
            root = [lo if r == hi else r for r in root]
    name = {}
    for (i, _), r in zip(rows, root):
        name[r] = min([x for x in (name.get(r), i) if x is not None], default=None)
    return sorted(((i, len(s), name[r]) for (i, _), s, r in zip(rows, sets, root)), key=str)


def edited(words, n):
    out = list(words)
    for k in R.integers(0, len(out), n):
        out[k] = str(R.choice(WORDS))
    return out


def corpus():
    """Near copies with one to eight edits of a text (many just under the threshold), texts around one passage, equal doc_ids, nulls."""
    base, passage = list(R.choice(WORDS, 200)), list(R.choice(WORDS, 60))
    rows = [(i, " ".join(edited(base, 1 + i % 8))) for i in range(1, 120)]
    for i in range(200, 290):
        rows.append((i, " ".join([*R.choice(WORDS, 20 + i % 7), *passage, *R.choice(WORDS, 20)])))
    for i in range(300, 330):  # one doc_id with two texts, each with a near copy
        a, b = list(R.choice(WORDS, 90)), list(R.choice(WORDS, 90))
        rows += [(5, " ".join(a)), (5, " ".join(b)), (i, " ".join(edited(a, 1))), (i + 100, " ".join(edited(b, 1)))]
    lone = list(R.choice(WORDS, 80))
    rows += [(None, " ".join(lone)), (None, " ".join(edited(lone, 1))), (None, " ".join(edited(base, 1))), (None, None), (None, ""), (600, None), (600, None)]
    return rows


ROWS = corpus()


@pytest.mark.parametrize("unit", [(4096, 1 << 21), (16, 4000)])
def test_all_links_whatever_the_unit(spark, unit):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("row", F.lit(0))
    got = partenum.jaccard_rows(df, unit_sets=unit[0], unit_shingles=unit[1])
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept", "row"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute(ROWS)
    kept = {(r.doc_id, r.row) for r in rows if r.kept and r.n_shingles}
    assert len(kept) == len({r.component_id for r in rows if r.n_shingles and r.component_id is not None and r.component_id != 5}) + len({r.row for r in rows if r.kept and r.n_shingles and r.component_id in (5, None)})
    assert all(r.doc_id == r.component_id for r in rows if r.kept)


def test_many_near_copies_make_few_rows(spark):
    base = list(R.choice(WORDS, 300))
    rows = [(i, " ".join(edited(base, 2))) for i in range(5000)]
    got = partenum.jaccard_rows(spark.createDataFrame(rows, "doc_id long, text string"), unit_sets=1000)
    assert got.where("component_id <> 0").count() == 0 and got.where("kept").count() == 1


def test_sketches_never_exceed_the_difference():
    for n in (3, 40, 700):
        a = R.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[: n - n // 3], R.integers(0, 2**63, n).astype(np.uint64)))
        odd = partenum.Sketches([partenum.sketch(a), partenum.sketch(b)]).differ(np.array([0]), np.array([1]))[0]
        assert odd <= len(np.setxor1d(a, b))


def test_repeated_rows_are_grouped_once(spark, monkeypatch):
    """100,000 equal rows and two near copies: what goes to the tasks that compare is a row for each task and text."""
    from pyspark.sql import functions as F

    from cohortry.llm import partenum
    from cohortry.llm.common import saved

    text = " ".join(f"w{i}" for i in range(60))
    copies = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    near = spark.createDataFrame([(3, text + " more"), (9, text + " other"), (None, None)], "doc_id long, text string")
    seen = {}

    def counted(df, name):
        out = saved(df, name)
        seen.setdefault(name, out.count())
        return out

    monkeypatch.setattr(partenum, "saved", counted)
    docs = copies.union(near).repartition(6)
    got = partenum.jaccard_rows(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept, r["count"]) for r in got) == [(0, None, True, 1), (3, 3, True, 1), (7, 3, False, 100_000), (9, 3, False, 1)]
    assert seen["grouped"] <= 6 + 2


def test_turns_share_the_signatures():
    """Each turn has a part of the signatures of every set, and together they have all, each once."""
    t = partenum.Fraction(4, 5)
    for n in (1, 3, 10, 57, 200, 1000):
        own = partenum.arrays.mix64(np.arange(n, dtype=np.uint64))
        every = np.sort(partenum.set_signatures(own, t))
        turns = [partenum.set_signatures(own, t, k) for k in range(partenum.TURNS)]
        assert np.array_equal(np.sort(np.concatenate(turns)), every)
        if n >= 57:
            assert max(map(len, turns)) < 0.7 * len(every)


def test_sketches_go_only_where_signatures_are_shared(spark):
    """Large groups of texts around one passage: a set is dealt with the few signatures that another set has too, whatever the number of its own."""
    import pyarrow as pa

    t, passage = partenum.Fraction(4, 5), list(R.choice(WORDS, 60))
    texts = [" ".join([*R.choice(WORDS, 100), *passage, *R.choice(WORDS, 40)]) for _ in range(40)]
    flat, off = partenum.shingle_sets(*partenum.arrays.buffers(pa.array(texts)))
    keys = partenum.set_keys(flat, off)
    batch = pa.record_batch({"text": texts, "node": np.arange(40), "ka": keys[:, 0], "kb": keys[:, 1]})
    every, sent, marks = 0, [], []
    for turn in range(partenum.TURNS):
        rows = pa.Table.from_batches(partenum._emit_large(t, 5, 8, turn)([batch]))
        for b in range(8):
            part = rows.filter(pa.compute.equal(rows["bucket"], b))
            if len(part):
                every += sum(len(x) for x in part["sigs"].to_pylist()) // 8
                got = partenum._shared_signatures(part).to_pylist()
                marks += [(r["node"], r["n"], r["mark"]) for r in got if r["mark"] is not None]
                sent += [(int(s), r["node"]) for r in got if r["sigs"] for s in np.frombuffer(r["sigs"], np.uint64)]
    want = {}
    for k in range(40):
        for s in partenum.set_signatures(flat[off[k] : off[k + 1]], t).tolist():
            want.setdefault(s >> 16 << 16, set()).add(k)
    assert set(sent) == {(s, k) for s, own in want.items() if len(own) > 1 for k in own} and len(sent) == len(set(sent))
    assert 0 < len(sent) < every / 5
    assert sorted(marks) == [(k, int(off[k + 1] - off[k]), partenum.sketch(flat[off[k] : off[k + 1]]).tobytes()) for k in range(40)]
