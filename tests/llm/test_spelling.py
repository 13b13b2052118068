import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from cohortry.llm import spelling
from cohortry.llm.queries import op13_spelling

DIR = "/root/testdata/sf0.001"


def brute(docs):
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    n = {w: c for w, c in count.items() if c >= 2}
    by = defaultdict(set)
    for w in n:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            for b in group:
                if a != b and (len(a) != len(b) or sum(x != y for x, y in zip(a, b)) == 1) and abs(len(a) - len(b)) <= 1:
                    near[a].add(b)
    out = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        out[w] = (c, best if best and n[best] >= 10 * c else None, len(near[w]), n[best] if best and n[best] >= 10 * c else None)
    full = {}
    for w, (c, form, k, fn) in out.items():
        root = w
        while out[root][1]:
            root = out[root][1]
        full[w] = (c, form, root, k, fn)
    return full


def got(df):
    rows = df.collect()
    found = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    want = brute(docs)
    assert got(op13_spelling(spark, DIR)) == want
    assert sum(v[1] is not None for v in want.values()) > 0


def test_odd_rows(spark):
    """Runs of equal letters, ties, chains of forms, nulls, a run of 200,000 letters, equal rows, clashing names."""
    base = ["committee"] * 400 + ["commitee"] * 30 + ["comitee"] * 2 + ["committees"] * 30 + ["Committée"] * 3 + ["aaaaaaa"] * 50 + ["aaaaaaaa"] * 5 + ["aaaabaaa"] * 2
    ties = ["abcdefgh"] * 40 + ["abcdefgx"] * 40 + ["abcdefgy"] * 2 + ["xbcdefgy"] * 2 + ["×÷×÷×÷×÷"] * 3
    rows = [(k, w, "w", k) for k, w in enumerate(base + ties)]
    rows += [(None, None, None, None), (5, "", "x", 1), (None, "without identity without identity", "x", 1)] + [(9, "repeated repeated", "a", 2)] * 3
    long = "".join("abcdefghijklmnopqrstuvwxyz"[(i * i) % 23] for i in range(200_000))
    rows += [(10_000 + k, long, "l", 0) for k in range(3)] + [(20_000 + k, long[:150_000] + long[150_001:], "l", 0) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    assert got(spelling.spelling_forms(df)) == brute_long(rows, long)
    assert spelling.spelling_forms(df.where("false")).count() == 0


def brute_long(rows, long):
    """Brute force, long words by a plain comparison."""
    short = brute([(i, t) for i, t, *_ in rows if t is None or len(t) < 1000])
    count = Counter()
    for i, t, *_ in rows:
        if t and len(t) >= 1000:
            h = zlib.crc32(f"{i}:{t}".encode())
            count[t[: h % len(t)] + t[h % len(t) + 1 :] if h % 31 == 0 else t] += 1
    words = {w: c for w, c in count.items() if c >= 2}
    near = lambda a, b: len(a) != len(b) and abs(len(a) - len(b)) == 1 and any_deletion(*sorted((a, b), key=len)) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    for w, c in words.items():
        k = sum(near(w, x) for x in words if x != w)
        short[w] = (c, None, w, k, None)
    return short


def any_deletion(a, b):
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return b[:i] + b[i + 1 :] == a


def test_keys():
    words = ["abcdefg", "aabbccd", "zzzzzzz", "ÿabcdef"]
    key, row, place = spelling.deletion_keys(pa.array(words))
    by = defaultdict(set)
    for k, r, p in zip(key.tolist(), row.tolist(), place.tolist()):
        w = words[r]
        by[k].add((p if p > 0 else 0, w if p == 0 else w[: abs(p) - 1] + w[abs(p) :]))
    assert all(len(v) == 1 for v in by.values())
    whole = spelling.deletion_keys(pa.array(["abcdefgh", "bcdefgh"]))
    own = {int(k) for k, r, p in zip(*whole) if r == 1 and p == 0}
    assert own <= {int(k) for k, r, p in zip(*whole) if r == 0 and p < 0}
    assert np.sum((row == 2) & (place < 0)) == 1


def test_collisions_end_on_strings(spark, monkeypatch):
    """With keys of four bits nearly all collide; the result stays."""
    docs = spark.createDataFrame([(1, "lettering lettering letterings letterings lettexing lettexing watering watering matering matering")], "doc_id long, text string")
    vocab = spelling.vocabulary(docs).withColumn("wid", spelling.F.monotonically_increasing_id())
    from cohortry.llm.common import saved

    vocab = saved(vocab, "vocab")
    want = {r.wid: (r.n_near, r.form) for r in spelling.near_words(vocab).collect()}
    rough = lambda batches: (pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() & 15), b.column(1), b.column(2)], ["key", "wid", "place"]) for b in batches)
    make = spelling._make_keys
    monkeypatch.setattr(spelling, "_make_keys", lambda batches: rough(make(batches)))
    assert {r.wid: (r.n_near, r.form) for r in spelling.near_words(vocab).collect()} == want and want
