"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import arrays, covertree, imatch, langid, mixing, ngram, partenum, pieces, quality, repeats, warc
from cohortry.llm.common import components

RNG = np.random.default_rng(7)
WORDS = ["".join(RNG.choice(list("abcdefghilmnoprstu"), int(n))) for n in RNG.integers(2, 9, 400)]


def text(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


PASSAGE = text(30, 99)
BASE = text(120, 1).split(" ")
ROWS = [
    (1, " ".join(BASE)),
    (2, " ".join(BASE)),
    (2, " ".join(BASE)),
    (3, " ".join([*BASE[:60], "XX", *BASE[61:]])),
    (4, " ".join([*BASE[:100], *text(20, 2).split(" ")])),
    (5, None),
    (6, ""),
    (7, " \t\n "),
    (8, "one two"),
    (9, "One TWO"),
    (10, text(5000, 3)),
    (11, text(40, 4) + " " + PASSAGE + "\n" + text(40, 5)),
    (12, PASSAGE + " " + text(60, 6)),
    (13, "é" * 60 + "漢字 🙂 ▁ <s> " + "é" * 60),
    (14, "aa " * 100),
    (15, "aa " * 90),
    (None, text(50, 8)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else "fr", None if i == 3 else f"src{(i or 0) % 3}", len(t or ""), 1.0, "x", 5) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size int").cache()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (60, 60)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 1 for i in range(1, 31)) and got[51] == 50 and 60 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs, ["doc_id"]).collect()
    assert len(got) == len(ROWS)
    size = {i: len(words(t)) for i, t in ROWS}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and r.taken == sum(d.words for d in r.draws) for r in got)
    source = {i: None if i == 3 else f"src{(i or 0) % 3}" for i, _ in ROWS}
    for s in set(source.values()):
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].source_size == sum(r["size"] for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, ["doc_id"]).collect()))
    assert mixing.mix(docs.where("false"), ["doc_id"]).count() == 0
    whole = mixing.mixed(mixing.mix(docs, ["doc_id", "text", "n_chars"]), ["doc_id", "text", "n_chars"]).collect()
    taken = Counter()
    for r in whole:
        taken[r.doc_id] += len(words(r.text))
    assert all(taken[i] == n for i, n in Counter({r.doc_id: 0 for r in got}).items() if n) and sum(taken.values()) == sum(r.taken for r in got)


def test_splitting_tree():
    q = np.array([100, 37, 0, 8])
    s = mixing.split_quotas(q, 7, 3)
    assert (s.sum(axis=0) == q).all() and np.ptp(s.sum(axis=1)) <= 3 and (s >= 0).all()
    assert mixing.targets([100, 10, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 20, 95])


def test_imatch(spark, docs):
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = imatch.with_fingerprint(d, F.col("text"), imatch.lookup(imatch.lexicon(d, low=0.01, high=0.9)), "fp")
    got = imatch.with_next(own, {"text": "next_text"}, bucket_rows=3).select("doc_id", "text", "next_text", imatch.as_text(F.col("fp")).alias("fp")).collect()
    assert len(got) == len(ROWS)
    same = {}
    for r in got:
        assert same.setdefault(r.text, r.fp) == r.fp
    order = sorted(((i, t or "") for i, t in ROWS), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == want
    assert imatch.with_next(own.where("false"), {"text": "n"}).count() == 0
    assert imatch.lexicon(d.where("false")).count() == 0


def test_jaccard(spark, docs):
    sets = []
    for i, t in ROWS:
        w = words(lower(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            hi, lo = root[b], root[a]
            root = [lo if r == hi else r for r in root]
    name = {}
    for k, r in enumerate(root):
        name[r] = min([x for x in (name.get(r), sets[k][0]) if x is not None], default=None)
    want = sorted(((i, len(s), name[r]) for (i, s), r in zip(sets, root)), key=str)
    got = partenum.jaccard_components(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert partenum.jaccard_components(docs.where("false")).count() == 0


def test_partenum_shares_a_signature():
    r = np.random.default_rng(1)
    for n in (5, 9, 23, 60, 200, 900):
        for _ in range(30):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            drop = int(n * 0.2)
            b = np.unique(a[: n - drop // 2])
            a, b = np.unique(a), np.unique(np.concatenate((b, r.integers(0, 2**63, drop // 2 // 2).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(a) == len(b) == both or 5 * both < 4 * (len(a) + len(b) - both):
                continue
            assert len(np.intersect1d(*(partenum.set_signatures(x, partenum.Fraction(4, 5)) for x in (a, b))))


def test_cover_trees(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(6, 16))
    x = np.concatenate([centre[i] + r.normal(scale=0.12, size=(40, 16)) for i in range(6)] + [r.normal(size=(60, 16))]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(1000, rows[0][1], 1), (1001, None, 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] * 16, 1), (1005, [1.0, 2.0], 1), (1006, [], 1), (1000, rows[0][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    n = {k: 0 for k in range(len(ok))}
    root = list(range(len(ok)))
    for a, b in itertools.combinations(range(len(ok)), 2):
        u, v = ok[a][1], ok[b][1]
        if len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.95:
            n[a] += 1
            n[b] += 1
            hi, lo = max(root[a], root[b]), min(root[a], root[b])
            root = [lo if q == hi else q for q in root]
    low = {}
    for k, q in enumerate(root):
        low[q] = min(low.get(q, 10**9), ok[k][0])
    want = Counter((ok[k][0], n[k], low[root[k]]) for k in range(len(ok)))
    want.update((i, 0, i) for i in (1001, 1002, 1003, 1004, 1006))
    for chunk in (8192, 50):
        got = covertree.near_duplicates(df, chunk_rows=chunk)
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == want
    assert covertree.near_duplicates(df.where("false")).count() == 0


def test_language(spark, docs):
    de = [(100 + i, " ".join(np.random.default_rng(i).choice(["der", "die", "und", "schön", "über", "haus"], 30)), "de") for i in range(40)]
    en = [(200 + i, " ".join(np.random.default_rng(i).choice(["the", "and", "house", "over", "nice", "with"], 30)), "en") for i in range(40)]
    df = spark.createDataFrame(de + en, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 2 = 0"))
    got = langid.predict(df, model).where("doc_id % 2 = 1").collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in got)
    odd = langid.predict(docs, model)
    assert odd.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "size", "lang_pred", "score"]
    assert {r.doc_id: (r.lang_pred, r.score) for r in odd.collect() if r.doc_id in (5, 6, 7)} == {5: ("und", 0.0), 6: ("und", 0.0), 7: ("und", 0.0)}
    assert langid.train(df.where("false")) is None and langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(docs.where("false"), model).count() == 0


def test_ngram(spark, docs):
    train = docs.where("doc_id <> 10")
    tok = lambda t: [*words(lower(t)), None]
    tr = [tok(t) for i, t in ROWS if i is not None and i != 10]
    c, b = Counter(w for x in tr for w in x), Counter(p for x in tr for p in zip(["<b>", *x[:-1]], x))
    total, size = sum(c.values()), len(c)
    cont, ctx = Counter(w for _, w in b), {}
    for (u, _), n in b.items():
        s = ctx.setdefault(u, [0, 0, 0, 0])
        s[0] += n
        s[min(n, 3)] += 1
    d, e = (ngram.discounts([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]) for x in (b, cont))
    s = sum(cont.values())
    rest = sum(e[min(v, 3) - 1] for v in cont.values()) / s

    def uni(w):
        return max(cont.get(w, 0) - [0, *e][min(cont.get(w, 0), 3)], 0) / s + rest / (size + 1)

    def p(u, w):
        if u not in ctx:
            return uni(w)
        x, n = ctx[u], b.get((u, w), 0)
        return max(n - [0, *d][min(n, 3)], 0) / x[0] + sum(d[k] * x[k + 1] for k in range(3)) / x[0] * uni(w)

    assert sum(p(BASE[0], w) for w in c) + p(BASE[0], "new") == pytest.approx(1)
    model = ngram.train(train)
    got = ngram.score(docs, model).collect()
    want = {}
    for _, t in ROWS:
        x = tok(t)
        want[t] = (len(x), sum(w in c for w in x), total, sum(math.log10((c.get(w, 0) + 0.5) / (total + 0.5 * (size + 1))) for w in x), sum(math.log10(p(u, w)) for u, w in zip(["<b>", *x[:-1]], x)))
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.text][:3] and [r.base_score, r.score] == pytest.approx(want[r.text][3:])
    nothing = ngram.train(docs.where("false"))
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in ngram.score(docs, nothing).collect())
    assert ngram.score(docs.where("false"), model).count() == 0


def test_pieces(spark, docs):
    rows = pieces.encode(docs, "text", verify=True)
    back = pieces.decode(rows, "pieces").collect()
    assert all(r.decoded == r.text and (r.exact or r.text is None) for r in back) and len(back) == len(ROWS)
    assert all(r.pieces == [] for r in back if r.text == "") and all(r.pieces is None for r in back if r.text is None)
    assert pieces.encode(docs.where("false"), "text").count() == 0


def test_viterbi_is_best():
    m = pieces.PieceModel(["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "a", "b", "ab", "ba", "aba", pieces.MARK], [0.0] * 257 + [-2.0, -2.5, -3.0, -3.1, -6.0, -1.0], [2] + [6] * 256 + [1] * 6)
    score = {p: s for p, s, t in zip(m.pieces, m.scores, m.types) if t == 1}

    def best(s):
        return max(((score[p] + best(s[len(p) :])) for p in score if s.startswith(p)), default=0.0) if s else 0.0

    for n in range(1, 8):
        for s in map("".join, itertools.product("ab", repeat=n)):
            got = [m.pieces[i] for i in m.viterbi(s)]
            assert "".join(got) == s and sum(score[p] for p in got) == pytest.approx(best(s))
    assert m.viterbi("é") == [1 + b for b in "é".encode()]


def test_repeats(spark, docs):
    seen, want = {}, []
    for i, t in ROWS:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            o = 2**63 if i is None else i
            seen[raw[k : k + 50]] = min(o, seen.get(raw[k : k + 50], o))
    for i, t in ROWS:
        raw, o = (t or "").encode(), 2**63 if i is None else i
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if seen[raw[k : k + 50]] < o:
                gone[k : k + 50] = b"\1" * 50
        want.append((i, len(raw), bytes(c for c, g in zip(raw, gone) if not g), [m.span() for m in re.finditer(b"\1+", bytes(gone))]))
    got = repeats.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in got), key=str) == sorted(want, key=str)
    assert repeats.remove_repeats(docs.where("false")).count() == 0


def test_smaller_values():
    for _ in range(50):
        v = np.random.default_rng(_).integers(0, 6, 40)
        p, n = repeats.previous_smaller(v), repeats.next_smaller(v)
        for i in range(len(v)):
            assert p[i] == max((j for j in range(i) if v[j] < v[i]), default=-1) and n[i] == min((j for j in range(i + 1, len(v)) if v[j] < v[i]), default=len(v))


def pages(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/1", big, 9), (2, None, big, 9), (3, "http://a/3\r\nX: y", big, 9), (4, "u", None, 9), (5, "u", "", 9), (6, "u", "small", 9), (7, "u", "small", 9), (-8, "u", "é" * 700, 9), (None, "u", big, 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), rows


def test_warc(spark):
    df, rows = pages(spark)
    got = warc.read_warc(warc.write_warc(df)).where("kind = 'record'").collect()
    body = {i: (h or "").encode() for i, _, h, _ in rows}
    want = Counter((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if i in (1, 2, None) else "response", 3 if i in (1, 2, None) else None) for i, b in body.items())
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload) == body[r.page_id] for r in got if r.record_type == "response")
    assert warc.read_warc(warc.write_warc(df.where("false"))).count() == 0
    assert [warc.page_of(warc.record_id(i)) for i in (0, 5, -1, 2**62, -(2**63))] == [0, 5, -1, 2**62, -(2**63)]


def test_salvage():
    raw = [warc.record(i, "u", f"payload {i}".encode() * 50, hashlib.sha1(f"payload {i}".encode() * 50).hexdigest(), None, "2000-01-01T00:00:00Z") for i in range(5)]
    z = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in raw]
    packed = [c.compress(r) + c.flush() for c, r in zip(z, raw)]
    for parts in (packed, raw):
        bad = bytearray(parts[1])
        bad[len(bad) // 2] ^= 0xFF
        data = parts[0] + bytes(bad) + b"junk" + parts[2] + parts[3][: len(parts[3]) // 2] + parts[4]
        rows = list(warc.salvage("f", data))
        assert [r[7] for r in rows if r[3] == "record"] == [0, 2, 4]
        gaps = [(r[1], r[2]) for r in rows if r[3] == "gap"]
        a, b = len(parts[0]), len(parts[0]) + len(bad) + 4 + len(parts[2])
        assert gaps == [(a, len(bad) + 4), (b, len(parts[3]) // 2)]
    assert [r[3] for r in warc.salvage("f", b"nothing here")] == ["gap"] and list(warc.salvage("f", b"")) == []


def test_quality(spark, docs):
    good = [(i, text(60, 1000 + i)) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "***" for w in text(60, 5000 + i).split())) for i in range(150)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("label"))
    model = quality.train(df, labels.where("doc_id % 3 <> 0"), epochs=6)
    got = quality.score(df, model).where("doc_id % 3 = 0").collect()
    assert all((r.score > 0.5) == (r.doc_id < 1000) and r.predicted == (r.score >= 0.3) for r in got)
    odd = quality.score(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if not words(r.text)}) == 1
    assert quality.score(docs.where("false"), model).count() == 0
    assert all(0 < r.score < 1 for r in quality.score(docs, quality.train(df, labels.where("false"))).collect())


def test_kernels():
    raw = [t.encode() for t in ("a bc\td", "", "  x ", "y" * 200)]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    s, e, at = arrays.words(data, off)
    assert [data[a:b].tobytes() for a, b in zip(s, e)] == [b"a", b"bc", b"d", b"x", b"y" * 200] and at.tolist() == [0, 3, 3, 4, 5]
    for w in (3, 24, 50):
        h = arrays.rolling(data, w)
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(data[i : i + w].tobytes(), h[i]) == h[i]
        assert len(set(h.tolist())) == len(seen)
