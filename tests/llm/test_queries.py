"""The registered queries on the smallest tables, against brute force, or by held-out quality where there is no one right answer."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortry.llm import queries as Q
from cohortry.llm.common import saved

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def run(spark, name):
    return saved(Q.QUERIES[name](spark, DIR), name).collect()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def held(i, of, left):
    return zlib.crc32(str(i).encode()) % of == left


def auc(pairs):
    order = sorted(pairs)
    ranks, k = {}, 0
    while k < len(order):
        j = k
        while j < len(order) and order[j][0] == order[k][0]:
            j += 1
        ranks[order[k][0]] = (k + 1 + j) / 2
        k = j
    pos = [s for s, y in pairs if y]
    n = len(pairs) - len(pos)
    return (sum(ranks[s] for s in pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * n)


def test_op1(spark, docs):
    rows = run(spark, "op1_mix_sources")
    assert len(rows) == len(docs)
    size = {i: len(words(r.text)) for i, r in docs.items()}
    per = Counter()
    for i, r in docs.items():
        per[r.source] += size[i]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    open_, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(per.values())
    while open_:
        over = [s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * per[s]]
        if not over:
            target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            target[s] = 2 * per[s]
            left -= target[s]
            del open_[s]
    taken = Counter()
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        assert len(r.shards) == r.n_draws and (r.n_draws > 0) == (r.taken > 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, rows)) == sorted(map(str, run(spark, "op1_mix_sources")))


def test_op2(spark, docs):
    rows = run(spark, "op2_imatch")
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    own = {}
    for r in rows:
        t, n = docs[r.doc_id].text or "", docs[after[r.doc_id]].text or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert own.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert t != edited or r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
        assert t != n or r.near_next == 1
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows])


def test_op3(spark, docs):
    sets = {}
    for i, r in docs.items():
        w = words(lower(r.text))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                hi, lo = max(root[a], root[b]), min(root[a], root[b])
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op3_jaccard")} == {i: (len(s), root[i]) for i, s in sets.items()}


def test_op4(spark):
    v = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in v], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(root[k], root[near[k]].min(initial=root[k])) for k in range(len(x))])
        if (new == root).all():
            break
        root = new
    ids = [r.vec_id for r in v]
    want = {i: (int(near[k].sum()), ids[root[k]], ids[root[k]] == i) for k, i in enumerate(ids)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, "op4_embeddings")} == want


def test_op5(spark, docs):
    rows = run(spark, "op5_language")
    langs = {r.lang for r in docs.values() if r.lang}
    right = []
    for r in rows:
        t = docs[r.doc_id].text or ""
        assert r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t)) and r.lang_pred in langs | {"und"}
        if r.held_out and docs[r.doc_id].lang and len(words(t)) >= 20:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.95


def test_op6(spark, docs):
    tok = {i: [*words(lower(r.text)), None] for i, r in docs.items()}
    c = Counter(w for i, x in tok.items() if not held(i, 5, 1) for w in x)
    total, size = sum(c.values()), len(c)
    rows = run(spark, "op6_ngram")
    for r in rows:
        x = tok[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 5, 1), len(x), sum(w in c for w in x), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (size + 1))) for w in x))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_op7(spark, docs):
    for r in run(spark, "op7_pieces"):
        t = docs[r.doc_id].text
        assert r.exact or t is None
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() or t is None


def test_op8(spark, docs):
    seen = {}
    for i in sorted(docs):
        raw = (docs[i].text or "").encode()
        for k in range(len(raw) - 49):
            seen.setdefault(raw[k : k + 50], i)
    for r in run(spark, "op8_repeats"):
        raw = (docs[r.doc_id].text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if seen[raw[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest())


def test_op10(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    rows = run(spark, "op10_quality")
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert auc([(r.score, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out]) > 0.6
