"""Quality classifier: learned hashed word and character n-gram vectors, averaged, with a softmax output."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

BUCKETS = 1 << 16
GRAMS = (3, 4)
_SALT = {k: arrays.mix64(np.array([1000 + k], np.uint64))[0] for k in range(8)}


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of every document, in no order.

    Features are words as they stand, pairs of neighbouring words (with one shared feature
    for a word that repeats the one before it), and the character 3- and 4-grams of words with
    the blank on either side.
    """
    n_docs = len(off) - 1
    starts, ends, at = arrays.words(data, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = arrays.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    docs, codes = [doc], [word ^ _SALT[0]]
    pair = doc[1:] == doc[:-1]
    docs.append(doc[1:][pair])
    codes.append(np.where(word[1:] == word[:-1], _SALT[1], arrays.mix64(word[:-1] * np.uint64(3) + word[1:]))[pair])
    points, cut = arrays.characters(data, off)
    small = points < 256
    is_blank = np.zeros(len(points), bool)
    is_blank[small] = arrays.SPACE[points[small]]
    code_of = arrays.mix64(np.where(is_blank, 0x20, points).astype(np.uint64))
    blank = np.concatenate(([0], np.cumsum(is_blank)))
    owner = np.repeat(np.arange(n_docs), np.diff(cut))
    for n in GRAMS:
        k = len(points) - n + 1
        if k <= 0:
            continue
        code = np.zeros(k, np.uint64)
        for j in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + code_of[j : j + k]
        ok = (owner[:k] == owner[n - 1 :]) & (blank[n - 1 : n - 1 + k] == blank[1 : 1 + k])
        docs.append(owner[:k][ok])
        codes.append(code[ok] ^ _SALT[n])
    return np.concatenate(docs), (arrays.mix64(np.concatenate(codes)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class QualityModel:
    vectors: np.ndarray  # buckets x dimensions
    output: np.ndarray  # dimensions x classes
    bias: np.ndarray

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of class 1 of every document."""
        n = len(off) - 1
        # the output is linear in the mean vector: each bucket's share of the logit is taken once
        gain = (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)
        doc, bucket = features(data, off)
        total = np.bincount(doc, gain[bucket], n)
        count = np.bincount(doc, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias[1] - self.bias[0], -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, prior: float, dimensions: int = 8, epochs: int = 12, batch: int = 32, rate: float = 0.5, seed: int = 1) -> QualityModel:
    """Stochastic gradient descent (Adagrad steps) on rows (buckets, counts, label); the bias is moved so that class 1 has the share ``prior``.

    Without rows of both classes every document gets ``prior``.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, dimensions))
    output = rng.normal(0, 0.1, (dimensions, 2))
    bias = np.zeros(2)
    y = np.array([r[2] for r in rows], np.int64)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    logit = np.log(prior / (1 - prior))
    if len(set(y.tolist())) < 2:
        return QualityModel(vectors * 0, output, np.array([0.0, logit]))
    g_v, g_o, g_b = np.full(BUCKETS, 1e-8), np.full(output.shape, 1e-8), np.full(2, 1e-8)
    size_of = [max(1, int(c.sum(dtype=np.int64))) for _, c, _ in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), batch):
            own = [i for i in order[b : b + batch] if len(rows[i][0])]
            if not own:
                continue
            idx = np.concatenate([rows[i][0] for i in own]).astype(np.int64)
            w = np.concatenate([rows[i][1] / size_of[i] for i in own])
            size = np.array([len(rows[i][0]) for i in own])
            begin = np.cumsum(size) - size
            hidden = np.add.reduceat(vectors[idx] * w[:, None], begin, axis=0)
            z = hidden @ output + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            d_hidden = p @ output.T
            d_out, d_bias = hidden.T @ p, p.sum(axis=0)
            buckets, back = np.unique(idx, return_inverse=True)
            d = np.zeros((len(buckets), dimensions))
            contribution = np.repeat(d_hidden, size, axis=0) * w[:, None]
            for k in range(dimensions):
                d[:, k] = np.bincount(back, contribution[:, k], len(buckets))
            g_v[buckets] += (d * d).sum(axis=1)
            vectors[buckets] -= rate * d / np.sqrt(g_v[buckets])[:, None]
            g_o += d_out**2
            output -= 0.1 * d_out / np.sqrt(g_o)
            g_b += d_bias**2
            bias -= 0.1 * d_bias / np.sqrt(g_b)
    share = y.mean()
    bias = bias + np.array([0.0, logit - np.log(share / (1 - share))])
    return QualityModel(vectors.astype(np.float32), output, bias)


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 2500, most_chars: int = 20000, seed: int = 2, **options) -> QualityModel:
    """Learns ``label`` (0 or 1) of ``labels`` (doc_id, label) from the texts of ``docs``.

    The sample is bounded: about ``per_class`` rows of each class, by a hash of doc_id, of
    texts of up to ``most_chars`` code points.  Labels are the small side of the join: their
    sample is broadcast, its bound known.  Rows with a null label or doc_id are not used; a
    doc_id with several labels counts with each.  A count above 65535 of one n-gram bucket in a
    text (more than such texts have) counts as that.
    """
    known = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, min(1.0, per_class / max(1, n.get(1, 0)))).otherwise(min(1.0, per_class / max(1, n.get(0, 0))))
    few = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    few = few.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label").limit(4 * per_class)  # a bound for doc_ids with very many labels
    rows = docs.select("doc_id", "text").where(F.length("text") <= most_chars).join(F.broadcast(few), "doc_id").select("doc_id", "text", "label")

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                doc, bucket = features(*arrays.buffers(part.column("text")))
                key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
                at = np.searchsorted(key // BUCKETS, np.arange(part.num_rows + 1))
                cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                raw = [[v[a:b].astype(kind).tobytes() for a, b in cut] for v, kind in ((key % BUCKETS, "<u2"), (np.minimum(count, 65535), "<u2"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *(pa.array(r, pa.binary()) for r in raw)], names=["doc_id", "label", "buckets", "counts"])

    # partition by partition, so that the driver holds the features once, in four bytes each
    got = rows.mapInArrow(run, "doc_id long, label int, buckets binary, counts binary").toLocalIterator()
    data = [(r.doc_id, r.label, bytes(r.buckets), bytes(r.counts)) for r in got]
    data.sort()
    data = [(np.frombuffer(b, "<u2"), np.frombuffer(c, "<u2"), y) for _, y, b, c in data]
    return fit(data, prior=n.get(1, 0) / max(1, sum(n.values())), seed=seed, **options)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (probability of label 1) and predicted (1 if it reaches the threshold) to every row; a null or empty text gets the score of no features.

    A column named like an added one is replaced; an empty table gives no rows.
    """
    docs = docs.drop(*{"score", "predicted"} - {text})
    vectors = (model.vectors @ (model.output[:, 1:] - model.output[:, :1])).astype(np.float32)
    small = QualityModel(vectors, np.array([[0.0, 1.0]]), model.bias)  # tasks get one number a bucket

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, text):
                p = small.score(*arrays.buffers(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=[*part.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")
