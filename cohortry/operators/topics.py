"""Topic operators over vectors: topic vectors, assignment, search, reduction, patient metrics.

Topic matrices are small (hundreds of rows) and live on the driver; documents never do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalise


def topic_vectors(docs: DataFrame, topic: str, vector: str, noise: int = -1) -> DataFrame:
    """(topic, vec, size): normalised mean of the member vectors.  Tasks add up the vectors of a batch; only these sums, a vector for each topic and batch, are dealt by topic and place."""
    kind = docs.schema[topic].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                names, back = np.unique(f[topic].to_numpy(), return_inverse=True)
                x = np.stack(f[vector].to_numpy()).astype(np.float64)
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, back, x)
                yield pd.DataFrame({topic: names, "n": np.bincount(back), "total": list(total)})

    sums = docs.where(F.col(topic) != noise).select(topic, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"`{topic}` {kind}, n long, total array<double>")
    place = sums.select(topic, "n", F.posexplode("total").alias("i", "x")).groupBy(topic, "i").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    out = place.groupBy(topic).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"), F.max("n").alias("size"))
    return out.select(topic, normalise(F.col("vec")).alias("vec"), "size")


def matrix(topics: DataFrame, topic: str, vector: str) -> tuple[list, np.ndarray]:
    rows = sorted((r[0], r[1]) for r in topics.select(topic, vector).collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def similarities(docs: DataFrame, doc: str, vector: str, names: Sequence[int], vectors: np.ndarray, top: int | None = None) -> DataFrame:
    """(doc, topic, score): inner products with all topic vectors, or each document's best; batches of documents times one matrix."""
    kind = docs.schema[doc].dataType.simpleString()
    ids = np.array(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            s = np.stack(f[vector].to_numpy()).astype(np.float64) @ vectors.T
            order = np.argsort(-s, axis=1, kind="stable")[:, : top or len(ids)]
            yield pd.DataFrame({doc: np.repeat(f[doc].to_numpy(), order.shape[1]), "topic": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    return docs.select(doc, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"{doc} {kind}, topic int, score double")


def sizes(assigned: DataFrame) -> DataFrame:
    """(topic, size, rank): topics by falling size."""
    n = assigned.groupBy("topic").agg(F.count("*").alias("size"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "topic")) - 1)


def deduplicate(names: Sequence[int], vectors: np.ndarray, eps: float = 0.1) -> tuple[list[list[int]], np.ndarray]:
    """Topics within cosine distance ``eps`` of each other, chained, become one: groups and their normalised means."""
    near = vectors @ vectors.T >= 1 - eps
    root = np.arange(len(names))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(names))])
        if np.array_equal(new, root):
            break
        root = new
    groups = [np.flatnonzero(root == r).tolist() for r in np.unique(root)]
    mean = np.stack([vectors[g].mean(axis=0) for g in groups])
    return [[names[i] for i in g] for g in groups], mean / np.linalg.norm(mean, axis=1, keepdims=True)


def reduce_topics(vectors: np.ndarray, size: Sequence[int], count: int, weighted: bool = True) -> tuple[np.ndarray, list[list[int]]]:
    """Merges the smallest topic into its most similar one until ``count`` are left: vectors and the original topics of each."""
    v, n = vectors.astype(np.float64).copy(), np.array(size, np.float64)
    groups = [[i] for i in range(len(v))]
    while len(v) > max(1, count):
        small = int(np.argmin(n))
        s = v @ v[small]
        s[small] = -np.inf
        best = int(np.argmax(s))
        a, b = (n[best], n[small]) if weighted else (1.0, 1.0)
        m = (v[best] * a + v[small] * b) / (a + b)
        v[best], n[best] = m / (np.linalg.norm(m) or 1.0), n[best] + n[small]
        groups[best] += groups[small]
        keep = np.arange(len(v)) != small
        v, n = v[keep], n[keep]
        groups = [g for i, g in enumerate(groups) if i != small]
    return v, groups


def spanning_similarities(vectors: np.ndarray) -> np.ndarray:
    """Similarities along a greatest spanning tree of the topics, falling: those at or above a threshold are the merges that chaining at it makes."""
    k = len(vectors)
    best, out = np.full(k, -np.inf), []
    left = np.ones(k, bool)
    at = 0
    for _ in range(k - 1):
        left[at] = False
        best = np.maximum(best, vectors @ vectors[at])
        at = int(np.argmax(np.where(left, best, -np.inf)))
        out.append(best[at])
    return np.sort(np.array(out))[::-1]


#: Fixed value: how far along the steps from the first merge to one single topic the stable distance lies.
STABLE_SHARE = 0.9


def stable_distance(vectors: np.ndarray, steps: Sequence[float], share: float = STABLE_SHARE) -> float:
    """The merging distance, of rising ``steps``, that lies at ``share`` of the way from the first with a merge to the first that leaves one topic.

    If no step leaves one topic, the last one stands in its place; if none merges anything, the
    first is returned, which then merges nothing.  Topics left at a distance are counted by one
    spanning tree, not by clustering anew at each step.
    """
    steps = sorted(steps)
    tree = spanning_similarities(vectors)
    left = [len(vectors) - int((tree >= 1 - e).sum()) for e in steps]
    first = next((i for i, n in enumerate(left) if n < len(vectors)), None)
    if first is None:
        return steps[0]
    one = next((i for i, n in enumerate(left) if n == 1), len(steps) - 1)
    return steps[first + round((one - first) * share)]


def nearest_topic(docs: DataFrame, vector: str, vectors: np.ndarray) -> DataFrame:
    """(topic, vec): each vector that isn't null beside the number of its most similar topic (the first of equals)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["vec"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"topic": (x @ vectors.T).argmax(axis=1), "vec": f["vec"]})

    rows = docs.select(F.col(vector).cast("array<double>").alias("vec")).where("vec is not null")
    return rows.mapInPandas(run, "topic int, vec array<double>")


def topic_counts(docs: DataFrame, vector: str, vectors: np.ndarray) -> list[int]:
    """How many vectors each topic is the most similar to: a task returns one row of counts a topic."""
    k = len(vectors)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(k, np.int64)
        for f in frames:
            if len(f):
                x = np.stack(f[vector].to_numpy()).astype(np.float64)
                n += np.bincount((x @ vectors.T).argmax(axis=1), minlength=k)
        yield pd.DataFrame({"topic": np.arange(k), "n": n})

    out = [0] * k
    rows = docs.select(vector).where(F.col(vector).isNotNull()).mapInPandas(run, "topic int, n long")
    for r in rows.groupBy("topic").agg(F.sum("n").alias("n")).collect():  # a row a topic
        out[r.topic] = r.n
    return out


#: Fixed value: documents for each merge between two counts of them.
DOCS_A_MERGE = 50_000


def refreshed_reduction(docs: DataFrame, vector: str, vectors: np.ndarray, size: Sequence[int], count: int, interval: int | None = None, weighted: bool = True) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Reduction to ``count`` topics with sizes counted from the documents again: vectors, original topics of each, sizes, by falling size.

    The smallest topic and the one most similar to it (the first of equals) make a new one, the
    mean weighted by size.  After the first merge and every ``interval`` merges from there (a
    merge for each 50,000 documents unless given) all documents are counted by their nearest
    topic, an empty topic as 1; between these the sizes are added.  At the end each topic
    becomes the normalised mean of the documents nearest to it, one without any stays as it
    was, and documents are counted once more.  The cost is one pass over the vectors a refresh.
    """
    if interval is None:
        interval = max(1, docs.where(F.col(vector).isNotNull()).count() // DOCS_A_MERGE)
    topics = [(np.asarray(v, np.float64), int(n), [i]) for i, (v, n) in enumerate(zip(vectors, size))]
    merges = 0
    while len(topics) > max(1, count):
        low = min(range(len(topics)), key=lambda i: topics[i][1])
        s = np.stack([v for v, _, _ in topics]) @ topics[low][0]
        s[low] = -np.inf
        near = int(s.argmax())
        (a, na, ma), (b, nb, mb) = topics[low], topics[near]
        mean = a * na + b * nb if weighted else a + b
        mean = mean / (np.linalg.norm(mean) or 1.0)
        topics = [x for i, x in enumerate(topics) if i not in (low, near)] + [(mean, na + nb, ma + mb)]
        if merges % interval == 0:
            counted = topic_counts(docs, vector, np.stack([v for v, _, _ in topics]))
            topics = [(v, max(1, n), m) for (v, _, m), n in zip(topics, counted)]
        merges += 1
    out = np.stack([v for v, _, _ in topics])
    for r in topic_vectors(nearest_topic(docs, vector, out), "topic", "vec").collect():  # a row a topic
        out[r.topic] = r.vec
    counted = topic_counts(docs, vector, out)
    order = sorted(range(len(out)), key=lambda i: (-counted[i], i))
    return out[order], [sorted(topics[i][2]) for i in order], [counted[i] for i in order]


def separation(sims: DataFrame, doc: str) -> DataFrame:
    """(topic, score): of documents assigned to their best topic, closeness to it against the mean of the others, in 0 to 1."""
    w = Window.partitionBy(doc).orderBy(F.desc("score"), "topic")
    r = sims.withColumn("r", F.row_number().over(w))
    per = r.groupBy(doc).agg(F.max(F.when(F.col("r") == 1, F.col("topic"))).alias("topic"), (1 - F.max(F.when(F.col("r") == 1, F.col("score")))).alias("a"), (1 - F.avg(F.when(F.col("r") > 1, F.col("score")))).alias("b"))
    s = (F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")) + 1) / 2
    return per.groupBy("topic").agg(F.avg(s).alias("score"))


#: What each small topic costs, and the share of all documents up to which a topic is small.
SMALL_PENALTY, SMALL_SHARE = 0.005, 0.005


def silhouette(docs: DataFrame, doc: str, vector: str, vectors: np.ndarray) -> tuple[float, list[int]]:
    """Mean over topics of their separation (0 to 1, 0.5 where a topic has no document), and how many documents each has.

    Of a topic: a is 1 - the mean score of its documents with it, b is 1 - their mean score
    with all others, both by cosine brought to 0 to 1; (b - a) / max(a, b) is brought to 0 to
    1 as well.  One pass: batches of documents times the topic matrix, a row of sums a batch.
    """
    k = len(vectors)
    if k < 2:
        return 0.5, [docs.where(F.col(vector).isNotNull()).count()] * k

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                s = (np.stack(f[vector].to_numpy()).astype(np.float64) @ vectors.T + 1) / 2
                best = s.argmax(axis=1)
                own = s[np.arange(len(s)), best]
                per = [np.bincount(best, x, k) for x in (None, own, (s.sum(axis=1) - own) / (k - 1))]
                yield pd.DataFrame({"topic": np.arange(k), "n": per[0], "own": per[1], "others": per[2]})

    sums = docs.select(vector).where(F.col(vector).isNotNull()).mapInPandas(run, "topic int, n long, own double, others double")
    score, size = np.full(k, 0.5), [0] * k
    for r in sums.groupBy("topic").agg(*(F.sum(c).alias(c) for c in ("n", "own", "others"))).collect():  # a row a topic
        size[r.topic] = r.n
        if r.n:
            a, b = 1 - r.own / r.n, 1 - r.others / r.n
            score[r.topic] = ((b - a) / max(a, b) + 1) / 2 if max(a, b) > 0 else 0.5
    return float(score.mean()), size


def reduction_scores(docs: DataFrame, doc: str, vector: str, vectors: np.ndarray, size: Sequence[int], counts: Sequence[int], penalty: float = SMALL_PENALTY, small: int | None = None, weighted: bool = False) -> dict[int, tuple[float, int]]:
    """Of each topic count asked for, in one descent: silhouette less ``penalty`` for each small topic, and how many are small."""
    small = max(1, round(sum(size) * SMALL_SHARE)) if small is None else small
    out, v, n = {}, vectors, list(size)
    for k in sorted({c for c in counts if 1 <= c <= len(vectors)}, reverse=True):
        v, groups = reduce_topics(v, n, k, weighted)
        n = [sum(n[i] for i in g) for g in groups]
        score, own = silhouette(docs, doc, vector, v)
        few = sum(x <= small for x in own)
        out[k] = (score - penalty * few, few)
    return out


def best_topic_count(docs: DataFrame, doc: str, vector: str, vectors: np.ndarray, size: Sequence[int], low: int = 2, high: int = 50, points: int = 15) -> tuple[int, dict[int, float]]:
    """The topic count in [low, high] with the best penalised silhouette, and all scores seen.

    A grid over the range, then around its best three, finer and finer, until nothing new is
    left to try; each grid is one descent of the reduction.
    """
    top = min(len(vectors), high, round(1 / SMALL_PENALTY))
    if top <= low:
        return top, {}
    seen: dict[int, float] = {len(vectors): reduction_scores(docs, doc, vector, vectors, size, [len(vectors)])[len(vectors)][0]}
    lo, hi = low, top
    while True:
        grid = [k for k in range(lo, hi, max(1, round(hi / points))) if k not in seen]
        if not grid:
            break
        seen |= {k: s for k, (s, _) in reduction_scores(docs, doc, vector, vectors, size, grid).items()}
        around = sorted(sorted(seen, key=lambda k: (-seen[k], k))[:3])
        if len(around) < 3:
            break
        lo, hi = around[0], around[1] if around[2] == hi else around[2]
    return max(seen, key=lambda k: (seen[k], -k)), seen


def metrics(s: Column, w: Column, positive: bool = True) -> dict[str, Column]:
    """Patient by topic metrics of score s and time weight w; ``dit`` counts documents with a score above 0, ``twdit`` sums their weights (not ``positive``: both take all documents); ``twps50`` has a name of its own."""
    pa, tw = F.avg(s), F.coalesce(F.try_divide(F.sum(s * w), F.sum(w)), F.lit(0.0))
    ps, tps = F.sum(s), F.sum(s * w)
    own = s > 0 if positive else F.lit(True)
    dit, tdit = F.count_if(own).cast("double"), F.coalesce(F.sum(F.when(own, w)), F.lit(0.0))
    return {"mx": F.max(s), "pa": pa, "twpa": tw, "dit": dit, "twdit": tdit, "ps": ps, "twps": tps, "twpa50": (pa + tw) / 2, "twdit50": (dit + tdit) / 2, "twps50": (ps + tps) / 2}


def patient_topics(assigned: DataFrame, patient: str, score: str, weight: str, least_docs: int = 500, positive: bool = True) -> DataFrame:
    """(patient, topic, one column a metric) of topics with at least ``least_docs`` documents."""
    big = assigned.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("topic")
    m = metrics(F.col(score), F.col(weight), positive)
    return assigned.join(big, "topic", "left_semi").groupBy(patient, "topic").agg(*(c.alias(k) for k, c in m.items()))


def combined_query(positive: Sequence[np.ndarray], negative: Sequence[np.ndarray] = ()) -> np.ndarray:
    """Normalised sum of wanted minus unwanted vectors."""
    v = (np.sum(positive, axis=0) - (np.sum(negative, axis=0) if len(negative) else 0)) / (len(positive) + len(negative))
    return v / (np.linalg.norm(v) or 1.0)


def search(docs: DataFrame, doc: str, vector: str, query: np.ndarray, top: int, exclude: Sequence[int] = ()) -> DataFrame:
    """The ``top`` documents by inner product with the query, without the excluded ones: a distributed top-k."""
    rows = docs.where(~F.col(doc).isin(list(exclude))) if exclude else docs
    return similarities(rows, doc, vector, [0], query[None, :]).orderBy(F.desc("score"), doc).limit(top).select(doc, "score")
