"""Joint word and document vectors: distributed bag of words with hierarchical softmax or negative sampling."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalise
from .neighbours import written

#: Bytes of word parameters at most: every task holds them once.
MOST_BYTES = 1 << 31
#: Words of the documents that a task trains, about, where there are more than so many for each core.
PART_WORDS = 1 << 22
#: Words of a document that are walked one after the other; a longer one is walked at several places at once.
RUN = 1024


@dataclass
class Tree:
    """A Huffman tree of words: for each word the inner nodes on its path (padded by -1) and which way it goes there."""

    nodes: np.ndarray
    codes: np.ndarray


def huffman(counts: Sequence[int]) -> Tree:
    """Frequent words have short paths; ties by place."""
    v = len(counts)
    heap = [(int(n), i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    parent, way = {}, {}
    nxt = v
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j], way[i], way[j] = nxt, nxt, 0, 1
        heapq.heappush(heap, (a + b, nxt))
        nxt += 1
    paths = []
    for i in range(v):
        own, at = [], i
        while at in parent:
            own.append((parent[at] - v, way[at]))
            at = parent[at]
        paths.append(own[::-1])
    width = max(1, max(map(len, paths), default=1))
    nodes, codes = np.full((v, width), -1, np.int32), np.zeros((v, width), np.float32)
    for i, own in enumerate(paths):
        for k, (n, c) in enumerate(own):
            nodes[i, k], codes[i, k] = n, c
    return Tree(nodes, codes)


def gradients(h: np.ndarray, out: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Losses of the first of the inputs ``h`` (place, input, dim) against rows of ``out`` (-1: none) with labels 0 and 1; the slope of each score and the gradients by h.

    All inputs of a place share its rows, which are fetched once.  A label of 1 asks for a low score at a tree's
    node (the second branch) or of a drawn word.
    """
    ok = (rows >= 0)[:, None, :]
    n = out.take(np.maximum(rows, 0), axis=0)
    sign = (1.0 - 2.0 * labels)[:, None, :]
    score = sign * np.matmul(h, n.transpose(0, 2, 1))
    away = np.exp(-np.clip(score, -30, 30))
    loss = (np.log1p(away[:, 0]) * ok[:, 0]).sum(axis=1)
    g = (away / (1.0 + away) * (-sign * ok)).astype(h.dtype)
    return loss, g, np.matmul(g, n)


def pair_gradients(h: np.ndarray, out: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """``gradients`` of one input a place: loss, gradients by h and by the rows."""
    loss, g, gh = gradients(h[:, None, :], out, rows, labels)
    return float(loss.sum()), gh[:, 0], g[:, 0, :, None] * h[:, None, :]


#: Rows that more places share are summed by a matrix product.
SHARED = 4


def _add(into: np.ndarray, rows: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, most: float) -> None:
    """Adds to each of ``rows``, which may repeat, g (entry, input) times h (place ``at``, input, dim).

    A row's sum counts as ``most`` entries at most, as all are made from the same state.
    """
    if not len(rows):
        return
    order = np.argsort(rows.astype(np.uint16) if len(into) <= 1 << 16 else rows, kind="stable")  # 16 bits are sorted by radix
    rows, at, g = rows[order], at[order], g.take(order, axis=0)
    begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    count = np.diff(np.append(begin, len(rows)))
    scale = np.minimum(1.0, most / count).astype(into.dtype)
    each = np.repeat(np.arange(len(begin)), count)
    many = np.flatnonzero(count > SHARED)
    if len(many):
        own = count[each] > SHARED
        places, inputs = h.shape[:2]
        wide = np.zeros((len(many), places * inputs), into.dtype)
        k = np.searchsorted(many, each[own])
        np.add.at(wide.reshape(-1), (((k * places + at[own]) * inputs)[:, None] + np.arange(inputs)).ravel(), g[own].ravel())
        into[rows[begin[many]]] += (wide @ h.reshape(places * inputs, -1)) * scale[many, None]
    few = np.flatnonzero(count[each] <= SHARED)
    if len(few):
        nth = few - begin[each[few]]
        few = few[np.argsort(nth, kind="stable")]
        w = g[few] * scale[each[few], None]
        change = np.matmul(w[:, None, :], h.take(at[few], axis=0))[:, 0] if h.shape[1] > 1 else w * h[:, 0].take(at[few], axis=0)
        cut = np.cumsum(np.bincount(nth))
        for lo, hi in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):  # no row twice in a turn
            into[rows[few[lo:hi]]] += change[lo:hi]


@dataclass
class Model:
    """Words with their input vectors and output rows; documents (key, vector) as a table; the loss a pair of each round."""

    words: list[str]
    counts: np.ndarray
    inputs: np.ndarray
    outputs: np.ndarray
    documents: DataFrame
    losses: list[float]


def vocabulary(docs: DataFrame, tok: str, least: int, size: int) -> list:
    """Words of at least ``least`` occurrences by falling count, on the driver: their parameters must fit in ``MOST_BYTES``."""
    v = docs.select(F.explode(tok).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    n = v.count()
    if n * size * 8 > MOST_BYTES:
        raise ValueError(f"{n} words of {size} numbers are too many to hold: raise the least count")
    return v.orderBy(F.desc("n"), "w").collect()


def paragraph_vectors(docs: DataFrame, key: str, tok: str, *, size: int = 300, window: int = 15, least: int = 50, rounds: int = 40, alpha: float = 0.025, negatives: int = 0, words: bool = True, batch: int = 256, parts: int | None = None, seed: int = 42) -> Model:
    """Trains document vectors that predict the words of their document, and word vectors that predict their neighbours.

    ``key``: a long, unique; rows without one are left out, rows without known words keep their first
    vector.  ``negatives`` 0: hierarchical softmax; else so many words drawn by count^0.75.  A round goes over all pairs once:
    every task starts from the same word parameters, updates the vectors of its own documents (``PART_WORDS`` words or so), which are rows of a
    table and never leave it, and returns how it changed the word parameters; these are averaged over the tasks that
    touched a row, by a partial aggregate over (row, place) blocks.  The learning rate falls linearly to a tenth.
    """
    spark = docs.sparkSession
    listed = vocabulary(docs, tok, least, size)
    names, counts = [r.w for r in listed], np.array([r.n for r in listed], np.int64)
    v = len(names)
    known = spark.sparkContext.broadcast(pa.array(names, pa.string()))
    clean = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(tok).alias("t"))

    def numbered(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), numbers(batch.column("t"), known.value)], ["id", "seq"])

    count = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // PART_WORDS))
    seqs = clean.mapInArrow(numbered, "id long, seq array<int>").withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts or count)).cast("int"))
    seqs = written(seqs, "sequences")
    start = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda j: ((F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(1 << 20)) / (1 << 20) - 0.5) / size).cast("float"))
    made = written(seqs.select("id", start.alias("vec")), "documents")
    rng = np.random.default_rng(seed)
    inputs = ((rng.random((v, size)) - 0.5) / size).astype(np.float32)
    tree = huffman(counts) if not negatives else None
    outputs = np.zeros((v, size), np.float32)
    draw = np.cumsum(counts**0.75) / (counts**0.75).sum() if v else np.zeros(0)
    losses = []
    if not v:
        rounds = 0
    for r in range(rounds):
        held = spark.sparkContext.broadcast((inputs, outputs))
        rate = [alpha * (1 - 0.9 * (r + x) / rounds) for x in (0.0, 1.0)]

        def run(key, table):  # sent at once, within this round
            own_in, own_out = (x.copy() for x in held.value)
            ids, vec = table["id"].to_numpy(), stacked(table["vec"], size).copy()
            seq = table["seq"].combine_chunks()
            long_, flat = pa.compute.list_value_length(seq).to_numpy(), pa.compute.list_flatten(seq).to_numpy()
            r_ = np.random.default_rng([seed, r, int(key[0].as_py())])
            loss, pairs = train(vec, flat, long_, own_in, own_out, tree, draw, window if words else 0, negatives, rate, batch, r_)
            out = [pa.table({"kind": pa.array(np.zeros(len(ids), np.int8)), "id": ids, "vec": listed_rows(vec), "loss": np.zeros(len(ids)), "pairs": np.zeros(len(ids))})]
            for kind, new, old in ((1, own_in, held.value[0]), (2, own_out, held.value[1])):
                rows = np.flatnonzero((new != old).any(axis=1))
                out.append(pa.table({"kind": pa.array(np.full(len(rows), kind, np.int8)), "id": rows, "vec": listed_rows(new[rows] - old[rows]), "loss": np.zeros(len(rows)), "pairs": np.zeros(len(rows))}))
            out.append(pa.table({"kind": pa.array([3], pa.int8()), "id": [0], "vec": pa.array([[]], pa.list_(pa.float32())), "loss": [loss], "pairs": [float(pairs)]}))
            return pa.concat_tables(out)

        schema = "kind byte, id long, vec array<float>, loss double, pairs double"
        done = written(seqs.join(made, "id").groupBy("part").applyInArrow(run, schema), "round")
        held.unpersist()
        made = done.where("kind = 0").select("id", "vec")
        steps = done.where("kind in (1, 2)").select("kind", "id", F.posexplode("vec").alias("j", "x")).groupBy("kind", "id", "j").agg(F.avg("x").cast("float").alias("x"))
        steps = steps.groupBy("kind", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("x")).toArrow()
        for kind, into in ((1, inputs), (2, outputs)):
            own = steps.filter(pa.compute.equal(steps["kind"], kind))
            if len(own):
                into[own["id"].to_numpy()] += np.stack(own["x"].to_numpy()).astype(np.float32)
        total = done.where("kind = 3").agg(F.sum("loss"), F.sum("pairs")).first()
        losses.append(total[0] / max(1.0, total[1]))
    return Model(names, counts, inputs, outputs, made.select(F.col("id").alias(key), F.col("vec").alias("vector")), losses)


def numbers(texts: pa.Array, names: pa.Array) -> pa.Array:
    """Lists of words as lists of the places of known ones; empty for null."""
    size = pa.compute.fill_null(pa.compute.list_value_length(texts), 0).to_numpy()
    found = pa.compute.index_in(pa.compute.list_flatten(texts).cast(pa.string()), value_set=names, skip_nulls=True)
    kept = pa.compute.is_valid(found).to_numpy(zero_copy_only=False)
    end = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(size)))]
    return pa.ListArray.from_arrays(pa.array(end, pa.int32()), found.drop_null())


def stacked(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return pa.compute.list_flatten(column.combine_chunks()).to_numpy().reshape(-1, size)


def listed_rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))


def train(vec: np.ndarray, flat: np.ndarray, long_: np.ndarray, inputs: np.ndarray, outputs: np.ndarray, tree: Tree | None, draw: np.ndarray, window: int, negatives: int, rate: list[float], batch: int, rng: np.random.Generator) -> tuple[float, int]:
    """One pass over some documents (``flat``: their words one after the other, ``long_``: how many), in place.

    Documents are walked in runs of ``RUN`` words, the k-th words of ``batch`` runs at a time, so that a document's vector moves
    with each of its words, or with one of each of its runs if it is long.
    """
    loss, total = 0.0, len(flat)
    end = np.cumsum(long_)
    runs = -(-long_ // RUN)
    doc = np.repeat(np.arange(len(long_)), runs)
    begin = (end - long_)[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
    size = np.minimum(end[doc] - begin, RUN)
    order = np.argsort(size, kind="stable")
    seen = 0
    for lo in range(0, len(order), batch):
        own = order[lo : lo + batch]
        for k in range(int(size[own[-1]])):
            now = own[np.searchsorted(size[own], k, side="right") :]
            docs, place = doc[now], begin[now] + k
            step = rate[0] + (rate[1] - rate[0]) * seen / total
            seen += len(now)
            around = None
            if window:
                # words around predict the word: one drawn distance of both sides
                reach = rng.integers(1, window + 1, len(now))
                at = np.stack((place - reach, place + reach), axis=1)
                inside = (at >= (end - long_)[docs][:, None]) & (at < end[docs][:, None])
                around = np.where(inside, flat[np.clip(at, 0, total - 1)], -1)
            loss += _move(vec, docs, inputs, around, flat[place], outputs, tree, draw, negatives, step, rng)
    return loss, total


def _move(vec: np.ndarray, docs: np.ndarray, inputs: np.ndarray, around: np.ndarray | None, target: np.ndarray, outputs: np.ndarray, tree: Tree | None, draw: np.ndarray, negatives: int, step: float, rng: np.random.Generator) -> float:
    """Moves documents, and words ``around`` (-1: none), to where they foretell the target words better."""
    if tree is not None:
        rows, labels = tree.nodes[target], tree.codes[target]
    else:
        other = np.searchsorted(draw, rng.random((len(target), negatives))).astype(np.int64)
        rows = np.concatenate((target[:, None], np.where(other == target[:, None], -1, other)), axis=1)
        labels = np.ones(rows.shape, np.float32)
        labels[:, 0] = 0
    h = vec.take(docs, axis=0)[:, None, :]
    some = np.ones((len(docs), 1), bool)
    if around is not None:
        h = np.concatenate((h, inputs.take(np.maximum(around, 0), axis=0)), axis=1)
        some = np.concatenate((some, around >= 0), axis=1)
    loss, g, gh = gradients(h, outputs, rows, labels)
    g, gh = g * (-step * some[:, :, None]).astype(h.dtype), gh * h.dtype.type(-step)
    one = np.ones((len(docs), 1), h.dtype)
    _add(vec, docs, np.arange(len(docs)), one, gh[:, :1], 16.0)
    if around is not None:
        i, j = np.nonzero(some[:, 1:])
        near = gh[i, j + 1][:, None, :]
        _add(inputs, around[i, j], np.arange(len(i)), np.ones((len(i), 1), h.dtype), near, 16.0)
    i, j = np.nonzero(rows >= 0)
    _add(outputs, rows[i, j], i, g.transpose(0, 2, 1)[i, j], h, 16.0)
    return float(loss.sum())


def nearest_documents(documents: DataFrame, key: str, vector: str) -> DataFrame:
    """Unit vectors, for searches by cosine."""
    return documents.select(key, normalise(F.col(vector)).alias(vector))
