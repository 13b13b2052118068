"""Embedding near-duplicates: exact cosine threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, fold_edges, fresh, saved
from ..sources.files import map_file, put_file

#: Nodes of so many points at most are not divided further.
LEAF = 48
#: Distances below this are not told apart from rounding.
SLACK = 1e-7
#: More than products of unit vectors in single precision err.
SINGLE = 1e-4
#: Sides of a block of distances, and point pairs up to which two nodes are compared point by point.
TALL, WIDE, PAIRS = 512, 2048, 1 << 20


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def cover(x: np.ndarray, radius: float, first: int = 0) -> np.ndarray | None:
    """A cover of unit vectors that has ``first`` as a centre: for each the nearest chosen centre; every point is within ``radius`` of one, centres are further apart.

    None where most points would be centres, so that a cover tells nothing.
    """
    centre = np.full(len(x), -1)
    chosen: list[int] = [first]
    least = 1 - radius * radius / 2  # as a cosine
    for b in range(0, len(x), 256):
        part = x[b : b + 256]
        best = (part @ x[chosen].T).max(axis=1)
        mutual = None
        for i in np.flatnonzero(best < least).tolist():
            if best[i] < least:
                mutual = part @ part.T if mutual is None else mutual
                chosen.append(b + i)
                np.maximum(best, mutual[i], out=best)
        if len(chosen) > max(64, (b + len(part)) // 2):
            return None
    c = np.array(chosen)
    for b in range(0, len(x), 1024):
        centre[b : b + 1024] = c[(x[b : b + 1024] @ x[c].T).argmax(axis=1)]
    centre[c] = c
    return centre


@dataclass
class Node:
    """Points of a subtree, its centre, and how far the furthest of them lies; children or None."""

    points: np.ndarray
    centre: int
    radius: float
    children: list[Node] | None = None
    #: of the children: centres, radii, and which have more than one point
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def build(x: np.ndarray, points: np.ndarray, centre: int, radius: float, enough: float) -> Node:
    """The nested levels below a centre: each level's covers have half the radius of the one above and keep its centres, down to ``enough``."""
    far = float(_chord(x[points] @ x[centre]).max()) + SLACK
    node = Node(points, centre, far if len(points) > 1 else 0.0)
    if len(points) <= LEAF or far <= enough:
        return node
    # the first level that divides the node
    step = radius
    while step >= far:
        step /= 2
    of = cover(x[points], step, int(np.flatnonzero(points == centre)[0]))
    if of is None:
        return node
    of = points[of]
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1])))
    groups = np.split(points[order], cut[1:])
    heads = of[order][cut]
    node.children = [build(x, g, int(h), step / 2, enough) if len(g) > 1 else Node(g, int(h), 0.0) for g, h in zip(groups, heads, strict=True)]
    node.centres = heads
    node.radii = np.array([c.radius for c in node.children])
    return node


class Join:
    """Links between the points of two trees (or of one with itself)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, mult_x: np.ndarray, mult_y: np.ndarray, cosine: float, same: bool, basis: np.ndarray):
        self.x, self.y, self.cosine, self.same = x, y, cosine, same
        self.lead_x = leading(x, basis)
        self.lead_y = self.lead_x if same else leading(y, basis)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.mx, self.my = mult_x.astype(np.float64), mult_y.astype(np.float64)
        self.reach = math.sqrt(2 - 2 * cosine)
        self.links_x, self.links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def _level(self, n: Node) -> tuple[np.ndarray, np.ndarray, list[Node] | None]:
        return (n.points, np.zeros(len(n.points)), None) if n.children is None else (n.centres, n.radii, n.children)

    def run(self, a: Node, b: Node) -> None:
        """Compares two subtrees: node pairs too far apart are pruned, near ones opened; small ones are compared point by point."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if len(a.points) * len(b.points) <= PAIRS or a.children is None and b.children is None:
                self._direct(a.points, b.points)
                continue
            ca, ra, na = self._level(a)
            cb, rb, nb = self._level(b)
            for i in range(0, len(ca), TALL):
                for j in range(0, len(cb), WIDE):
                    dot = self.x[ca[i : i + TALL]] @ self.y[cb[j : j + WIDE]].T
                    own_a, own_b = ra[i : i + TALL], rb[j : j + WIDE]
                    rows, cols = np.flatnonzero(own_a > 0), np.flatnonzero(own_b > 0)
                    ok = dot >= self.cosine
                    ok[rows] = False
                    ok[:, cols] = False
                    self._points(ca[i : i + TALL], cb[j : j + WIDE], ok)
                    if not len(rows) and not len(cols):
                        continue
                    far = _chord(dot)
                    # a node of several points against all that is near it: the nodes that are large with it one by one, the rest at once
                    for p in rows.tolist():
                        near = np.flatnonzero(far[p] <= self.reach + own_a[p] + own_b + SLACK)
                        m, rest = na[i + p], []
                        for q in near.tolist():
                            n = nb[j + q] if nb else None
                            size = len(n.points) if n else 1
                            if size * len(m.points) > PAIRS:
                                if far[p, q] + own_a[p] + own_b[q] <= self.reach - 2 * SLACK:
                                    self._all(m, n)
                                else:
                                    todo.append((m, n))
                            else:
                                rest.append(n.points if n else cb[j + q : j + q + 1])
                        if rest:
                            self._direct(m.points, np.concatenate(rest))
                    single = np.flatnonzero(own_a == 0)
                    for q in cols.tolist():
                        near = single[far[single, q] <= self.reach + own_b[q] + SLACK]
                        if len(near):
                            self._direct(ca[i + near], nb[j + q].points)

    def _direct(self, a: np.ndarray, b: np.ndarray) -> None:
        """Point by point: a bound from the leading coordinates in single precision first, then the cosines of the pairs it leaves in double precision."""
        low = np.float32(self.cosine - SINGLE)
        for j in range(0, len(b), WIDE):
            own_b = b[j : j + WIDE]
            lead = self.lead_y[own_b].T.copy()
            for i in range(0, len(a), TALL):
                own_a = a[i : i + TALL]
                at = np.flatnonzero((self.lead_x[own_a] @ lead).ravel() >= low)
                if not len(at):
                    continue
                if len(at) * 32 > len(own_a) * len(own_b):
                    self._points(own_a, own_b, self.x[own_a] @ self.y[own_b].T >= self.cosine)
                    continue
                p, q = own_a[at // len(own_b)], own_b[at % len(own_b)]
                for k in range(0, len(p), 1 << 14):
                    s = slice(k, k + (1 << 14))
                    ok = np.einsum("ij,ij->i", self.x[p[s]], self.y[q[s]]) >= self.cosine
                    if self.same:
                        ok &= p[s] != q[s]
                    if ok.any():
                        self.held.append((p[s][ok], q[s][ok]))
                        if len(self.held) > 256:
                            self._settle()

    def _settle(self) -> None:
        """Counts the links held one by one, and keeps their forest."""
        if not self.held:
            return
        p, q = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        self.links_x += np.bincount(p, self.my[q], len(self.x)).astype(np.int64)
        if not self.same:
            self.links_y += np.bincount(q, self.mx[p], len(self.y)).astype(np.int64)
        self._keep(*fold_edges(p, q if self.same else q + len(self.x)))

    def _points(self, ids_a: np.ndarray, ids_b: np.ndarray, ok: np.ndarray) -> None:
        """Counts and keeps the links of two sets of points, each set without repeats."""
        if self.same:
            ok &= ids_a[:, None] != ids_b[None, :]
        row, col = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        if not len(row):
            return
        ok, ids_a, ids_b = ok[np.ix_(row, col)], ids_a[row], ids_b[col]
        part = ok.astype(np.float64)
        self.links_x[ids_a] += (part @ self.my[ids_b]).astype(np.int64)
        if not self.same:
            self.links_y[ids_b] += (self.mx[ids_a] @ part).astype(np.int64)
        # one link of each row and column first, then those that still join two trees
        names_a, names_b = ids_a, ids_b if self.same else ids_b + len(self.x)
        a = np.concatenate((names_a, names_a[ok.argmax(axis=0)]))
        b = np.concatenate((names_b[ok.argmax(axis=1)], names_b))
        hi, lo = fold_edges(a, b)
        root = {}
        root.update(zip(hi.tolist(), lo.tolist(), strict=True))
        of_a = np.array([root.get(k, k) for k in names_a.tolist()])
        of_b = np.array([root.get(k, k) for k in names_b.tolist()])
        p, q = np.nonzero(ok & (of_a[:, None] != of_b[None, :]))
        self._keep(hi, lo)
        if len(p):
            self._keep(*fold_edges(of_a[p], of_b[q]))

    def _all(self, m: Node, n: Node) -> None:
        """Every point of one node links with every point of the other."""
        self.links_x[m.points] += int(self.my[n.points].sum())
        if self.same:
            both = np.intersect1d(m.points, n.points, assume_unique=True)
            self.links_x[both] -= self.mx[both].astype(np.int64)
        else:
            self.links_y[n.points] += int(self.mx[m.points].sum())
        shift = 0 if self.same else len(self.x)
        self._keep(*fold_edges(np.concatenate((m.points, np.full(len(n.points), m.points[0]))), np.concatenate((np.full(len(m.points), n.points[0] + shift), n.points + shift))))

    def _keep(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, b))
        if sum(len(e[0]) for e in self.edges[-64:]) > 1 << 18 or len(self.edges) > 4096:
            self.edges = [self.forest()]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        if not self.edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return fold_edges(*(np.concatenate(e) for e in zip(*self.edges, strict=True)))


def leading(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates in a few directions and the length of the rest: a product of two of these is never below that of the vectors, but for rounding."""
    own = x @ basis
    rest = np.sqrt(np.maximum(1 - (own * own).sum(axis=1), 0))
    return np.column_stack((own, rest)).astype(np.float32)


def directions(sample: np.ndarray, cosine: float) -> np.ndarray:
    """As few principal directions of a sample as leave one of a thousand of its pairs to be compared in full (the number only sets the speed)."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    vectors = vectors[:, ::-1]
    some = sample[:1024]
    for k in range(8, sample.shape[1], 8):
        own = leading(some, vectors[:, :k])
        if (own @ own.T >= cosine - SINGLE).mean() <= 1e-3 + 1 / max(1, len(some)):
            return vectors[:, :k].copy()
    return vectors.copy()


def top_tree(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, list[list[int]]]:
    """Centres of the top levels, built on a sample, and for each level the centre each centre belongs to.

    Level after level with half the radius, until there are ``leaves`` centres; if the last
    level has more, its first ``leaves`` in the order of the cover stay.
    """
    centres, levels, radius = np.zeros(1, np.int64), [], 1.0
    while len(centres) < leaves and radius > 2**-6:
        of = cover(sample, radius)
        found = np.unique(of) if of is not None else np.arange(len(sample))
        found = found[np.argsort(~np.isin(found, centres), kind="stable")][:leaves]  # nested: centres stay centres
        found = np.unique(np.concatenate((centres, found)))[: max(leaves, len(centres))]
        levels.append(centres)
        centres, radius = found, radius / 2
    return sample[centres], [lv.tolist() for lv in levels]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.95, chunk_rows: int = 8192, most_leaves: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id long, embedding array).

    Two vectors link when their cosine in double precision is at least ``cosine``.  Vectors
    that are null, empty or zero, or hold null or non-finite components, link with nothing, and
    neither do vectors of different length.  Equal vectors count each other.  A component is
    named by its smallest vec_id; repeated vec_ids each give a row, and rows with a null
    vec_id count and link like others (a component of such rows alone is null); ``kept`` is
    false for them.  Other columns (a label) are ignored.

    1. Equal vectors fall together; a class carries how many it stands for.  2. The top levels
    of a cover tree (radii halve from level to level, centres stay centres) are built on a
    sample of four classes a leaf; every class goes to its nearest leaf centre, and the exact
    covering radius of each leaf is taken from all.  3. Leaves are cut into chunks of about
    ``chunk_rows``; a chunk is written once, with its own cover tree, to the shared folder.
    4. Leaf pairs further apart than both radii and the threshold are pruned; for each pair of
    chunks that is left a task reads both and traverses their trees together: node pairs are
    pruned, taken as linked whole, or opened, by covering radius; points are compared by a
    bound from a few leading directions, then exactly.  A task returns counts and a spanning
    forest, not pairs.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    dtype = np.dtype("<f4" if isinstance(kind, T.FloatType) else "<f8")
    element = "float" if dtype.itemsize == 4 else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("v"))
    good = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(11), "v")))
    full = rows.where("ok")
    classes = full.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("v").alias("v"))
    classes = saved(classes.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    none = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    dims = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # few lengths
    parts = [_links(classes.where(F.col("dim") == d), d, n, dtype, cosine, chunk_rows, most_leaves) for d, n in sorted(dims.items())]
    if not parts:
        return none.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    found = saved(reduce(DataFrame.union, parts), "vector-links")
    comp = components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    count = found.groupBy("node").agg(F.sum("n").alias("n"))
    per = classes.select("k1", "k2", "rep", "mult", "node").join(count, "node", "left").join(comp, F.col("node") == F.col("id"), "left").withColumn("component", F.coalesce("component", "node"))
    name = per.groupBy("component").agg(F.min("rep").alias("component_id"))
    per = per.join(name, "component").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    out = full.select("vec_id", "k1", "k2").join(per, ["k1", "k2"], "left").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.union(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, dim: int, n: int, dtype: np.dtype, cosine: float, chunk_rows: int, most_leaves: int) -> DataFrame:
    """(node, n, root) of the classes of one length: links of a class within a pair of chunks, and the smallest class of its tree there."""
    spark = classes.sparkSession
    leaves = max(1, min(most_leaves, n // chunk_rows))
    some = classes.orderBy(F.xxhash64("k1", "k2"), "node").limit(max(4096, 4 * leaves)).select("v").collect()
    sample = _unit(np.array([r.v for r in some], np.float64))
    centres, _ = top_tree(sample, leaves)
    basis = directions(sample, cosine)
    reach = math.sqrt(2 - 2 * cosine)

    def assign(frames):
        for f in frames:
            x = _unit(np.stack(f["v"].to_numpy())) if len(f) else np.zeros((0, dim))
            dot = x @ centres.T
            leaf = dot.argmax(axis=1)
            yield pd.DataFrame({"node": f["node"], "mult": f["mult"], "leaf": leaf.astype(np.int32), "far": _chord(dot[np.arange(len(x)), leaf]), "v": [v.astype(dtype).tobytes() for v in f["v"]]})

    placed = saved(classes.select("node", "mult", "v").mapInPandas(assign, "node long, mult long, leaf int, far double, v binary"), "vector-leaves")
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        size[r.leaf], radius[r.leaf] = r.n, r.far + SLACK
    chunks = np.maximum(1, -(-size // chunk_rows)).astype(int)
    base = np.concatenate(([0], np.cumsum(chunks)))  # number of a leaf's first chunk
    folder = fresh(spark, "vector-chunks")

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        raw = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype).reshape(table.num_rows, dim)
        x = _unit(raw)
        tree = build(x, np.arange(len(x)), 0, 2.0, reach / 8)
        chunk = table.column("chunk")[0].as_py()
        put_file(f"{folder}/{chunk}", pickle.dumps((raw, table.column("node").to_numpy(), table.column("mult").to_numpy(), tree), protocol=5))
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "n": pa.array([len(x)], pa.int64())})

    def pairs(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                near = np.flatnonzero(_chord(centres[k:] @ centres[k]) <= radius[k] + radius[k:] + reach + SLACK) + k
                for m in near.tolist():
                    i, j = (np.arange(base[q], base[q + 1]) for q in (k, m))
                    i, j = (x.ravel() for x in np.meshgrid(i, j, indexing="ij"))
                    own = i <= j
                    yield pa.RecordBatch.from_arrays([pa.array(i[own], pa.int64()), pa.array(j[own], pa.int64())], names=["i", "j"])

    def traverse(batches):
        held: dict[int, tuple] = {}

        def chunk(k: int) -> tuple:
            if k not in held:
                while len(held) > 2:
                    held.pop(next(iter(held)))
                raw, node, mult, tree = pickle.loads(map_file(f"{folder}/{k}").tobytes())
                held[k] = (_unit(raw), node, mult, tree)
            return held[k]

        for batch in batches:
            for i, j in zip(*(batch.column(c).to_pylist() for c in ("i", "j")), strict=True):
                (x, node_x, mult_x, tree_x), (y, node_y, mult_y, tree_y) = chunk(i), chunk(j)
                join = Join(x, y, mult_x, mult_y, cosine, i == j, basis)
                join.run(tree_x, tree_y)
                a, b = join.forest()
                names, count = (node_x, join.links_x) if i == j else (np.concatenate((node_x, node_y)), np.concatenate((join.links_x, join.links_y)))
                hi, lo = fold_edges(names[a], names[b])
                some = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(count[some]), pa.nulls(int(some.sum()), pa.int64())], names=["node", "n", "root"])
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(np.zeros(len(hi), np.int64)), pa.array(lo)], names=["node", "n", "root"])

    counts = spark.createDataFrame([(k, int(c), int(b)) for k, (c, b) in enumerate(zip(chunks, base[:-1], strict=True))], "leaf int, chunks long, base long")
    dealt = placed.join(F.broadcast(counts), "leaf").withColumn("chunk", F.col("base") + F.pmod(F.xxhash64("node"), F.col("chunks")))  # most_leaves rows at most
    saved(dealt.select("chunk", "node", "mult", "v").groupBy("chunk").applyInArrow(write, "chunk long, n long"), "vector-chunk-list")
    work = saved(spark.range(len(centres)).mapInArrow(pairs, "i long, j long"), "vector-pairs")
    tasks = max(1, min(10_000, work.count()))
    return work.repartition(tasks, "i", "j").sortWithinPartitions("i", "j").mapInArrow(traverse, "node long, n long, root long")
