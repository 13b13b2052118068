"""Density clusters: mutual reachability, exact minimum spanning tree, condensed tree, clusters of largest stability."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import PIVOTS, Blocks, blocks, distances, forest, neighbours, packed, spanning_forest, written

#: Distances below it count as it, so that densities stay finite.
LEAST = 1e-12
#: Edges that a run of block pairs holds before it keeps its forest's only.
HELD = 1 << 20


def core_distances(points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(id, core): distance within which a point has ``k`` others, copies of itself (its weight) among them; its farthest one if there are fewer."""
    w = Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = near.join(points.select("id", (F.col("w") - 1).alias("own")), "id").withColumn("sum", F.col("own") + F.sum("w").over(w))
    core = run.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("sum") >= k, F.col("dist"))), F.max("dist")).alias("core"))
    return points.select("id", "w").join(core, "id", "left").select("id", F.when(F.col("w") - 1 >= k, 0.0).otherwise(F.coalesce("core", F.lit(0.0))).alias("core"))


def reachability_tree(points: DataFrame, space: Blocks, near: DataFrame, core: DataFrame, *, one_task: int = 1 << 18, rounds: list[dict] | None = None) -> DataFrame:
    """The minimum spanning tree (a, b, w) of mutual reachability over all pairs of points, without looking at all.

    The forest of the neighbour graph comes first.  Its trees are joined by edges between one
    point of each, which bounds how far apart, along a tree, any two of its points are.  A pair of
    blocks is looked at only where distance and core distances allow a lighter edge than that bound,
    and returns the forest of its own edges, never all of them.  The tree of all these edges is exact.
    """
    c1, c2 = (core.select(F.col("id").alias(x), F.col("core").alias(f"c{x}")) for x in ("a", "b"))
    edges = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "dist").distinct()
    edges = written(edges.join(c1, "a").join(c2, "b").select("a", "b", F.greatest("dist", "ca", "cb").alias("w")), "near-edges")
    first = spanning_forest(edges, one_task=one_task, rounds=rounds)
    comp = written(tree_of(core.select("id"), first), "trees")
    top = first.join(comp, F.col("a") == F.col("id")).groupBy("tree").agg(F.max("w").alias("top"))
    trees = comp.select("tree").distinct().join(top, "tree", "left").orderBy("tree").limit(PIVOTS + 1).collect()
    k = len(space.centres)
    bound = np.full((k, k), np.inf)
    links = []
    if len(trees) <= PIVOTS:
        names = [r.tree for r in trees]
        at = {t: i for i, t in enumerate(names)}
        tops = np.array([r.top or 0.0 for r in trees])
        reps = {r.id: r for r in points.join(core, "id").join(comp.select("tree").distinct().withColumnRenamed("tree", "id"), "id").select("id", "x", "core").collect()}  # a row a tree
        x, c = np.array([reps[t].x for t in names], np.float64), np.array([reps[t].core for t in names])
        between = np.maximum(np.maximum(distances(x, x), c[:, None]), c[None, :])
        i, j = np.triu_indices(len(names), 1)
        keep = forest(i, j, between[i, j])
        i, j, w = i[keep], j[keep], between[i, j][keep]
        links = [(min(names[p], names[q]), max(names[p], names[q]), float(v)) for p, q, v in zip(i.tolist(), j.tolist(), w.tolist(), strict=True)]
        reach = _reach(tops, i, j, w)
        held = defaultdict(set)
        block_of = space.rows.select("block", "ids").mapInArrow(_members, "block int, id long")
        for r in block_of.join(comp, "id").select("block", "tree").distinct().collect():  # trees of each block: at most PIVOTS a block
            held[r.block].add(at[r.tree])
        inside = np.zeros((k, len(names)), bool)
        for blk, own in held.items():
            inside[blk, list(own)] = True
        for p in range(k):
            per = reach[inside[p]].max(axis=0)
            bound[p] = np.where(inside, per[None, :], 0.0).max(axis=1)
    least = np.zeros(k)
    cored = space.rows.select("block", "ids", "xs").mapInPandas(_spread, "block int, id long, x array<double>").join(core, "id").withColumnRenamed("core", "w")
    full = Blocks(written(packed(cored), "cored"), space.centres, space.radii)
    for r in cored.groupBy("block").agg(F.min("w").alias("least")).collect():
        least[r.block] = r.least
    low = np.maximum(np.maximum(space.lower(), least[:, None]), least[None, :])
    mask = np.triu(low < bound)

    def job(lefts, stream):
        held: list[tuple[np.ndarray, ...]] = []
        for j, read, meets in stream:
            ib, cb, xb = read()
            for i in meets:
                ia, ca, xa = lefts[i]
                m = np.maximum(np.maximum(distances(xa, xb), ca[:, None]), cb[None, :])
                p, q = pair_tree(m, i == j, bound[i, j])
                if len(p):
                    held.append((np.minimum(ia[p], ib[q]), np.maximum(ia[p], ib[q]), m[p, q]))
            if sum(len(e[0]) for e in held) > HELD:
                held = [thinned(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in thinned(held)], ["a", "b", "w"])

    if rounds is not None:
        rounds.append({"blocks": k, "pairs": int(mask.sum())})
    rows = first.union(space.rows.sparkSession.createDataFrame(links, "a long, b long, w double"))
    if mask.any():
        rows = rows.union(full.pairs(mask, job, "a long, b long, w double"))
    return spanning_forest(rows.distinct(), one_task=one_task, rounds=rounds)


def thinned(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The edges (a, b, w) that the minimum spanning forest of all keeps."""
    a, b, w = (np.concatenate([e[c] for e in held]) for c in range(3))
    keep = forest(a, b, w)
    return a[keep], b[keep], w[keep]


def pair_tree(m: np.ndarray, same: bool, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) lighter than ``bound`` of a minimum spanning forest of all pairs of a row and a column; ``same``: rows are the columns.

    Few edges are sorted.  Many are not: the tree grows from the first row by the lightest edge to what
    is not in it, which looks at each number of ``m`` twice at most.
    """
    ok = m < bound
    if same:
        ok &= np.triu(np.ones_like(ok), 1)
    n = int(np.count_nonzero(ok))
    if n <= 16 * sum(m.shape):
        p, q = np.nonzero(ok)
        keep = forest(p, q if same else q + len(m), m[p, q]) if n else np.zeros(0, bool)
        return p[keep], q[keep]
    rows, cols = m.shape
    flat = m if same else np.ascontiguousarray(m.T)
    total = rows if same else rows + cols
    # nodes: rows, then columns; what an added row or column offers to nodes outside
    best, start = np.full(total, np.inf), np.zeros(total, np.int64)
    out = np.ones(total, bool)
    found = np.zeros((total - 1, 2), np.int64)
    at = 0
    for e in range(total - 1):
        out[at] = False
        best[at] = np.inf
        side = slice(0, rows) if same or at >= rows else slice(rows, total)
        offer = m[at] if at < rows else flat[at - rows]
        nearer = (offer < best[side]) & out[side]
        best[side][nearer] = offer[nearer]
        start[side][nearer] = at
        at = int(best.argmin())
        found[e] = start[at], at
    p, q = found.min(axis=1), found.max(axis=1) - (0 if same else rows)
    keep = m[p, q] < bound
    return p[keep], q[keep]


def _members(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["block"], np.int32)), pa.array(ids)], ["block", "id"])


def _spread(frames):
    for f in frames:
        for block, ids, xs in f.itertuples(index=False):
            ids = np.frombuffer(ids, np.int64)
            yield pd.DataFrame({"block": np.full(len(ids), block, np.int32), "id": ids, "x": list(np.frombuffer(xs, np.float64).reshape(len(ids), -1))})


def _reach(tops: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The heaviest edge between points of any two trees along their links, edges inside of trees counted by the heaviest."""
    out = np.zeros((len(tops), len(tops)))
    group = {k: [k] for k in range(len(tops))}
    of, most = np.arange(len(tops)), tops.copy()
    np.fill_diagonal(out, tops)
    for e in np.argsort(w, kind="stable"):
        p, q = of[i[e]], of[j[e]]
        if p == q:
            continue
        v = max(w[e], most[p], most[q])
        out[np.ix_(group[p], group[q])] = v
        out[np.ix_(group[q], group[p])] = v
        group[p] += group.pop(q)
        of[group[p]] = p
        most[p] = v
    return out


def tree_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, tree: smallest id of its tree) by large-star and small-star rounds on written edges."""
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = written(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        ends = new.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(new.select("b", F.lit(0), F.lit(1)))
        e = new
        if ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("root").alias("r")).where("c > 1 or c = 1 and r = 1").isEmpty():
            break
    return nodes.join(e.select(F.col("a").alias("id"), F.col("b").alias("tree")), "id", "left").select("id", F.coalesce("tree", "id").alias("tree"))


class Condensed:
    """Clusters of at least ``least`` points by falling distance, from the edges of a spanning tree in rising order.

    Edges of equal weight are taken at once, so the result does not hang on which of several
    trees was found: at a weight, the components that come together are one new cluster if two or more of
    them are clusters, else smaller ones join the only one; smaller ones that reach ``least`` together begin one.
    """

    def __init__(self, ids: np.ndarray, size: np.ndarray, born: np.ndarray, least: int):
        """``born``: for nodes that are clusters by themselves, the weight at which they are."""
        self.ids, self.least = ids, least
        self.parent: list[int] = []
        self.birth: list[float] = []  # density at which a cluster splits off its parent; 0 of the last one
        self.own_n: list[float] = []  # points that leave it before it splits or ends, and the sum of their densities
        self.own_s: list[float] = []
        self.cluster = np.full(len(ids), -1)  # the cluster that a node's points leave, and at what density
        self.density = np.zeros(len(ids))
        self.of = list(range(len(ids)))  # union-find
        self.members = [[i] for i in range(len(ids))]  # of components without cluster
        self.size, self.now, self.points = size.tolist(), [-1] * len(ids), size
        for i in np.flatnonzero(size >= least).tolist():
            self._begin(i, [i], 1.0 / max(float(born[i]), LEAST))

    def _new(self) -> int:
        for column, value in ((self.parent, -1), (self.birth, 0.0), (self.own_n, 0.0), (self.own_s, 0.0)):
            column.append(value)
        return len(self.parent) - 1

    def _begin(self, root: int, parts: list[int], density: float) -> None:
        self.now[root] = self._new()
        for p in parts:
            self._leave(root, p, density)

    def _leave(self, root: int, part: int, density: float) -> None:
        """The points of a component without cluster leave the cluster of ``root`` at a density."""
        c = self.now[root]
        for i in self.members[part]:
            self.cluster[i], self.density[i] = c, density
            self.own_n[c] += float(self.points[i])
            self.own_s[c] += density * float(self.points[i])
        self.members[part] = []

    def find(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def merge(self, a: list[int], b: list[int], w: float) -> None:
        """All edges of one weight, by positions."""
        density = 1.0 / max(w, LEAST)
        for parts in joined([(self.find(x), self.find(y)) for x, y in zip(a, b, strict=True)]):
            clusters = [p for p in parts if self.now[p] >= 0]
            small = [p for p in parts if self.now[p] < 0]
            root = clusters[0] if clusters else max(parts, key=lambda p: len(self.members[p]))
            for p in parts:
                self.of[p] = root
            self.size[root] = sum(self.size[p] for p in parts)
            if clusters:
                if len(clusters) > 1:
                    new = self._new()
                    for p in clusters:
                        self.parent[self.now[p]], self.birth[self.now[p]] = new, density
                    self.now[root] = new
                for p in small:
                    self._leave(root, p, density)
            elif self.size[root] >= self.least:
                self._begin(root, small, density)
            else:
                for p in small:
                    if p != root:
                        self.members[root] += self.members[p]
                        self.members[p] = []

    def run(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        order = np.argsort(w, kind="stable")
        a, b, w = np.searchsorted(self.ids, a[order]), np.searchsorted(self.ids, b[order]), w[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(w)) + 1, [len(w)])).tolist()
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j > i:
                self.merge(a[i:j].tolist(), b[i:j].tolist(), float(w[i]))

    def left(self, cluster: np.ndarray, density: np.ndarray) -> np.ndarray:
        """The cluster that points which joined (the node of) a cluster at a density leave: the one that it is part of at that density."""
        parent, birth = np.array(self.parent, np.int64), np.array(self.birth)
        while True:
            up = (parent[cluster] >= 0) & (birth[cluster] >= density)
            if not up.any():
                return cluster
            cluster = np.where(up, parent[cluster], cluster)

    def chosen(self, more_n: np.ndarray, more_s: np.ndarray) -> np.ndarray:
        """For each cluster the chosen one that holds it, or -1.

        A cluster is chosen if its stability (for each of its points, the density at which the point leaves it less that at which
        it splits off) is at least that of the chosen ones inside it; the last one, which holds all, never is.
        ``more``: points, and sums of their densities, that left each beside those of ``run``.
        """
        k = len(self.parent)
        n, s = np.array(self.own_n) + more_n, np.array(self.own_s) + more_s
        inner, leaf, pick = np.zeros(k), np.ones(k, bool), np.zeros(k, bool)
        for c in range(k):  # children come before their parents
            own = s[c] - n[c] * self.birth[c]
            pick[c] = leaf[c] or own >= inner[c]
            p = self.parent[c]
            if p >= 0:
                inner[p] += own if pick[c] else inner[c]
                leaf[p] = False
                n[p] += n[c]
                s[p] += n[c] * self.birth[c]
        out = np.full(k, -1)
        for c in range(k - 1, -1, -1):
            p = self.parent[c]
            out[c] = -1 if p < 0 else out[p] if out[p] >= 0 else c if pick[c] else -1
        return out


def joined(links: list[tuple[int, int]]) -> list[list[int]]:
    """Nodes of a few links by component."""
    of: dict[int, list[int]] = {}
    for x, y in links:
        gx, gy = of.setdefault(x, [x]), of.setdefault(y, [y])
        if gx is not gy:
            if len(gx) < len(gy):
                gx, gy = gy, gx
            gx += gy
            for p in gy:
                of[p] = gx
    return [g for g in {id(g): g for g in of.values()}.values() if len(g) > 1]


_CONTRACTED = "node long, into long, density double, size long, born double, left boolean"


def contract(nodes: pd.DataFrame, edges: pd.DataFrame, least: int) -> pd.DataFrame:
    """Joins the nodes of one chunk of a tree that have fewer than ``least`` points, as far as edges to other chunks leave no doubt.

    ``nodes``: node, size, born; ``edges``: a, b, w, with one end here at least.  A row a node: the
    node it is ``into`` now, and the density at which its points leave that one's cluster, null where that is still
    open; size and born for those that are left (into = node).  A component stops at the least of its edges to
    other chunks, and so does what would join it; one that has a cluster takes others in at any weight.
    """
    ids = nodes["node"].to_numpy(np.int64)
    at = {int(v): i for i, v in enumerate(ids)}
    size, born = [int(x) for x in nodes["size"]], [float(x) for x in nodes["born"]]
    of, beyond, stuck = list(range(len(ids))), [np.inf] * len(ids), [False] * len(ids)
    members = [[i] for i in range(len(ids))]
    into, density = list(range(len(ids))), [None] * len(ids)

    def find(i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def leave(p: int, root: int, d: float) -> None:
        for i in members[p]:
            into[i], density[i] = root, d
        members[p] = []

    inner: dict[float, list[tuple[int, int]]] = defaultdict(list)
    for a, b, w in zip(edges["a"].tolist(), edges["b"].tolist(), edges["w"].tolist(), strict=True):
        i, j = at.get(a), at.get(b)
        if i is None or j is None:
            k = j if i is None else i
            beyond[k] = min(beyond[k], w)
        else:
            inner[w].append((i, j))
    for w in sorted(inner):
        d = 1.0 / max(w, LEAST)
        for parts in joined([(find(i), find(j)) for i, j in inner[w]]):
            big = [p for p in parts if size[p] >= least]
            small = [p for p in parts if size[p] < least]
            held = {p for p in small if stuck[p] or beyond[p] <= w}
            for p in held if big else small if held else ():
                stuck[p] = True
            if held and not big:
                continue
            free = [p for p in small if p not in held]
            root = big[0] if big else free[0]
            for p in free:
                if p != root:
                    of[p] = root
                    beyond[root] = min(beyond[root], beyond[p])
            if big:
                for p in free:
                    leave(p, root, d)
                continue
            size[root] = sum(size[p] for p in free)
            if size[root] >= least:
                born[root] = w
                for p in free:
                    leave(p, root, d)
            else:
                for p in free[1:]:
                    members[root] += members[p]
                    members[p] = []
                for i in members[root]:
                    into[i] = root
    final = [into[i] if density[i] is not None else find(i) for i in range(len(ids))]
    root = [find(i) == i for i in range(len(ids))]
    out = pd.DataFrame({"node": ids, "into": ids[final] if len(ids) else ids, "density": pd.array(density, "Float64"), "size": size, "born": born})
    # a node that goes on keeps its name; where its own points left it, that stands in its row
    out["left"] = root
    return out


def skeleton(points: DataFrame, tree: DataFrame, space: Blocks, least: int, limit: int, rounds: list[dict] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree with its small components joined: (points: id, node, density), (nodes: node, size, born), (edges: a, b, w).

    Chunks of a tree, its blocks at first and runs of four times as many in each round, are contracted each by
    a task, until ``limit`` nodes are left or one chunk is: beside at most 1 / ``least`` as many as there are
    points, what is left are components at the borders of chunks.
    """
    block_of = space.rows.select("block", "ids").mapInArrow(_members, "block int, id long")
    nodes = written(points.join(block_of, "id").select(F.col("id").alias("node"), "size", "born", "block"), "nodes")
    where = points.select("id", F.col("id").alias("node"), F.lit(None).cast("double").alias("density"))
    edges, shift = tree, 0
    while True:
        n = nodes.count()
        if rounds is not None:
            rounds.append({"nodes": n})
        if n <= limit:
            break
        chunk = nodes.withColumn("chunk", F.shiftright("block", 2 * shift))
        one = chunk.select("chunk").distinct().count() == 1
        ends = chunk.select("node", "chunk")
        both = edges.join(ends.select(F.col("node").alias("a"), F.col("chunk").alias("ka")), "a").join(ends.select(F.col("node").alias("b"), F.col("chunk").alias("kb")), "b")
        both = both.withColumn("chunk", F.explode(F.array_distinct(F.array("ka", "kb")))).select("chunk", "a", "b", "w")
        run = chunk.select("chunk", "node", "size", "born").groupBy("chunk").cogroup(both.groupBy("chunk"))
        done = written(run.applyInPandas(lambda x, y: contract(x, y, least), _CONTRACTED), "contracted")
        step = done.select("node", "into", F.col("density").alias("d"))
        where = written(where.join(step, "node", "left").select("id", F.when(F.col("density").isNull(), F.col("into")).otherwise(F.col("node")).alias("node"), F.coalesce("density", "d").alias("density")), "where")
        name = done.select("node", "into")
        for c in ("a", "b"):
            edges = edges.join(name.select(F.col("node").alias(c), F.col("into").alias("x")), c).drop(c).withColumnRenamed("x", c)
        edges = written(edges.where("a <> b").select("a", "b", "w"), "edges")
        nodes = written(done.where("left").select("node", "size", "born").join(nodes.select("node", "block"), "node"), "nodes")
        shift += 1
        if one:
            break
    return where, nodes, edges


def density_clusters(df: DataFrame, key: str, vector: str, least: int = 100, *, neighbour_count: int | None = None, block_rows: int = 1024, one_task: int = 1 << 18, rounds: list[dict] | None = None) -> DataFrame:
    """(key, cluster, density): hierarchical density clusters of at least ``least`` rows, -1 for noise; the most stable ones.

    ``key`` is a long.  Distances are Euclidean; core distances reach the ``neighbour_count``-th other row
    (``least`` by default).  density is 1 / distance at which the row leaves its last cluster.  Clusters are numbered by their
    smallest key.  Equal vectors are one point with a weight, so copies cost nothing; rows without a
    vector, or with a null or non-finite component, are noise with a null density; an empty table gives no rows.

    Neighbours and tree are exact, found block by block with bounds on what a pair of blocks can give.  The tree is cut
    into chunks, in which small components are joined by tasks; the driver orders what is then left: a
    row for each component of ``least`` rows, and those at borders (all rows, if they are at most ``one_task``).
    """
    k = neighbour_count or least
    x = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(key).alias("key"), F.when(good, F.transform(x, lambda v: v + 0.0)).alias("x"))
    points = written(rows.where("x is not null and key is not null").groupBy("x").agg(F.min("key").alias("id"), F.count("*").cast("double").alias("w")), "points")
    if points.isEmpty():
        return df.select(key, F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("density"))
    space = blocks(points, block_rows=block_rows)
    near = neighbours(space, k)
    core = written(core_distances(points, near, k), "cores")
    tree = reachability_tree(points, space, near, core, one_task=one_task, rounds=rounds)
    sized = points.select("id", F.col("w").cast("long").alias("size")).join(core.withColumnRenamed("core", "born"), "id")
    where, nodes, edges = skeleton(sized, tree, space, least, one_task, rounds)
    kept = nodes.select("node", "size", "born").orderBy("node").toArrow()
    e = edges.toArrow()
    made = Condensed(kept["node"].to_numpy(), kept["size"].to_numpy(), kept["born"].to_numpy(), least)
    made.run(*(e[c].to_numpy() for c in ("a", "b", "w")))
    if not made.parent:
        found = points.select("id", F.lit(-1).alias("c"), F.lit(0.0).alias("density"))
        label = np.zeros(0, np.int64)
    else:
        found, label = _labelled(where, sized, made)
    out = points.select("id", "x").join(found, "id").select("x", "c", "density")
    named = rows.join(out, "x", "left").select("key", F.coalesce("c", F.lit(-1)).alias("c"), "density")
    if not len(label):
        return named.select(F.col("key").alias(key), F.col("c").cast("int").alias("cluster"), "density")
    named = written(named, "clusters")
    order = named.where("c >= 0").groupBy("c").agg(F.min("key").alias("first")).orderBy("first").collect()  # a row a cluster
    rank = df.sparkSession.createDataFrame([(r.c, i) for i, r in enumerate(order)], "c int, cluster int")
    return named.join(F.broadcast(rank), "c", "left").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"), "density")


def _labelled(where: DataFrame, sized: DataFrame, made: Condensed) -> tuple[DataFrame, np.ndarray]:
    """(id, c: chosen cluster or -1, density) of every point: those that left a node before the driver's part look up which cluster it was in then."""
    ids, of_node, at_node, parent = made.ids, made.cluster, made.density, len(made.parent)
    climb = made.left

    def leave(frames):
        for f in frames:
            if len(f):
                i = np.searchsorted(ids, f["node"].to_numpy())
                early = f["density"].notna().to_numpy()
                c = of_node[i].copy()
                d = np.where(early, f["density"].fillna(0.0).to_numpy(), at_node[i])
                c[early] = climb(c[early], d[early])
                yield pd.DataFrame({"id": f["id"], "size": f["size"], "c": c.astype(np.int32), "density": d})

    rows = written(where.join(sized.select("id", "size"), "id").mapInPandas(leave, "id long, size long, c int, density double"), "left")
    sums = rows.groupBy("c").agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("density")).alias("s")).where("c >= 0").collect()  # a row a cluster
    n, s = np.zeros(parent), np.zeros(parent)
    for r in sums:
        n[r.c], s[r.c] = r.n, r.s
    made.own_n, made.own_s = [0.0] * parent, [0.0] * parent  # all points are in the sums
    chosen = made.chosen(n, s)

    def choose(frames):
        for f in frames:
            c = f["c"].to_numpy()
            yield f.assign(c=np.where(c >= 0, chosen[c], -1).astype(np.int32))[["id", "c", "density"]]

    return rows.select("id", "c", "density").mapInPandas(choose, "id long, c int, density double"), chosen
