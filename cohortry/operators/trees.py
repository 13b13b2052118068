"""Trees from mergeable histograms: forests of leaf-limited trees grown best first, and boosting by gradients and hessians."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import drop_written, written


@dataclass
class Node:
    """A split (feature, bin: values of at most that bin go left, missing_left) or a leaf."""

    totals: np.ndarray
    depth: int
    feature: int = -1
    bin: int = -1
    missing_left: bool = True
    gain: float = 0.0
    children: tuple[int, int] | None = None
    value: float = 0.0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of bins (0: missing) ends in."""
        at = np.zeros(len(x), np.int32)
        for i, n in enumerate(self.nodes):  # parents come before their children
            if n.children:
                here = np.flatnonzero(at == i)
                v = x[here, n.feature]
                left = np.where(v == 0, n.missing_left, v <= n.bin)
                at[here] = np.where(left, *n.children)
        return at


def binned(df: DataFrame, cols: Sequence[str], label: str, bins: int = 64, error: float = 1e-3, *, grouped: bool = False) -> tuple[DataFrame, list[np.ndarray]]:
    """(x: array<int> of bins, 1 and up, 0 for null or NaN; y; key: 64-bit hash of the row) and the cuts of each column, quantiles of its values.

    ``grouped``: equal rows, which share a key and so are drawn together, are one row with their number ``n``.
    """
    clean = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)), F.col(label).cast("double").alias("y"))
    share = [i / bins for i in range(1, bins)]
    found = clean.approxQuantile([f"c{i}" for i in range(len(cols))], share, error)  # cols x bins numbers
    cuts = [np.unique(np.array([v for v in q if v == v], np.float64)) for q in found]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.zeros((len(f), len(cuts)), np.int32)
            for j, c in enumerate(cuts):
                v = f[f"c{j}"].to_numpy(np.float64)
                x[:, j] = np.where(np.isnan(v), 0, np.searchsorted(c, v, side="left") + 1)
            yield pd.DataFrame({"x": list(x)} | {c: f[c] for c in f.columns[len(cuts) :]})

    keyed = clean.where("y is not null").withColumn("key", F.xxhash64(*clean.columns))
    if grouped:
        keyed = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n"))
    return written(keyed.mapInPandas(run, "x array<int>, y double, key long" + ", n long" * grouped), "binned"), cuts


def hash01(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in 0 to 1 for each key, the same wherever the row is."""
    with np.errstate(over="ignore"):
        z = key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


#: Up to how many times a row is drawn: the chance of more is below 1e-9.
DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 13)]))


def bootstrap(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn, Poisson with mean 1: what drawing n of n rows with replacement comes to, decided row by row."""
    return np.searchsorted(DRAWN, hash01(key, seed * 1_000_003 + tree), side="right").astype(np.float64)


def _features(tree: int, node: int, n: int, k: int, seed: int) -> np.ndarray:
    return np.sort(np.random.default_rng([seed, tree, node]).permutation(n)[:k])


def _sums(df: DataFrame, job, width: int) -> dict[tuple[int, int], np.ndarray]:
    """Histograms by (tree, node): ``job`` maps (x, y, key) arrays, and n of grouped rows, to rows (tree, node, flat histogram); added up place by place in Spark, a row a tree, node and feature."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for f in frames:
            if len(f):
                for at, h in job(np.stack(f["x"].to_numpy()), *(f[c].to_numpy() for c in f.columns[1:])):
                    total[at] = total[at] + h if at in total else h
        for (tree, node), h in total.items():
            for j in range(h.shape[0]):
                yield pd.DataFrame({"tree": [tree], "node": [node], "feature": [j], "h": [h[j].ravel()]})

    rows = df.mapInPandas(run, "tree int, node int, feature int, h array<double>")
    one = rows.select("tree", "node", "feature", F.posexplode("h").alias("i", "v")).where("v <> 0").groupBy("tree", "node", "feature", "i").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    listed = one.groupBy("tree", "node", "feature").agg(F.collect_list("i").alias("i"), F.collect_list("v").alias("v"))
    for r in listed.toLocalIterator():  # a row a tree, open node and feature
        h = np.zeros(width)
        h[r.i] = r.v
        out.setdefault((r.tree, r.node), {})[r.feature] = h
    return out


def best_split(h: np.ndarray, gain, least, features: Sequence[int]) -> tuple[float, int, int, bool, np.ndarray, np.ndarray] | None:
    """Of one node's histograms (feature, bin, statistic): the split of largest gain (ties: lowest feature, bin, missing values left), with both sides' totals.

    Bin 0 holds missing values, which try both sides.  ``gain`` and ``least`` take the statistics of left, right.
    """
    best = None
    for j in features:
        whole, missing = h[j].sum(axis=0), h[j, 0]
        left = np.cumsum(h[j, 1:], axis=0)[:-1]
        for side in (True, False) if missing.any() else (True,):
            a = left + (missing if side else 0)
            b = whole - a
            ok = least(a, b)
            if not ok.any():
                continue
            g = np.where(ok, gain(a, b), -np.inf)
            k = int(np.argmax(g))
            if g[k] > 1e-12 and (best is None or g[k] > best[0] + 1e-12):
                best = (float(g[k]), int(j), k + 1, side, a[k], b[k])
    return best


# ---- forest


def _impurity(c: np.ndarray) -> np.ndarray:
    """Weight times Gini impurity of class weights in the last axis."""
    w = c.sum(axis=-1)
    return w - (c * c).sum(axis=-1) / np.maximum(w, 1e-300)


def _forest_gain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Statistics: class weights, rows last."""
    return _impurity(a[..., :-1] + b[..., :-1]) - _impurity(a[..., :-1]) - _impurity(b[..., :-1])


def _forest_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., -1] >= 1) & (b[..., -1] >= 1)


def prune_best_first(tree: Tree, leaves: int) -> Tree:
    """The part of a tree that growing best first, with at most ``leaves`` leaves, would have made.

    A split's gain does not hang on the order of splits, so a tree grown whole and then taken in order of
    gain (ties: the node that was open first) is the same.
    """
    out = Tree([Node(tree.nodes[0].totals, 0)])
    heap, opened = [], 0

    def offer(old: int, new: int) -> None:
        nonlocal opened
        if tree.nodes[old].children:
            heapq.heappush(heap, (-tree.nodes[old].gain, opened, old, new))
            opened += 1

    offer(0, 0)
    count = 1
    while heap and count < leaves:
        _, _, old, new = heapq.heappop(heap)
        n = tree.nodes[old]
        kids = len(out.nodes), len(out.nodes) + 1
        out.nodes[new].feature, out.nodes[new].bin, out.nodes[new].missing_left, out.nodes[new].gain, out.nodes[new].children = n.feature, n.bin, n.missing_left, n.gain, kids
        for c in n.children:
            out.nodes.append(Node(tree.nodes[c].totals, n.depth + 1))
        for c, k in zip(n.children, kids, strict=True):
            offer(c, k)
        count += 1
    return out


def forest(df: DataFrame, cols: Sequence[str], label: str, *, trees: int = 5000, depth: int = 5, least_rows: int = 100, leaves: int = 200, tried: int | None = None, bins: int = 64, group: int = 50, seed: int = 42) -> Iterator[Tree]:
    """Trees of a forest of two classes, a group of them at a time.

    Each tree draws its rows anew and weighs the classes of its own sample to balance; a node of ``least_rows`` rows or more
    tries ``tried`` columns (the root of their number).  A group's nodes of one depth are split by one pass
    over the table: tasks add up histograms of all its trees, Spark adds these up, the driver holds bins x columns numbers for
    each open node of the group.  Trees are cut to ``leaves`` in best-first order.  Rows without label are left out;
    missing values go to the better side; equal rows are drawn together.
    """
    rows, cuts = binned(df, cols, label, bins)
    d, width = len(cols), max(map(len, cuts), default=0) + 2
    k = tried or max(1, int(np.sqrt(d)))
    for lo in range(0, trees, group):
        names = list(range(lo, min(trees, lo + group)))

        def count(x, y, key):
            for t in names:
                w = bootstrap(key, t, seed)
                yield (t, 0), np.array([[(w * (y != 1)).sum(), (w * (y == 1)).sum()]])

        share = _sums(rows, count, 2)
        weigh = {t: share[t, 0][0].sum() / 2 / np.maximum(share[t, 0][0], 1e-9) for t in names if (t, 0) in share}
        grown = {t: Tree([Node(np.zeros(3), 0)]) for t in weigh}
        open_ = {t: [0] for t in weigh}
        for level in range(depth + 1):
            if not any(open_.values()):
                break
            todo = {t: list(v) for t, v in open_.items() if v}

            def histograms(x, y, key):
                for t, nodes in todo.items():
                    w = bootstrap(key, t, seed)
                    in_bag = np.flatnonzero(w)
                    at = grown[t].route(x[in_bag])
                    cls = (y[in_bag] == 1).astype(np.int64)
                    weight = w[in_bag] * weigh[t][cls]
                    for n in nodes:
                        own = np.flatnonzero(at == n)
                        if not len(own):
                            continue
                        h = np.zeros((d, width, 3))
                        for j in range(d):
                            b = x[in_bag[own], j]
                            for c in (0, 1):
                                h[j, :, c] = np.bincount(b, weight[own] * (cls[own] == c), width)
                            h[j, :, 2] = np.bincount(b, minlength=width)
                        yield (t, n), h

            found = _sums(rows, histograms, width * 3)
            for t, nodes in todo.items():
                tree, new = grown[t], []
                for n in nodes:
                    if (t, n) not in found:
                        continue
                    h = np.zeros((d, width, 3))
                    for j, v in found[t, n].items():
                        h[j] = v.reshape(width, 3)
                    tree.nodes[n].totals = h[0].sum(axis=0)
                    if level == depth or tree.nodes[n].totals[2] < least_rows:
                        continue
                    s = best_split(h, _forest_gain, _forest_least, _features(t, _path(tree, n), d, k, seed))
                    if s:
                        gain, j, b, side, left, right = s
                        tree.nodes[n].feature, tree.nodes[n].bin, tree.nodes[n].missing_left, tree.nodes[n].gain = j, b, side, gain
                        tree.nodes[n].children = (len(tree.nodes), len(tree.nodes) + 1)
                        new += tree.nodes[n].children
                        tree.nodes += [Node(left, level + 1), Node(right, level + 1)]
                open_[t] = new
        for t in sorted(grown):
            yield prune_best_first(grown[t], leaves)


def _path(tree: Tree, n: int) -> int:
    """A node's name in the full binary tree."""
    name = {0: 1}
    for i, x in enumerate(tree.nodes):
        if x.children:
            name[x.children[0]], name[x.children[1]] = 2 * name[i], 2 * name[i] + 1
    return name[n]


def forest_importance(found: Iterator[Tree], cols: Sequence[str]) -> list[tuple[str, float]]:
    """Columns by falling importance: their share of each tree's gains, on average over the trees that split."""
    total, n = np.zeros(len(cols)), 0
    for t in found:
        own = np.zeros(len(cols))
        for x in t.nodes:
            if x.children:
                own[x.feature] += x.gain
        if own.sum() > 0:
            total += own / own.sum()
            n += 1
    total /= max(1, n)
    return sorted(zip(cols, total.tolist(), strict=True), key=lambda r: (-r[1], r[0]))


def families(ranked: Sequence[tuple[str, float]], least: dict[str, int], others: int, knee: int) -> list[str]:
    """The first so many columns of each family (a name's part) and of all others, the most important first, then the rest up to the ``knee``."""
    names = [n for n, _ in ranked]
    of = lambda f: [n for n in names if f in n]
    any_ = {n for f in least for n in of(f)}
    must = {n for f, k in least.items() for n in of(f)[:k]} | set([n for n in names if n not in any_][:others])
    order = [n for n in names if n in must] + [n for n in names if n not in must]
    return order[: max(knee, len(must))]


# ---- boosting


@dataclass
class Boosted:
    trees: list[Tree]
    cuts: list[np.ndarray]
    base: float
    rate: float
    columns: list[str]

    def importance(self) -> list[tuple[str, float]]:
        """Columns by falling mean gain of their splits, as shares."""
        gain, n = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for t in self.trees:
            for x in t.nodes:
                if x.children:
                    gain[x.feature] += x.gain
                    n[x.feature] += 1
        mean = gain / np.maximum(n, 1)
        return sorted(zip(self.columns, (mean / max(mean.sum(), 1e-300)).tolist(), strict=True), key=lambda r: (-r[1], r[0]))

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * np.array([n.value for n in t.nodes])[t.route(x)]
        return out

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, probability) of every row."""
        kind, cuts, columns = df.schema[key].dataType.simpleString(), self.cuts, self.columns

        def run(frames):
            for f in frames:
                x = np.zeros((len(f), len(cuts)), np.int32)
                for j, (c, name) in enumerate(zip(cuts, columns, strict=True)):
                    v = f[name].to_numpy(np.float64)
                    x[:, j] = np.where(np.isnan(v), 0, np.searchsorted(c, v, side="left") + 1)
                yield pd.DataFrame({key: f[key], "probability": 1 / (1 + np.exp(-self.margins(x)))})

        return df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).mapInPandas(run, f"{key} {kind}, probability double")


#: Cells (rows x columns) of a table that one task boosts whole; trees after which the rows' margins are written anew, where all tasks work.
ONE_TASK, STORED = 1 << 20, 8


class _Arrays:
    """Rows of one task and their margins."""

    def __init__(self, model: Boosted, x: np.ndarray, y: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.model, self.rows, self.margin = model, (x, y, key, n), np.full(len(x), model.base)

    def sums(self, job, width: int) -> dict[tuple[int, int], dict[int, np.ndarray]]:
        return {at: dict(enumerate(h.reshape(len(h), -1))) for at, h in job(*self.rows, self.margin)}

    def grown(self) -> None:
        """Takes the last tree into the margins."""
        last = self.model.trees[-1]
        self.margin += self.model.rate * np.array([n.value for n in last.nodes])[last.route(self.rows[0])]


class _Table:
    """Rows of all tasks: their margins are written every few trees, a pass adds the trees since then."""

    def __init__(self, model: Boosted, rows: DataFrame):
        self.model, self.rows, self.since = model, rows.withColumn("margin", F.lit(model.base)), 0
        self.path = rows

    def _later(self) -> Boosted:
        return replace(self.model, base=0.0, trees=self.model.trees[self.since :])

    def sums(self, job, width: int) -> dict[tuple[int, int], dict[int, np.ndarray]]:
        later = self._later()
        return _sums(self.rows, lambda x, y, key, n, margin: job(x, y, key, n, margin + later.margins(x)), width)

    def grown(self) -> None:
        if len(self.model.trees) - self.since < STORED:
            return
        later = self._later()

        def run(frames):
            for f in frames:
                if len(f):
                    yield f.assign(margin=f["margin"] + later.margins(np.stack(f["x"].to_numpy())))

        self.rows = written(self.rows.mapInPandas(run, self.rows.schema), "margins")
        drop_written(self.path)
        self.path, self.since = self.rows, len(self.model.trees)


def boosted(df: DataFrame, cols: Sequence[str], label: str, *, trees: int = 100, depth: int = 5, rate: float = 0.3, l2: float = 1.0, least_gain: float = 0.0, least_hessian: float = 1.0, sample: float = 0.9, bins: int = 64, seed: int = 42) -> Boosted:
    """Boosting of the logistic loss by second-order steps.

    A level of a tree is one pass: tasks add up gradients and hessians by node, column and bin.  A split's gain is
    half of G^2 / (H + l2) of both sides less that of the whole, less ``least_gain``; missing values go to the side of larger gain.
    ``sample`` of the rows, by hash, make each tree; leaves are -G / (H + l2).  Equal rows are counted once, before the first pass;
    if no more than ``ONE_TASK`` cells are left of them, one task makes all passes.
    """
    rows, cuts = binned(df, cols, label, bins, grouped=True)
    model = Boosted([], cuts, 0.0, rate, list(cols))
    grow = lambda model, table: _grow(model, table, trees, depth, l2, least_gain, least_hessian, sample, seed)
    count = rows.count()
    if count * len(cols) > ONE_TASK:
        table = _Table(model, rows)
        grow(model, table)
        drop_written(table.path)
        return model

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat([f for f in frames if len(f)])
        yield pd.DataFrame({"trees": [pickle.dumps(grow(model, _Arrays(model, np.stack(f["x"].to_numpy()), *(f[c].to_numpy() for c in ("y", "key", "n")))).trees)]})

    if count:
        model.trees = pickle.loads(rows.coalesce(1).mapInPandas(whole, "trees binary").first().trees)
    else:
        grow(model, _Arrays(model, np.zeros((0, len(cols)), np.int32), *(np.zeros(0, t) for t in (float, np.int64, np.int64))))
    drop_written(rows)
    return model


def _grow(model: Boosted, table: _Arrays | _Table, trees: int, depth: int, l2: float, least_gain: float, least_hessian: float, sample: float, seed: int) -> Boosted:
    """Adds so many trees to a model."""
    d, width = len(model.columns), max(map(len, model.cuts), default=0) + 2
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    gain = lambda a, b: 0.5 * (score(a) + score(b) - score(a + b)) - least_gain
    least = lambda a, b: (a[..., 1] >= least_hessian) & (b[..., 1] >= least_hessian)
    for t in range(trees):
        tree, open_ = Tree([Node(np.zeros(2), 0)]), [0]
        for level in range(depth + 1):
            if not open_:
                break
            todo = list(open_)

            def histograms(x, y, key, count, margin):
                own = np.flatnonzero(hash01(key, seed * 7919 + t) < sample) if sample < 1 else np.arange(len(x))
                x, y, count = x[own], y[own], count[own]
                p = 1 / (1 + np.exp(-margin[own]))
                g, h = (p - (y == 1)) * count, p * (1 - p) * count
                at = tree.route(x)
                for n in todo:
                    i = np.flatnonzero(at == n)
                    if len(i):
                        out = np.zeros((d, width, 2))
                        for j in range(d):
                            out[j, :, 0], out[j, :, 1] = np.bincount(x[i, j], g[i], width), np.bincount(x[i, j], h[i], width)
                        yield (t, n), out

            found = table.sums(histograms, width * 2)
            open_ = []
            for n in todo:
                if (t, n) not in found:
                    continue
                h = np.zeros((d, width, 2))
                for j, v in found[t, n].items():
                    h[j] = v.reshape(width, 2)
                node = tree.nodes[n]
                node.totals = h[0].sum(axis=0)
                node.value = float(-node.totals[0] / (node.totals[1] + l2))
                s = best_split(h, gain, least, range(d)) if level < depth else None
                if s:
                    node.gain, node.feature, node.bin, node.missing_left, left, right = s
                    node.children = (len(tree.nodes), len(tree.nodes) + 1)
                    open_ += node.children
                    tree.nodes += [Node(left, level + 1), Node(right, level + 1)]
        model.trees.append(tree)
        table.grown()
    return model
