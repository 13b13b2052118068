"""Exact nearest neighbours of vectors, and minimum spanning forests of weighted graphs, both as Spark jobs over blocks and rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import map_file, put_file
from ..sources.readers import delete_table, shared_folder

#: Runs of block pairs at least (where there are as many pairs), and left blocks of a run at most.
RUNS, TILE = 64, 8
#: Pivots of blocks at most: what the driver holds of all vectors.
PIVOTS = 4096
#: Pairs measured in double precision at once.
MEASURED = 1 << 16


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    delete_table(df.sparkSession, df.written_path)


def unpack(row_x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(row_x, np.float64).reshape(n, -1)


@dataclass
class Blocks:
    """Vectors in balls around pivots: packed rows (block, ids, ws, xs) and, for each block, centre and radius."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    _folder: str = field(default="", repr=False)

    def folder(self) -> str:
        """Where each block lies as a file in the shared folder: a pair of blocks is read there, never shuffled."""
        if not self._folder:
            path = f"{shared_folder(self.rows.sparkSession)}/block-files-{uuid.uuid4().hex}"

            def put(frames):
                for f in frames:
                    for block, ids, ws, xs in f.itertuples(index=False):
                        put_file(f"{path}/{block}", np.array([len(ids) // 8], np.int64), ids, ws, xs)
                yield pd.DataFrame({"n": [0]})

            self.rows.select("block", "ids", "ws", "xs").mapInPandas(put, "n int").count()
            self._folder = path
        return self._folder

    def drop(self) -> None:
        """Deletes the packed rows and the files of blocks that nothing reads any more."""
        drop_written(self.rows)
        if self._folder:
            delete_table(self.rows.sparkSession, self._folder)

    def lower(self) -> np.ndarray:
        """Least distance that members of two blocks can have."""
        return np.maximum(distances(self.centres, self.centres) - self.radii[:, None] - self.radii[None, :] - 1e-9, 0.0)

    def pairs(self, mask: np.ndarray, job: Callable, schema: str) -> DataFrame:
        return runs(self, self, mask, self.lower(), job, schema)[0]


def load(folder: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weights and vectors of a block."""
    raw = np.asarray(map_file(f"{folder}/{block}"))
    n = int(raw[:8].view(np.int64)[0])
    return raw[8 : 8 + 8 * n].view(np.int64), raw[8 + 8 * n : 8 + 16 * n].view(np.float64), raw[8 + 16 * n :].view(np.float64).reshape(n, -1)


def runs(left: Blocks, right: Blocks, mask: np.ndarray, low: np.ndarray, job: Callable, schema: str) -> tuple[DataFrame, bool]:
    """Runs ``job`` on the block pairs of a mask, and says whether each left block is in one run only.

    A run has up to ``TILE`` left blocks and the right ones that they meet, nearest first (``low``).  ``job`` gets the left blocks
    {i: (ids, ws, xs)} and an iterator of (j, function that reads block j, left blocks that meet it); it yields RecordBatches of what is
    to be kept of the whole run, so what is written grows with the runs, not with the pairs.
    """
    spark = left.rows.sparkSession
    wide = max(1, min(TILE, len(mask) // RUNS))
    parts = -(-RUNS // max(1, -(-len(mask) // wide)))
    listed = []
    for lo in range(0, len(mask), wide):
        own = mask[lo : lo + wide]
        j = np.flatnonzero(own.any(axis=0))
        j = j[np.argsort(low[lo : lo + wide, j].min(axis=0), kind="stable")]
        listed += [(lo, len(own), j[p::parts].tolist(), np.packbits(own[:, j[p::parts]]).tobytes()) for p in range(parts) if len(j[p::parts])]
    if not listed:
        return spark.createDataFrame([], schema), True
    table = pa.table({"lo": pa.array([r[0] for r in listed], pa.int32()), "n": pa.array([r[1] for r in listed], pa.int32()), "j": pa.array([r[2] for r in listed], pa.list_(pa.int32())), "meet": pa.array([r[3] for r in listed], pa.binary())})
    of, to = left.folder(), right.folder()

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lefts = {r["lo"] + i: load(of, r["lo"] + i) for i in range(r["n"])}
                meet = np.unpackbits(np.frombuffer(r["meet"], np.uint8), count=r["n"] * len(r["j"])).reshape(r["n"], -1)
                stream = ((j, lambda j=j: load(to, j), (r["lo"] + np.flatnonzero(meet[:, c])).tolist()) for c, j in enumerate(r["j"]))
                yield from job(lefts, stream)

    return spark.createDataFrame(table).repartition(min(4096, len(listed))).mapInArrow(run, schema), parts == 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(s, 0.0))


def blocks(points: DataFrame, *, block_rows: int = 1024, centre: np.ndarray | None = None) -> Blocks:
    """Deals points (id long, x array<double>, w double) to the nearest of at most ``PIVOTS`` pivots (rows of lowest hash, if no ``centre`` is given); a ball of too many rows is cut by hash."""
    spark = points.sparkSession
    if centre is None:
        n = points.count()
        pivots = points.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, -(-n // block_rows)))).collect()
        centre = np.array([r.x for r in pivots], np.float64).reshape(len(pivots), -1)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                d = distances(np.stack(f["x"].to_numpy()), centre)
                at = d.argmin(axis=1)
                yield f.assign(ball=at.astype(np.int32), far=d[np.arange(len(f)), at])

    dealt = written(points.select("id", "x", F.col("w").cast("double").alias("w")).mapInPandas(near, "id long, x array<double>, w double, ball int, far double"), "dealt")
    found = sorted(dealt.groupBy("ball").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect())
    cut = {r.ball: -(-r.n // (2 * block_rows)) for r in found}
    first = dict(zip(cut, np.cumsum([0, *cut.values()])[:-1].tolist(), strict=True))
    table = spark.createDataFrame([(b, first[b], k) for b, k in cut.items()], "ball int, first int, cut int")
    named = dealt.join(F.broadcast(table), "ball").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("cut"))).cast("int"))
    of = [r for r in found for _ in range(cut[r.ball])]
    rows = written(packed(named), "blocks")
    drop_written(dealt)
    return Blocks(rows, centre[[r.ball for r in of]], np.array([r.r for r in of]))


def packed(named: DataFrame) -> DataFrame:
    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        return pd.DataFrame({"block": [f["block"].iloc[0]], "ids": [f["id"].to_numpy(np.int64).tobytes()], "ws": [f["w"].to_numpy(np.float64).tobytes()], "xs": [np.stack(f["x"].to_numpy()).astype(np.float64).tobytes()]})

    return named.select("block", "id", "w", "x").groupBy("block").applyInPandas(pack, "block int, ids binary, ws binary, xs binary")


class Best:
    """The ``k`` nearest points so far of each point of a left block: exact distances (inf: fewer than k), ids and weights, by distance, then id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.dist, self.other, self.w = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max), np.zeros((len(ids), k))
        with np.errstate(all="ignore"):
            some = x[np.isfinite(np.einsum("ij,ij->i", x, x))]
        self.origin = some.mean(axis=0) if len(some) else np.zeros(x.shape[1])
        self.v, self.size, self.most, self.off = self.moved(x)
        self.scale, self.single = 0.0, np.zeros((0, 0), np.float32)

    @property
    def far(self) -> np.ndarray:
        return self.dist[:, -1]

    def moved(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Vectors from the block's origin, their lengths (nan where squares are not finite: such a vector has no neighbours), the largest length, and the largest rounding error of a vector."""
        with np.errstate(all="ignore"):
            v = y - self.origin
            size = np.sqrt(np.einsum("ij,ij->i", v, v))
            size[~(np.isfinite(np.einsum("ij,ij->i", y, y)) & np.isfinite(size))] = np.nan
        most = float(np.nanmax(size)) if np.isfinite(size).any() else 0.0
        return v, size, most, 2.0**-52 * (most + 2 * float(np.abs(self.origin).sum()))

    def open(self, centre: np.ndarray, radius: float) -> np.ndarray:
        """Which rows can have a neighbour in a ball."""
        v = self.x - centre
        return np.flatnonzero(~(np.sqrt(np.einsum("ij,ij->i", v, v)) - radius > self.far))

    def meet(self, rows: np.ndarray, ids: np.ndarray, ws: np.ndarray, y: np.ndarray, *, same: bool = False) -> None:
        """Takes what a right block has for some rows.

        Squares of distances come from one product of single precision; pairs within its largest error of a row's limit, none less, are
        measured in double precision.
        """
        v, size, most, off = self.moved(y)
        scale = max(self.most, most if most > 1e6 * self.most else 0.0, 1e-140)
        if scale != self.scale:
            self.scale, self.single = scale, _single(-2 * self.v, self.size, scale, first=True)
        reach, off = (self.most + most) / scale, max(off, self.off) * np.sqrt(y.shape[1]) / scale
        slack = (y.shape[1] + 8) * 2.0**-22 * reach**2 + 8 * off * (reach + off)
        s = (self.single if len(rows) == len(self.single) else self.single[rows]) @ _single(v, size, scale, first=False).T
        if same:
            s[np.arange(len(rows)), rows] = np.nan
        limit = (self.far[rows] / scale) ** 2
        new = np.flatnonzero(np.isinf(limit))
        if len(new) and len(y) > self.k:
            kth = np.partition(s[new], self.k - 1, axis=1)[:, self.k - 1] + slack
            limit[new] = np.where(np.isfinite(kth), kth, np.inf)
        with np.errstate(over="ignore"):
            limit = ((limit + slack) * (1 + 2.0**-20)).astype(np.float32)
        some = np.flatnonzero(~(s.min(axis=1) > limit))  # a row with nan may have some
        hit = np.flatnonzero((s if len(some) == len(s) else s[some]) <= limit[some, None])
        rows = rows[some]
        for lo in range(0, len(hit), MEASURED):
            at, c = np.divmod(hit[lo : lo + MEASURED], len(y))
            r = rows[at]
            d = self.x[r] - y[c]
            d = np.sqrt(np.einsum("ij,ij->i", d, d))
            keep = np.isfinite(d) & (d <= self.far[r])
            self.take(r[keep], d[keep], ids[c[keep]], ws[c[keep]])

    def take(self, r: np.ndarray, d: np.ndarray, other: np.ndarray, w: np.ndarray) -> None:
        if not len(r):
            return
        hit, at = np.unique(r, return_inverse=True)
        row = np.concatenate((np.repeat(np.arange(len(hit)), self.k), at))
        d, other, w = (np.concatenate((old[hit].ravel(), new)) for old, new in ((self.dist, d), (self.other, other), (self.w, w)))
        order = np.lexsort((other, d, row))
        row = row[order]
        keep = order[np.arange(len(row)) - np.searchsorted(row, np.arange(len(hit)))[row] < self.k]
        self.dist[hit], self.other[hit], self.w[hit] = (v[keep].reshape(-1, self.k) for v in (d, other, w))


def _single(v: np.ndarray, size: np.ndarray, scale: float, *, first: bool) -> np.ndarray:
    """Vectors over ``scale`` in single precision, with square of length and one (``first``) or one and square behind: a product of both kinds adds the squares up."""
    out = np.ones((len(v), v.shape[1] + 2), np.float32)
    with np.errstate(all="ignore"):
        out[:, :-2] = v / scale
        out[:, -2 if first else -1] = (size / scale) ** 2
    out[np.isnan(size)] = np.nan
    return out


def nearest(left: Blocks, right: Blocks, k: int) -> DataFrame:
    """(id, other, dist, w: of other, rank) of the ``k`` nearest points of the right blocks for each of the left ones, exact; ties by id.

    A run meets the right blocks nearest first and holds the ``k`` best of each of its points so far; a block that
    can have none nearer is not read.  A run returns ``k`` rows a point at most.
    """
    same = left is right
    lc, lr, rc, rr = left.centres, left.radii, right.centres, right.radii
    # radii come from products, which lose half the digits of small distances
    wide = rr + 1e-6 * float(np.max(np.abs(rc).sum(axis=1) + rr, initial=0.0))

    def job(lefts, stream):
        state = {i: Best(ids, x, k) for i, (ids, _, x) in lefts.items()}
        for j, read, meets in stream:
            todo = [(i, rows) for i in meets if len(rows := state[i].open(rc[j], wide[j]))]
            if todo:
                ids, ws, y = read()
                for i, rows in todo:
                    state[i].meet(rows, ids, ws, y, same=same and i == j)
        for b in state.values():
            row, rank = np.nonzero(np.isfinite(b.dist))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.ids[row], b.other[row, rank], b.dist[row, rank], b.w[row, rank], (rank + 1).astype(np.int32))], ["id", "other", "dist", "w", "rank"])

    low = np.maximum(distances(lc, rc) - lr[:, None] - rr[None, :], 0.0)
    rows, whole = runs(left, right, np.ones((len(lc), len(rc)), bool), low, job, "id long, other long, dist double, w double, rank int")
    if not whole:
        w = Window.partitionBy("id").orderBy("dist", "other")
        rows = rows.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return written(rows, "neighbours")


def neighbours(space: Blocks, k: int) -> DataFrame:
    """(id, other, dist, w: of other, rank) of the ``k`` nearest other points by Euclidean distance, exact; ties by id."""
    return nearest(space, space, k)


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which edges are in the minimum spanning forest (ties by a, b): rounds in which every component takes its least edge."""
    order = np.lexsort((b, a, w))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)][order], at[len(a) :][order]
    comp = np.arange(len(nodes))
    taken = np.zeros(len(a), bool)
    left = np.arange(len(a))
    while True:
        cx, cy = comp[x[left]], comp[y[left]]
        open_ = cx != cy
        left, cx, cy = left[open_], cx[open_], cy[open_]
        if not len(left):
            break
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, cx, left)
        np.minimum.at(best, cy, left)
        pick = np.unique(best[best < len(a)])
        taken[pick] = True
        parent = np.arange(len(nodes))
        px, py = comp[x[pick]], comp[y[pick]]
        while True:
            low = np.minimum(parent[px], parent[py])
            new = parent.copy()
            np.minimum.at(new, parent[px], low)
            np.minimum.at(new, parent[py], low)
            new = new[new]
            if np.array_equal(new, parent):
                break
            parent = new
        comp = parent[comp]
    out = np.zeros(len(a), bool)
    out[order[taken]] = True
    return out


def _thinned(batches):
    """Edges of a batch that the minimum spanning forest of the batch keeps: no other edge is in that of the whole."""
    for batch in batches:
        if batch.num_rows:
            keep = forest(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("ca", "cb", "w")))
            yield batch.filter(pa.array(keep))


_EDGE = "ca long, cb long, a long, b long, w double"


def spanning_forest(edges: DataFrame, *, one_task: int = 1 << 18, rounds: list[dict] | None = None) -> DataFrame:
    """The minimum spanning forest (a, b, w) of edges (a < b, w), ties by a, then b.

    Boruvka rounds: every component takes its least edge (partial aggregates, so a hub is a
    row a task), components follow these edges to their common end by doubling, and edges are
    named anew; the number of components at least halves.  Batches are thinned to their own forests
    before each round.  Once at most ``one_task`` edges are left, one task ends the work.
    ``rounds`` gets the number of edges of each round.
    """
    spark = edges.sparkSession
    left = written(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "a", "b", "w").mapInArrow(_thinned, _EDGE), "edges")
    done: list[DataFrame] = []
    while True:
        n = left.count()
        if rounds is not None:
            rounds.append({"edges": n})
        if n <= one_task:
            last = left.coalesce(1).mapInArrow(_last, "a long, b long, w double")
            done.append(last)
            break
        edge = F.struct("w", "a", "b", "ca", "cb")
        best = left.select(F.col("ca").alias("c"), edge.alias("e")).union(left.select("cb", edge)).groupBy("c").agg(F.min("e").alias("e"))
        best = written(best.select("c", F.when(F.col("c") == F.col("e.ca"), F.col("e.cb")).otherwise(F.col("e.ca")).alias("to"), "e.a", "e.b", "e.w"), "least")
        done.append(best.select("a", "b", "w").distinct())
        # two components that take the same edge are its end: the smaller of them is the root of all that lead there
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        step = written(best.select("c", "to").join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")), "roots")
        while True:
            after = step.select(F.col("c").alias("to"), F.col("to").alias("next"))
            new = written(step.join(after, "to").select("c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "roots")
            step = new.select("c", "to")
            if new.where("moved").isEmpty():
                break
        named = left
        for c in ("ca", "cb"):
            named = named.join(step.select(F.col("c").alias(c), F.col("to").alias(f"{c}_")), c, "left").withColumn(c, F.coalesce(f"{c}_", c)).drop(f"{c}_")
        lean = named.where("ca <> cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), F.struct("w", "a", "b").alias("e"))
        lean = lean.groupBy("ca", "cb").agg(F.min("e").alias("e")).select("ca", "cb", "e.a", "e.b", "e.w")
        left = written(lean.mapInArrow(_thinned, _EDGE), "edges")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return written(out, "forest")


def _last(batches):
    parts = [b for b in batches if b.num_rows]
    if parts:
        table = pa.Table.from_batches(parts)
        keep = forest(*(table.column(c).to_numpy() for c in ("ca", "cb", "w")))
        yield from table.select(["a", "b", "w"]).filter(pa.array(keep)).combine_chunks().to_batches()


def neighbours_of(queries: DataFrame, space: Blocks, k: int) -> DataFrame:
    """(id, other, dist, rank) of the ``k`` nearest points of a space for rows (id long, x array<double>) outside of it, dealt to the space's own pivots."""
    if queries.isEmpty():
        return queries.sparkSession.createDataFrame([], "id long, other long, dist double, rank int")
    asked = blocks(queries.select("id", "x", F.lit(1.0).alias("w")), centre=np.unique(space.centres, axis=0))
    return nearest(asked, space, k).select("id", "other", "dist", "rank")
