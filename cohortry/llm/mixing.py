"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mix64
from .common import saved

_WS = r"[\x20\x09-\x0D]"
_SOLID = r"[^\x20\x09-\x0D]"
DRAWS = "array<struct<epoch:int,shard:int,local_order:long,words:long>>"


def word_count(text: Column) -> Column:
    """Number of words, in memory of the order of the text; null: 0."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_WS}+", "")
    return F.length(F.regexp_replace(text, f"{_SOLID}+{_WS}*", "x")).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Words each source should give: ``share`` of all words dealt by weight, none above ``most`` times its size; what is above is dealt again by weight."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources): at every node of a binary tree the left half draws its blocks from the node's without replacement."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def go(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid, total = (lo + hi) // 2, int(q.sum())
        rng = np.random.default_rng([seed, lo, hi])
        n = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, n, method="marginals") if total else q * 0
        go(left, lo, mid)
        go(q - left, mid, hi)

    go(quotas.astype(np.int64), 0, shards)
    return out


ADDED = ("size", "source_size", "target", "taken", "draws")


def mix(docs: DataFrame, columns: Sequence[str], *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 8192, shard_words: int = 1 << 20, most_shards: int = 1 << 16, seed: int = 17) -> DataFrame:
    """For each document what the mix takes of it.

    ``docs`` has text and source; ``columns`` are carried along, but for those named like an
    added one; other columns only enter the order, whatever their names.  Sources by code
    point, null last, get ``weights`` in turn.  Adds size (words), source_size, target (words
    of its source), taken (words, repeats counted) and draws: one (epoch, shard, local_order,
    words) for each time it is taken.  A source's taken words are its target rounded to a
    whole word: the first ``taken // source_size`` passes take it whole, the last one a prefix
    of its pseudo-random order, whose last document gives only its first words (rows equal in
    every column that stand there give equally many, what doesn't divide is left out).  Null
    and empty texts have size 0 and are never drawn; a null source is a source; equal rows
    are drawn each for itself; an empty table gives no rows.

    The order of a source is that of a hash of the row, and equal ranges of it are its blocks,
    of about ``block_words``.  ``split_quotas`` deals exact block quotas to shards of about
    ``shard_words`` (more where there would be over ``most_shards``); a source's blocks,
    permuted, fill them in turn, so shards hold disjoint blocks; ``local_order`` shuffles a
    shard.  Where a source's last pass ends is found by sums over about sqrt(rows) ranges of
    hashes, then in the one range; so a row's draws follow from its hash and a few numbers of
    its source, and no text is shuffled.  The driver holds one row for each source and shard.
    """
    keep = [c for c in columns if c not in ADDED]
    rows = _rows(docs, seed)
    if "text" not in keep:
        rows = saved(rows.select(F.struct(*(F.col(f"d.`{c}`") for c in keep)).alias("d"), "s", "size", "h"), "mix-rows")
    plan = _plan(docs, rows, weights, share, most, block_words, shard_words, most_shards, seed, "text" in keep)
    return plan.select(*(F.col(f"d.`{c}`") for c in keep), *ADDED)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus of ``docs`` with all its columns, whatever their names, by ``mix`` and as ``mixed`` does."""
    given = {"weights": (5, 2, 1), "share": 1.5, "most": 2.0, "block_words": 8192, "shard_words": 1 << 20, "most_shards": 1 << 16, "seed": 17} | options
    return _dealt(_plan(docs, _rows(docs, given["seed"]), *given.values(), True), docs.columns)


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    """(d: all columns, s: source, size, h: hash of the row)."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("source").cast("string").alias("s"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in docs.columns)).alias("h"))


def _plan(docs: DataFrame, rows: DataFrame, weights, share, most, block_words, shard_words, most_shards, seed, whole_rows: bool) -> DataFrame:
    spark = docs.sparkSession
    narrow = saved(rows.select("s", "size", "h"), "mix-sizes") if whole_rows else rows
    totals = narrow.groupBy("s").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r.s is None, (r.s or "").encode("utf-8", "surrogatepass")))
    sizes = [r.words for r in totals]
    weigh = [weights[i % len(weights)] for i in range(len(totals))]
    want = targets(sizes, weigh, share, most)
    words = [int(round(t)) if s else 0 for t, s in zip(want, sizes, strict=True)]
    whole = [w // s if s else 0 for w, s in zip(words, sizes, strict=True)]
    rest = [w - f * s for w, f, s in zip(words, whole, sizes, strict=True)]
    kinds = "s string, i int, source_size long, target double, rest long"
    of = spark.createDataFrame([(r.s, i, r.words, want[i], rest[i]) for i, r in enumerate(totals)], kinds).withColumnRenamed("s", "s2")
    known = F.col("s").eqNullSafe(F.col("s2"))

    # where the last pass of each source ends: the range of hashes, then the hash in it
    ranges = max(1, math.isqrt(sum(r.n for r in totals)))
    placed = narrow.join(of, known).where("rest > 0").withColumn("range", F.floor(_place() * ranges))
    sums = placed.groupBy("i", "rest", "range").agg(F.sum("size").alias("w"))
    below = F.sum("w").over(Window.partitionBy("i").orderBy("range")) - F.col("w")
    last = sums.withColumn("base", below).where("base <= rest and rest < base + w").select(F.col("i").alias("i2"), F.col("range").alias("range2"), "base")
    last = spark.createDataFrame(last.collect(), "i2 int, range2 long, base long")  # a row a source
    here = placed.join(last, (F.col("i") == F.col("i2")) & (F.col("range") == F.col("range2"))).groupBy("i", "rest", "base", "h").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    below = F.col("base") + F.sum("w").over(Window.partitionBy("i").orderBy("h")) - F.col("w")
    ends = {r.i: r for r in here.withColumn("before", below).where("before <= rest and rest < before + w").collect()}

    block = max(block_words, sum(words) // 500_000_000)  # the sampler takes fewer than 10^9 blocks
    per_pass = np.array([-(-s // block) for s in sizes], np.int64)
    whole = np.array(whole, np.int64)
    cut = np.array([ends[i].h if i in ends else -(2**63) for i in range(len(sizes))], np.int64)
    cut_words = np.array([(ends[i].rest - ends[i].before) // ends[i].n if i in ends else 0 for i in range(len(sizes))], np.int64)
    partial = np.array([i in ends for i in range(len(sizes))], bool)
    quotas = whole * per_pass + partial * (_block(cut, per_pass) + 1)
    shards = max(1, -(-sum(words) // max(shard_words, -(-sum(words) // most_shards))))
    filled = np.cumsum(split_quotas(quotas, shards, seed), axis=0)  # shards x sources
    rng = np.random.default_rng([seed, 1])
    step = []
    for q in quotas.tolist():
        a = int(rng.integers(1, max(2, q)))
        while math.gcd(a, max(1, q)) != 1:
            a += 1
        step.append((a, int(rng.integers(0, max(1, q)))))
    times, shift = (np.array([x[j] for x in step], np.int64) for j in (0, 1))

    @F.arrow_udf(DRAWS)
    def draws(i: pa.Array, h: pa.Array, size: pa.Array) -> pa.Array:
        i, h, size = i.to_numpy(zero_copy_only=False).astype(np.int64), h.to_numpy(zero_copy_only=False), size.to_numpy(zero_copy_only=False)
        found = []
        for epoch in range(int(whole.max(initial=0)) + 1):
            n = np.where(epoch < whole[i], size, np.where((epoch == whole[i]) & partial[i], np.where(h < cut[i], size, np.where(h == cut[i], np.minimum(cut_words[i], size), 0)), 0))
            hit = np.flatnonzero(n)
            j = i[hit]
            nth = epoch * per_pass[j] + _block(h[hit], per_pass[j])
            rank = (nth * times[j] + shift[j]) % np.maximum(quotas[j], 1)
            shard = np.empty(len(hit), np.int64)
            for k in np.unique(j):
                m = j == k
                shard[m] = np.searchsorted(filled[:, k], rank[m], side="right")
            found.append((hit, np.full(len(hit), epoch), shard, _mix(h[hit], seed * 1000 + epoch), n[hit]))
        row, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        values = pa.StructArray.from_arrays([pa.array(x[order], t) for x, t in zip(rest, kinds, strict=True)], ["epoch", "shard", "local_order", "words"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(i))))), pa.int32()), values)

    out = rows.join(of.drop("rest"), known).withColumn("draws", draws("i", "h", "size"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda t, d: t + d["words"])
    return out.select("d", "size", "source_size", "target", taken.alias("taken"), "draws")


def _place() -> Column:
    """Where a row's hash lies among all hashes, from 0 to 1."""
    return (F.shiftright("h", 11) + F.lit(1 << 52)).cast("double") / F.lit(float(1 << 53))


def _block(h: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return np.minimum((((h >> 11) + (1 << 52)) / float(1 << 53) * blocks).astype(np.int64), np.maximum(blocks - 1, 0))


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    return mix64(h.view(np.uint64) ^ mix64(np.array([salt], np.uint64))).view(np.int64)


def mixed(plan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mixed corpus of a plan that carries ``columns`` with text among them: a row for each draw, dealt by shard and shuffled in it.

    A draw of fewer words than the document has cuts its text after the last of them, and sets n_chars.
    """
    return _dealt(plan.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("d"), "size", "draws"), columns)


def _dealt(plan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each draw; the text crosses the network once, and only texts that are cut go to Python."""

    @F.arrow_udf("string")
    def first_words(text: pa.Array, words: pa.Array) -> pa.Array:
        out = []
        for t, n in zip(text.to_pylist(), words.to_pylist(), strict=True):
            end = 0
            if t is not None:
                for k, m in enumerate(re.finditer(f"{_SOLID}+", t)):
                    if k == n:
                        break
                    end = m.end()
            out.append(None if t is None else t[:end])
        return pa.array(out, pa.string())

    rows = plan.select("d", "size", F.explode("draws").alias("w")).select("d", "size", "w.*")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "local_order")
    rows = rows.withColumn("cut", first_words(F.when(F.col("words") < F.col("size"), F.col("d.text")), F.col("words")))
    change = {"text": F.coalesce("cut", "d.text")}
    if "n_chars" in columns:
        change["n_chars"] = F.coalesce(F.length("cut").cast(plan.schema["d"].dataType["n_chars"].dataType), "d.n_chars")
    return rows.select(*(change.get(c, F.col(f"d.`{c}`")).alias(c) for c in columns))
