"""Sharding by longest processing time: groups that must stay together go, by falling size, to the least loaded shard."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Shards times ``fine``: at most so many groups are items of their own, and as many bundles.
MOST_ITEMS = 1 << 18


def lpt(sizes: Sequence[int], shards: int) -> np.ndarray:
    """The shard of each item: by falling size (ties: by place), each to the least loaded shard (ties: the lowest), kept in a heap."""
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros(len(sizes), np.int32)
    heap = [(0, k) for k in range(shards)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, k = heap[0]
        out[i] = k
        heapq.heapreplace(heap, (load + int(sizes[i]), k))
    return out


@dataclass
class Plan:
    """Where groups go: those of ``singles`` (key, single: shard) by name, all others by their bundle (bundle, bundled: shard)."""

    singles: DataFrame
    bundles: DataFrame
    n_bundles: int

    def bundle(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n_bundles)).cast("int")


def schedule(sizes: DataFrame, shards: int, *, fine: int = 1024) -> Plan:
    """Schedules groups (key: binary, w: long, a row or several each, summed) on ``shards``.

    At any number of groups the driver holds at most twice ``shards`` x ``fine`` items: groups
    above total / (shards x fine) are items of their own, of which there can't be more; what
    is smaller is dealt by key hash to as many bundles, which are items too (a group stays whole
    in its bundle).  So the largest shard exceeds the mean by one item at most, either a group that
    alone is that large or a bundle of some thousandth of a shard.  Sums are partial
    aggregates: a group may hold any share of all rows.
    """
    spark = sizes.sparkSession
    fine = max(1, min(fine, MOST_ITEMS // shards))
    n = shards * fine
    groups = saved(sizes.groupBy("key").agg(F.sum("w").alias("w")), "shard-groups")
    total = groups.agg(F.sum("w")).first()[0] or 0
    large = F.col("w").cast("decimal(20,0)") * n > F.lit(total)
    singles = sorted(groups.where(large).collect(), key=lambda r: (-r.w, bytes(r.key)))  # fewer than n rows
    bundle = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("b")
    by = groups.where(~large).groupBy(bundle).agg(F.sum("w").alias("w")).toArrow()  # at most n rows
    load = np.zeros(n, np.int64)
    load[by["b"].to_numpy()] = by["w"].to_numpy()
    of = lpt(np.concatenate((np.array([r.w for r in singles], np.int64), load)), shards)
    named = spark.createDataFrame(pa.table({"key": pa.array([bytes(r.key) for r in singles], pa.binary()), "single": of[: len(singles)]}))
    return Plan(named, spark.createDataFrame(pa.table({"bundle": np.arange(n, dtype=np.int32), "bundled": of[len(singles) :]})), n)


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and 16 for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def group_of(text: Column) -> Column:
    """Key of equal texts: 128 bits; null and empty are equal."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sharded(docs: DataFrame, shards: int = 40, *, key: Column | None = None, size: Column | None = None, fine: int = 1024) -> DataFrame:
    """``docs`` with all its columns, whatever their names, and ``shard`` (int; replaces a column of that name).

    Rows of equal ``key`` (binary; by default equal texts) stay together, sums of ``size`` are
    made near equal.  Named groups are joined by broadcast: ``MOST_ITEMS`` rows of
    20 bytes at most, and as many bundles of 8.  Null and empty texts are one group; a null key is a group.
    """
    key = group_of(F.col("text")) if key is None else F.coalesce(key, F.lit(b""))
    size = size_of(F.col("text")) if size is None else size
    return _assigned(docs, schedule(docs.select(key.alias("key"), size.alias("w")), shards, fine=fine), key)


def _assigned(docs: DataFrame, plan: Plan, key: Column) -> DataFrame:
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), key.alias("key"), plan.bundle(key).alias("bundle"))
    rows = rows.join(F.broadcast(plan.singles), "key", "left").join(F.broadcast(plan.bundles), "bundle", "left")
    kept = [F.col(f"d.`{c}`").alias(c) for c in docs.columns if c != "shard"]
    return rows.select(*kept, F.coalesce("single", "bundled").alias("shard"))


def slots(rows: DataFrame, order: Sequence[str], *, slot_rows: int = 4096, most_buckets: int = 4096) -> DataFrame:
    """Numbers the rows of each shard without gaps from 0: columns shard, ``order`` and slot.

    The order is that of a hash of the ``order`` columns, then of these.  Equal rows are counted by a partial
    aggregate and given back at the end, so no task orders more than a range of some ``slot_rows``
    different rows of a shard, whatever the number of copies; where ranges begin is a sum over at most
    ``most_buckets`` counts a shard.
    """
    cols = [F.col(f"`{c}`") for c in order]
    counted = rows.groupBy("shard", *cols).agg(F.count("*").alias("_n"))
    counted = saved(counted.withColumn("_h", F.xxhash64(*cols)), "shard-rows")
    shards, n = counted.agg(F.countDistinct("shard"), F.count("*")).first()
    ranges = min(most_buckets, max(1, math.ceil(n / max(1, shards) / slot_rows)))
    counted = counted.withColumn("_b", F.floor((F.shiftright("_h", 11) + F.lit(1 << 52)).cast("double") / F.lit(float(1 << 53)) * ranges))
    base = counted.groupBy("shard", "_b").agg(F.sum("_n").alias("_w"))
    base = base.select("shard", "_b", (F.sum("_w").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_w")).alias("_base"))
    own = F.sum("_n").over(Window.partitionBy("shard", "_b").orderBy("_h", *cols).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    placed = counted.withColumn("_own", own).join(base, ["shard", "_b"]).withColumn("_at", F.col("_base") + F.col("_own"))
    # copies in runs of 65536, so that no array grows with their number
    runs = placed.withColumn("_run", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1, F.lit(65536).cast("long"))))
    last = F.least(F.col("_run") + 65535, F.col("_at") + F.col("_n") - 1)
    return runs.select("shard", *cols, F.explode(F.sequence("_run", last)).alias("slot"))


def shard_plan(docs: DataFrame, shards: int = 40, *, fine: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, equal texts together, sizes of shards near equal.

    Other columns play no part, whatever their names.  Null texts count as empty (size 16);
    null doc_ids and repeated rows are rows like others; an empty table gives none.  Texts
    are read once: sizes, checksums and 128-bit keys are written to the shared folder.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_of(F.col("text")).alias("key"))
    narrow = saved(narrow, "shard-sizes")
    plan = schedule(narrow.select("key", F.col("size").alias("w")), shards, fine=fine)
    placed = _assigned(narrow, plan, F.col("key"))
    return slots(placed, ["doc_id", "size", "text_crc32", "key"]).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, *, files: int = 1, fine: int = 1024) -> None:
    """Writes ``sharded`` rows as Parquet folders shard=0, 1, ...; a shard's rows are spread over ``files`` tasks."""
    rows = sharded(docs, shards, fine=fine)
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(files))
    rows.repartition(shards * files, "shard", part).write.partitionBy("shard").parquet(path)
