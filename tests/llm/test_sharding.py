import heapq
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cohortry.llm import sharding
from cohortry.llm.common import saved
from cohortry.llm.queries import op11_shards

DIR = "/root/testdata/sf0.001"


def plain_lpt(sizes, k):
    heap, out = [(0, i) for i in range(k)], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + sizes[i], s))
    return [out[i] for i in range(len(sizes))]


def test_lpt():
    rng = np.random.default_rng(3)
    for k in (1, 2, 7, 40):
        sizes = rng.integers(1, 60, 300).tolist()
        assert sharding.lpt(sizes, k).tolist() == plain_lpt(sizes, k)
    assert sharding.lpt([], 3).tolist() == []


def check(rows, shards):
    by, load, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in rows:
        by[r["text"] or ""].add(r["shard"])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in load)
    return load


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = [r.asDict() | {"text": docs[r.doc_id]} for r in op11_shards(spark, DIR).collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        raw = r["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    load = check(rows, 40)
    groups = defaultdict(int)
    for r in rows:
        groups[r["text"]] += r["size"]
    # as level as scheduling all groups one by one
    want = np.bincount(plain_lpt(list(groups.values()), 40), weights=list(groups.values()), minlength=40)
    assert max(load.values()) <= want.max() * 1.001 and max(load.values()) - min(load.values()) <= want.max() - want.min() + sum(groups.values()) / 40 / 100
    again = {(r.doc_id, r.shard, r.slot) for r in op11_shards(spark, DIR).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_hot_group_and_odd_rows(spark):
    """A third of all rows equal, nulls, empty and long texts, equal rows, clashing names."""
    rows = [(i, "copied text", "x", 1) for i in range(3000)] + [(i, f"text {i} " * (i % 7), "y", 2) for i in range(6000)]
    rows += [(None, None, "n", 3), (None, "", "n", 3), (1, "long" * 250_000, None, None)] + [(77, "one row again", "z", 4)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, key int")
    plan = saved(sharding.shard_plan(df, 8), "plan")
    assert plan.count() == len(rows)
    texts = {zlib.crc32((r[1] or "").encode()): r[1] or "" for r in rows}
    found = [r.asDict() | {"text": texts[r.text_crc32]} for r in plan.collect()]
    load = check(found, 8)
    assert max(load.values()) - min(load.values()) <= 1_000_016
    whole = sharding.sharded(df, 8)
    assert whole.columns == ["doc_id", "text", "key", "shard"] and whole.count() == len(rows)
    assert whole.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("shard").alias("k")).where("k > 1").isEmpty()
    assert sharding.shard_plan(df.where("false")).count() == 0


def test_bundles(spark):
    """Where groups are many, most go by bundles: still together, still level."""
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 30_000).cast("string")).alias("text"))
    rows = saved(sharding.shard_plan(df, 5, fine=32), "plan")
    sizes = [r.bytes for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 5 and max(sizes) <= 1.02 * sum(sizes) / 5
    assert rows.groupBy("text_crc32").agg(F.countDistinct("shard").alias("k")).where("k > 1").isEmpty()
    assert rows.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("a"), (F.countDistinct("slot") == F.count("*")).alias("b")).where("not a or not b").isEmpty()


def test_written(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 100).cast("string")).alias("text"))
    sharding.write_shards(df, f"file://{tmp_path}/out", 4, files=2)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 500 and back.select("shard").distinct().count() == 4
