"""The shared folder, written tables, and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Deletes a table of ``saved`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished stages that nothing refers to."""
    for _ in range(2):  # the first frees Python's handles, the second what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """While it holds, jobs send Arrow batches of at most ``rows`` rows: texts are long, and a batch stands in both JVM and Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a[i] - b[i]: every node but the smallest of its tree, with that smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _fold(batches):
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        hi, lo = fold_edges(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["a", "b"])


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether every node is either the root of its links or has one link alone."""
    nodes = e.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(e.select("b", F.lit(0), F.lit(1)))
    return nodes.groupBy("n").agg(F.sum("child").alias("c"), F.max("root").alias("r")).where("c > 1 or c = 1 and r = 1").isEmpty()


def components(edges: DataFrame, folded: bool = False) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b longs): component is the smallest id reachable.

    ``folded``: the links come as forests already (from Python: a second worker a task would only cost memory).

    Alternates large-star and small-star rounds on the whole distributed edge list until it
    is a set of stars; each round is written to the shared folder.  Batches are folded to
    forests first, and a node's smallest neighbour is found by a partial aggregate, so a hub
    costs one row per task there; its edges are dealt by a join that AQE can split.  Links
    found several times are one from the start.
    """
    e = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = saved((e if folded else e.mapInArrow(_fold, "a long, b long")).distinct(), "edges")
    while not _is_forest_of_stars(e):
        # large star: neighbours above u join the smallest neighbour m of u
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below u and u itself join the smallest of them
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = saved(small.where("a <> b").distinct().mapInArrow(_fold, "a long, b long"), "edges")
        drop_saved(e)
        e = new
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
