"""Search among words, documents and topics by vectors: wanted less unwanted ones, then a distributed top-k without the query's own items.

A table of vectors has a name column and a vector column of unit vectors; the query side is
a handful of vectors on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topics import combined_query, similarities


def vectors_of(table: DataFrame, name: str, vector: str, wanted: Sequence) -> list[np.ndarray]:
    """Vectors of the named rows, in the order of the names; an unknown name is an error."""
    rows = {r[0]: np.array(r[1], np.float64) for r in table.where(F.col(name).isin(list(wanted))).select(name, vector).collect()}  # the query's own rows
    missing = [w for w in wanted if w not in rows]
    if missing:
        raise KeyError(f"no vector for {missing}")
    return [rows[w] for w in wanted]


def by_vector(table: DataFrame, name: str, vector: str, query: np.ndarray, top: int, exclude: Sequence = ()) -> DataFrame:
    """(name, score): the ``top`` rows by inner product with the query; equal scores by name."""
    rows = table.where(~F.col(name).isin(list(exclude))) if len(exclude) else table
    near = similarities(rows.select(F.col(name).alias("_name"), F.col(vector).alias("_vector")), "_name", "_vector", [0], query[None, :])
    return near.orderBy(F.desc("score"), "_name").limit(top).select(F.col("_name").alias(name), "score")


def by_names(table: DataFrame, name: str, vector: str, source: DataFrame, source_name: str, source_vector: str, positive: Sequence, negative: Sequence = (), top: int = 10) -> DataFrame:
    """The rows nearest to named rows of ``source`` less others; the query's own items are left out where ``source`` is the table itself."""
    query = combined_query(vectors_of(source, source_name, source_vector, positive), vectors_of(source, source_name, source_vector, negative) if negative else ())
    return by_vector(table, name, vector, query, top, [*positive, *negative] if source is table else ())


def similar_words(words: DataFrame, positive: Sequence[str], negative: Sequence[str] = (), top: int = 10, name: str = "word", vector: str = "vector") -> DataFrame:
    return by_names(words, name, vector, words, name, vector, positive, negative, top)


def similar_documents(docs: DataFrame, positive: Sequence, negative: Sequence = (), top: int = 10, name: str = "doc_id", vector: str = "vector") -> DataFrame:
    return by_names(docs, name, vector, docs, name, vector, positive, negative, top)


def documents_of_topic(assigned: DataFrame, topic: int, top: int, doc: str = "doc_id") -> DataFrame:
    """The documents of a topic nearest to it (assigned: doc, topic, score)."""
    return assigned.where(F.col("topic") == topic).orderBy(F.desc("score"), doc).limit(top).select(doc, "score")


def by_text(table: DataFrame, name: str, vector: str, text: str, embed: Callable[[str], np.ndarray], top: int) -> DataFrame:
    """The rows nearest to a text, by whatever encoder is plugged in."""
    v = np.asarray(embed(text), np.float64)
    return by_vector(table, name, vector, v / (np.linalg.norm(v) or 1.0), top)


def embedded(docs: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], out: str = "vector", batch: int = 256) -> DataFrame:
    """Vectors of texts by a pretrained encoder (a function of a list of texts), in Arrow batches; null counts as empty."""


    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        parts = [np.asarray(encode(rows[i : i + batch]), np.float64) for i in range(0, len(rows), batch)]
        return pd.Series([v.tolist() for p in parts for v in p])

    return docs.withColumn(out, run(F.col(text)))


def windows_encoder(encode: Callable[[list[list[str]]], np.ndarray], length: int = 512, stride: int = 3) -> Callable[[list[str]], np.ndarray]:
    """An encoder of long texts from one of token windows: windows of ``length`` tokens that share ``stride`` of them, their vectors summed."""

    def run(texts: list[str]) -> np.ndarray:
        out = []
        for t in texts:
            tokens = t.split()
            cuts = [tokens[i : i + length] for i in range(0, max(1, len(tokens) - stride), length - stride)]
            out.append(encode(cuts).sum(axis=0))
        return np.stack(out)

    return run


def save_model(tables: dict[str, DataFrame], folder: str) -> None:
    """A topic model's tables (documents, topics, words) as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_model(spark, names: Sequence[str], folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
