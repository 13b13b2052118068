"""I-Match document fingerprints, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

_WS = r"[\x20\x09-\x0D]+"
#: One of so many parts of the lexicon is kept for each subset: coarse ones tell long texts apart, fine ones short.
SUBSETS = (2, 4, 8, 8, 16, 16, 32, 32, 32, 64, 64, 64, 64, 128, 128, 128, 128, 256, 256, 256, 256, 512, 512, 512)
#: Buckets of the lexicon's hash table.
TABLE = 1 << 14


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct words, A-Z and other letters in lower case; null: none."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _WS), "")
    return F.array_distinct(F.transform(parts, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, *, low: float = 0.002, high: float = 0.25, least: int = 2) -> DataFrame:
    """Terms whose share of the documents lies between ``low`` and ``high``, an inverse-document-frequency band (and in ``least`` documents at least).

    Column ``term``.  It can't have more than (mean distinct terms of a document) / low rows,
    whatever the number of documents.
    """
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where(F.col("df").between(max(least, math.ceil(low * n)), math.floor(high * n))).select("term")


def lookup(lex: DataFrame) -> Column:
    """The lexicon as one array of hash buckets, a scalar subquery: its size has the bound of ``lexicon``."""
    spark = lex.sparkSession
    by = lex.groupBy(F.pmod("term", F.lit(TABLE)).alias("b")).agg(F.collect_list("term").alias("ts"))
    full = spark.range(TABLE).join(by, F.col("id") == F.col("b"), "left").select("id", F.coalesce("ts", F.array().cast("array<bigint>")).alias("ts"))
    one = full.agg(F.sort_array(F.collect_list(F.struct("id", "ts"))).alias("x")).select(F.transform("x", lambda y: y["ts"]).alias("x"))
    return saved(one, "lexicon").scalar()


def with_fingerprint(df: DataFrame, text: Column, table: Column, name: str, seed: int = 5) -> DataFrame:
    """Adds ``name``: array<bigint>, for each lexicon subset a hash of the text's sorted terms in it; null where it has none.

    Terms outside the band are left out; a text without any term of the band uses all its
    terms, and one without words has the hash of nothing in every place.
    """
    df = df.withColumn("_t", terms(text))
    # tied to _t, so that the optimiser puts the subquery's one value in the place of _lex and no row carries it
    df = df.withColumn("_lex", F.when(F.size("_t") >= 0, table))
    df = df.withColumn("_b", F.sort_array(F.filter("_t", lambda t: F.array_contains(F.element_at("_lex", (F.pmod(t, F.lit(TABLE)) + 1).cast("int")), t))))
    df = df.withColumn("_b", F.when(F.size("_b") > 0, F.col("_b")).otherwise(F.sort_array("_t")))

    def part(k: int, of: int) -> Column:
        own = F.filter("_b", lambda t: F.pmod(F.xxhash64(t, F.lit(seed * 1000 + k)), F.lit(of)) == 0)
        return F.when(F.size("_b") == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.nullif(own, F.array().cast("array<bigint>")), F.lit(k)))

    empty = [F.xxhash64(F.lit(None).cast("array<bigint>"), F.lit(k)) for k in range(len(SUBSETS))]
    out = F.array(*(F.nullif(part(k, of), empty[k]) for k, of in enumerate(SUBSETS)))
    return df.withColumn(name, out).drop("_t", "_b", "_lex")


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.hex(x))), ".", "-")


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets in which either has terms where both hashes agree; 1 for equal fingerprints."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).when(x.isNotNull() | y.isNotNull(), 0.0))
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.aggregate(F.filter(pairs, lambda x: x.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n")), lambda acc: F.try_divide(acc["s"], acc["n"])), F.lit(0.0)))


def _bucket(key: Column, splits: list[int]) -> Column:
    """Number of splits below the key, found in two steps."""
    if not splits:
        return F.lit(0)
    g = math.isqrt(len(splits)) + 1
    first = F.lit([splits[i] for i in range(0, len(splits), g)])
    fine = F.array(*(F.lit(splits[i : i + g]) for i in range(0, len(splits), g)))
    i = F.size(F.filter(first, lambda c: c < key))
    return F.when(i > 0, (i - 1) * g + F.size(F.filter(F.element_at(fine, i), lambda c: c < key))).otherwise(F.lit(0))


def with_next(df: DataFrame, columns: dict[str, str], *, bucket_rows: int = 1024, most_buckets: int = 65536) -> DataFrame:
    """Adds for each row the ``columns`` (name: new name) of the next row by descending doc_id; the last row gets the first one's.

    Null doc_ids come last and equal ones are ordered by text.  Rows are dealt to ranges of
    doc_id of about ``bucket_rows`` rows, so no task sees all; the first row of each range
    is also sent to the end of the range before it.
    """
    ids = df.select("doc_id")
    n = ids.count()
    parts = min(most_buckets, max(1, n // bucket_rows))
    found = ids.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    splits = sorted({int(x) for x in found or []})
    ids = ids.withColumn("b", _bucket(F.col("doc_id"), splits))
    tops = {r.b: r.top for r in ids.groupBy("b").agg(F.max("doc_id").alias("top")).collect()}  # at most most_buckets rows
    full = sorted(tops)
    above = {b: full[(i + 1) % len(full)] for i, b in enumerate(full)}
    size = len(splits) + 1
    top = F.lit([tops[b] if tops.get(b) is not None else -(2**63) for b in range(size)]).cast("array<bigint>")
    dest = F.lit([above.get(b, 0) for b in range(size)]).cast("array<int>")
    null_top = [b for b in full if tops[b] is None]
    df = df.withColumn("_b", _bucket(F.col("doc_id"), splits))
    first = F.coalesce(F.col("doc_id") == F.element_at(top, F.col("_b") + 1), F.lit(bool(null_top)))
    both = F.when(first, F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g")), F.struct(F.element_at(dest, F.col("_b") + 1).alias("b"), F.lit(1).alias("g")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g"))))
    df = df.withColumn("_p", F.explode(both)).withColumn("_b", F.col("_p.b")).withColumn("_g", F.col("_p.g")).drop("_p")
    w = Window.partitionBy("_b").orderBy("_g", F.col("doc_id").desc_nulls_last(), "text")
    for old, new in columns.items():
        df = df.withColumn(new, F.lead(old).over(w))
    return df.where("_g = 0").drop("_b", "_g")
