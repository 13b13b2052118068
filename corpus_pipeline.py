"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept;
all but the last return the columns of documents.  Null or empty texts, repeated rows, empty
tables and further columns are handled as the operators' docstrings say; a further column
is carried along by the stages that keep whole rows and dropped by ``repeated_passages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import langid, mixing, partenum, pieces, repeats
from cohortry.llm.common import documents, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def short_batches(spark: SparkSession) -> None:
    """From here on the session sends Arrow batches of at most 1024 texts: they stand in JVM and Python at once, and what a stage returns is run by its caller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1024:
        spark.conf.set(name, "1024")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without an identified language: no letter, or a best share no more than a tenth above chance.

    The classifier learns from the declared languages of a bounded sample; where nothing was
    learned, only documents without a letter are rejected.  A missing lang is filled in.
    """
    short_batches(spark)
    model = langid.train(docs)
    least = 1.1 / max(1, len(model.langs)) if model and len(model.langs) > 1 else 0.0
    found = (F.col("lang_pred") != "und") & (F.col("score") >= least) if model else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), "text")
    rows = langid.predict(rows, model).where(found)
    return rows.select(F.col("d").withField("lang", F.coalesce("d.lang", "lang_pred")).alias("d")).select("d.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (Jaccard 0.8 of five-word shingles) the document with the smallest doc_id stays, once if its row repeats."""
    short_batches(spark)
    kept = partenum.jaccard_rows(docs).where("kept").select(F.col("row").alias("k")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), partenum.row_name().alias("k"))
    return rows.dropDuplicates(["k"]).join(kept, "k", "left_semi").select("d.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 bytes or more that also stand in a document with a smaller doc_id.

    Bytes of a character that was cut in two go as well.  A document of which nothing is left goes.
    """
    short_batches(spark)
    kept = repeats.remove_repeats(docs, as_text=True)
    kept = kept.select(F.col("doc_id").alias("id"), "text_md5", F.col("kept").alias("left")).where("left <> ''")
    rows = docs.select("doc_id", "lang", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("md5") == F.col("text_md5")))
    return rows.select("doc_id", F.col("left").alias("text"), "lang", "source", F.length("left").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source the words that its weight asks for, some documents several times, shuffled in shards."""
    short_batches(spark)
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it exactly."""
    short_batches(spark)
    return pieces.encode(docs.select("doc_id", "text", "lang", "source"), "text", verify=True).select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "exact")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: No SQL for the stages: shingle components, suffix order, classifier and pieces can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents`` of a data folder; what each returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
