"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and to which shards the splitting tree deals it."""
    from .mixing import mix

    plan = mix(documents(spark, sf_dir), ["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").cast("long").alias("n_draws"), F.col("draws.shard").alias("shards"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their texts with the second half replaced by the next document's beginning."""
    from . import imatch

    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = imatch.lookup(imatch.lexicon(docs))
    own = imatch.with_fingerprint(docs, F.col("text"), table, "fp")
    rows = imatch.with_next(own, {"text": "next_text", "fp": "next_fp"})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = imatch.with_fingerprint(rows, F.col("edited"), table, "edited_fp")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        imatch.as_text(F.col("fp")).alias("fingerprint"),
        imatch.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        imatch.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        imatch.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by Jaccard similarity of five-word shingles."""
    from .partenum import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at a cosine of 0.95."""
    from .covertree import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _part(of: int):
    """crc32 of doc_id as text, modulo ``of``; null doc_ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(of))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents; a third of them is never learned from."""
    from .langid import predict, train

    docs = documents(spark, sf_dir)
    model = train(docs.where(_part(3) != 1).select("text", "lang"))
    return predict(docs.select("doc_id", (_part(3) == 1).alias("held_out"), "text"), model).drop("text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a fifth of the labels is never learned from."""
    from .quality import score, train

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = train(docs, labels.where(_part(5) != 0))
    return score(docs.select("doc_id", (_part(5) == 0).alias("held_out"), "text"), model).drop("text")


def op6_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a trigram model of four fifths of them."""
    from .ngram import score, train

    docs = documents(spark, sf_dir)
    model = train(docs.where(_part(5) != 1).select("text"), order=3)
    return score(docs.select("doc_id", (_part(5) == 1).alias("held_out"), "text"), model).drop("text")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, decoded again."""
    from .pieces import encode

    rows = encode(documents(spark, sf_dir).select("doc_id", "text"), "text", verify=True)
    return rows.select("doc_id", "pieces", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "decoded_sha256", "exact")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages of 50 bytes or more cost each document."""
    from .repeats import remove_repeats

    rows = remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to WARC files, reads them back through the salvage reader."""
    from .warc import read_warc, write_warc

    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = read_warc(manifest, payloads=False)
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together."""
    from .sharding import shard_plan

    rows = shard_plan(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into prefix, middle and suffix, and rebuilt from what is made of them."""
    from .infill import fill_in_middle

    made = documents(spark, sf_dir).select("doc_id", fill_in_middle(F.col("text"), F.col("doc_id")).alias("x"))
    return made.select("doc_id", "x.n", "x.form", "x.prefix_chars", "x.middle_chars", "x.output_sha256", "x.restored_sha256")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent forms that the words of all documents are spelling variants of."""
    from .spelling import spelling_forms

    return spelling_forms(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_imatch": op2_imatch,
    "op3_jaccard": op3_jaccard,
    "op4_embeddings": op4_embeddings,
    "op5_language": op5_language,
    "op6_ngram": op6_ngram,
    "op7_pieces": op7_pieces,
    "op8_repeats": op8_repeats,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_shards": op11_shards,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        k as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
        m as (select payload_digest as d, max(page_id) as keeper from k where payload_bytes >= 1000 group by 1)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id <> keeper then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id <> keeper then keeper end as refers_to
        from k left join m on payload_digest = d""",
    "op12_fill_in_middle": """
        with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        g as (select *, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as a, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as b,
                     cast('0x' || substr(h, 17, 8) as bigint) % 100 as c, cast('0x' || substr(h, 25, 8) as bigint) % 100 as e from d),
        f as (select *, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= 90 then 'plain' when e < 20 then 'spm' else 'psm' end as form,
                     substr(t, 1, least(a, b)) as p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) as m, substr(t, greatest(a, b) + 1) as s from g)
        select doc_id, n, form, case when form <> 'plain' then least(a, b) end as prefix_chars, case when form <> 'plain' then greatest(a, b) - least(a, b) end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
               sha256(t) as restored_sha256
        from f""",
}
