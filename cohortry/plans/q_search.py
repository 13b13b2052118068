"""Registered queries of vector search, silhouettes, sentence vectors and corrected topic metrics, on the table of embeddings.

Rows with vec_id divisible by 10 play the words, the others the documents, their label the topic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import frames as R
from ..operators import search as V
from ..operators import text as X
from ..operators import topics as P
from .q_text import _TV, _topics
from .registry import Tables, query


def _words(t: Tables):
    return t.embeddings.where("vec_id % 10 = 0").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector"))


def _docs(t: Tables):
    return t.embeddings.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def _near(positive, negative, pool, name, top) -> str:
    signs = f"select embedding::double[] as e, 1 as s from embeddings where vec_id in ({', '.join(map(str, positive))})"
    if negative:
        signs += f" union all select embedding::double[], -1 from embeddings where vec_id in ({', '.join(map(str, negative))})"
    return f"""with q as ({signs}), c as (select i, sum(s * e[i]) as x from q, range(1, 65) t(i) group by i), v as (select list(x order by i) as v from c),
 n as (select list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from v)
 select {name}, round(list_inner_product(embedding::double[], v), 6) as score from embeddings, n where {pool} order by list_inner_product(embedding::double[], v) desc, {name.split(' as ')[0]} limit {top}"""


def _r(df):
    return df.withColumn("score", S.r6(F.col("score")))


@query("top_11_similar_words", _near([10, 20], [30], "vec_id % 10 = 0 and vec_id not in (10, 20, 30)", "'w' || vec_id as word", 20))
def _(t):
    return _r(V.similar_words(_words(t), ["w10", "w20"], ["w30"], 20))


@query("top_11_documents_by_words", _near([10], [40], "vec_id % 10 <> 0", "vec_id as doc_id", 20))
def _(t):
    return _r(V.by_names(_docs(t), "doc_id", "vector", _words(t), "word", "vector", ["w10"], ["w40"], 20))


@query("top_11_documents_by_documents", _near([1, 2], [3], "vec_id % 10 <> 0 and vec_id not in (1, 2, 3)", "vec_id as doc_id", 20))
def _(t):
    return _r(V.similar_documents(_docs(t), [1, 2], [3], 20))


@query("top_11_words_by_vector", _near([7], [], "vec_id % 10 = 0", "'w' || vec_id as word", 20))
def _(t):
    return _r(V.by_vector(_words(t), "word", "vector", P.combined_query(V.vectors_of(_docs(t), "doc_id", "vector", [7])), 20))


@query("top_11_documents_of_topic", f"with {_TV}, a as (select vec_id, arg_max(topic, s) as topic, max(s) as s from sim group by 1) select vec_id, round(s, 6) as score from a where topic = 3 order by s desc, vec_id limit 15")
def _(t):
    a = P.similarities(t.embeddings, "vec_id", "embedding", *_topics(t), top=1)
    return _r(V.documents_of_topic(a, 3, 15, "vec_id"))


@query("top_11_topics_by_words", f"with {_TV}, w as (select * from sim where vec_id = 10) select topic, round(s, 6) as score from w order by s desc, topic limit 5")
def _(t):
    names, v = _topics(t)
    word = V.vectors_of(_words(t), "word", "vector", ["w10"])
    table = t.spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(names, v, strict=True)], "topic int, vector array<double>")
    return _r(V.by_vector(table, "topic", "vector", P.combined_query(word), 5))


_METRICS = "mx pa twpa dit twdit ps twps twpa50 twdit50 twps50".split()


@query(
    "top_10_all_patient_metrics",
    f"""with {_TV}, a as (select vec_id, arg_max(topic, s - 0.9) as topic, max(s) - 0.9 as s, (vec_id % 10) / 10.0::double as w, vec_id % 20 as pid from sim group by vec_id), b as (select topic from a group by 1 having count(*) >= 20),
 pt as (select pid, topic, max(s) as mx, avg(s) as pa, case when sum(w) <> 0 then sum(s * w) / sum(w) else 0 end as twpa, sum(case when s > 0 then 1.0::double else 0 end) as dit, sum(case when s > 0 then w else 0 end) as twdit, sum(s) as ps, sum(s * w) as twps from a where topic in (select topic from b) group by 1, 2),
 blend as (select *, (pa + twpa) / 2 as twpa50, (dit + twdit) / 2 as twdit50, (ps + twps) / 2 as twps50 from pt) select pid, topic, {', '.join(f'round({c}, 6) as {c}' for c in _METRICS)} from blend""",
)
def _(t):
    """All ten metrics; scores are less 0.9, so that some are below 0, which dit and twdit leave out."""
    a = P.similarities(t.embeddings, "vec_id", "embedding", *_topics(t), top=1).withColumn("score", F.col("score") - 0.9).withColumn("w", (F.col("vec_id") % 10) / 10.0).withColumn("pid", F.col("vec_id") % 20)
    return P.patient_topics(a, "pid", "score", "w", 20).select("pid", "topic", *(S.r6(F.col(c)).alias(c) for c in _METRICS))


_SIL = f"""{_TV}, k as (select vec_id, topic, (s + 1) / 2 as s, row_number() over (partition by vec_id order by s desc, topic) as r from sim),
 d as (select vec_id, max(case when r = 1 then topic end) as topic, max(case when r = 1 then s end) as own, avg(case when r > 1 then s end) as others from k group by 1),
 p as (select topic, 1 - avg(own) as a, 1 - avg(others) as b from d group by 1)"""


@query("top_09_silhouette", f"with {_SIL} select count(*)::int as topics, round(avg(((b - a) / greatest(a, b) + 1) / 2), 6) as score from p")
def _(t):
    names, v = _topics(t)
    score, size = P.silhouette(t.embeddings, "vec_id", "embedding", v)
    return t.spark.createDataFrame([(sum(n > 0 for n in size), round(score, 6))], "topics int, score double")


@query("top_09_penalised_count")
def _(t):
    """The topic count by the search over penalised silhouettes, with all scores it saw."""
    tv = P.topic_vectors(t.embeddings, "label", "embedding")
    names, v = P.matrix(tv, "label", "vec")
    size = dict(tv.select("label", "size").collect())
    best, seen = P.best_topic_count(t.embeddings, "vec_id", "embedding", v, [size[n] for n in names])
    return t.spark.createDataFrame([(k, round(s, 6), k == best) for k, s in sorted(seen.items())], "topics int, score double, best boolean")


@query("top_07_reduction_scores")
def _(t):
    """Several topic counts scored in one descent."""
    tv = P.topic_vectors(t.embeddings, "label", "embedding")
    names, v = P.matrix(tv, "label", "vec")
    size = dict(tv.select("label", "size").collect())
    got = P.reduction_scores(t.embeddings, "vec_id", "embedding", v, [size[n] for n in names], [2, 4, 6, 8])
    return t.spark.createDataFrame([(k, round(s, 6), n) for k, (s, n) in sorted(got.items())], "topics int, score double, small int")


@query(
    "txt_07_sentence_vectors",
    """with k as (select conv_id, turn, len(x) % 50 * 10 as vec_id from (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) as x from conversations)),
 e as (select k.conv_id, k.turn, i, embedding[i]::double / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y))) as x from k join embeddings using (vec_id), range(1, 65) t(i)),
 m as (select conv_id, turn, i, avg(x) as x, count(*) as n from e group by 1, 2, 3)
 select conv_id, turn, max(n) as n, round(sqrt(sum(x * x)), 6) as length, round(max(case when i = 1 then x end), 6) as first from m group by 1, 2""",
)
def _(t):
    """Mean of unit word vectors; a word's vector is that of vec_id = 10 x (its length modulo 50)."""
    tok = t.conversations.select(F.struct("conv_id", "turn").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("x"))
    tok = tok.select("id", (F.length("x") % 50 * 10).cast("long").alias("word"))
    got = X.sentence_vectors(tok, "id", "word", t.embeddings.select(F.col("vec_id").alias("word"), F.col("embedding").alias("v")), "v")
    return got.select("id.conv_id", "id.turn", "n", S.r6(S.norm(F.col("vec"))).alias("length"), S.r6(F.get("vec", F.lit(0))).alias("first"))


_ADD = r"<[a-zA-Z]+(?:-[0-9]+)?>|[a-zA-Z]+''[a-zA-Z]+|[a-zA-Z]+(?:-[a-zA-Z]+)+|[0-9]*[.,]?[0-9]+|[a-zA-Z]+"


@query("txt_06_classes", f"with k as (select doc_id, regexp_extract_all(regexp_replace(text, '[’`]', '''', 'g'), '{_ADD}') as tok from documents) select doc_id, len(tok)::bigint as n, md5(array_to_string(tok, ' ')) as tokens from k")
def _(t):
    """The additive tokenizer's classes, punctuation ignored."""
    k = X.additive_tokens(F.col("text"), ignore=["punctuation"])
    return t.documents.select("doc_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(k, " ")).alias("tokens"))


@query("txt_05_dutch_modifiers", """with t(k, tok, want) as (values (0, 'geen koorts hoest', 'koorts_NEG hoest'), (1, 'hoest neg', 'hoest_NEG'), (2, 'goede conditie', 'conditie_POS'), (3, 'conditie geen goed', 'conditie_NEG'), (4, 'pijn ja', 'pijn_POS'), (5, 'buik soepel', 'buik soepel'))
 select doc_id, want as bound from documents join t on doc_id % 6 = k""")
def _(t):
    texts = ["geen koorts hoest", "hoest neg", "goede conditie", "conditie geen goed", "pijn ja", "buik soepel"]
    tok = F.split(F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % 6 + 1).cast("int")), " ")
    return X.bind_dutch_modifiers(t.documents.select("doc_id", tok.alias("tok")), "tok").select("doc_id", F.array_join("tok", " ").alias("bound"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("rsh_05_transpose", " union all ".join(f"select '{n}' as stat, {', '.join(f'round({x} filter (where event_type = {repr(k)}), 4)::double as {k}' for k in _KINDS)} from events" for n, x in (("n", "count(*)"), ("total", "sum(value)"))))
def _(t):
    wide = t.events.groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return R.transposed(wide, "event_type", _KINDS, "stat")


@query("rsh_07_dense_sparse", "select 'l_quantity' as col, false as sparse union all select 'flag_rare', true union all select 'l_tax', (select sum((l_tax <> 0)::int) <= 0.5 * count(*) from lineitem)")
def _(t):
    df = t.lineitem.select("l_quantity", (F.col("l_linenumber") == 7).cast("int").alias("flag_rare"), "l_tax")
    dense, sparse = R.split_sparse(df, df.columns)
    return t.spark.createDataFrame([*((c, False) for c in dense), *((c, True) for c in sparse)], "col string, sparse boolean")


@query("agg_35_type_census", "select case when event_type like 'c%' then 'clicks' when event_type like 'p%' then 'buys' else 'other' end as kind, count(distinct event_type || '_' || user_id) as n from events group by 1")
def _(t):
    """Feature names that events give, counted by family."""
    names = [r[0] for r in t.events.select(F.concat("event_type", F.lit("_"), F.col("user_id").cast("string"))).distinct().collect()]
    return t.spark.createDataFrame(list(R.type_census(names, {"c": "clicks", "p": "buys"}).items()), "kind string, n long")


@query("prj_04_drop_helpers", "select l_orderkey, l_linenumber, l_tax from lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", F.lit(0).alias("index"), F.lit(0).alias("level_0"), F.lit(0).alias("Unnamed: 0"))
    return R.drop_helpers(df)
