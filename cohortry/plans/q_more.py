"""Queries: composites of the cohort chain, and smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cohort as C
from ..operators import features as X
from ..operators import frames as R
from ..operators import models as M
from ..operators import text as T
from ..operators import topics as P
from .q_text import _TV, _model_frame, _topics
from .registry import query
from .standins import EPI, JRN, OUT, episodes, journals, outcomes, patients


@query("agg_37_mass", "select label, round(count(*) / (select count(*) from embeddings), 4) as mass from embeddings group by 1")
def _(t):
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("mass"))


@query("jon_09_keep_all_ids", f"with {JRN} select pat.pid, coalesce(n, 0) as n from pat left join (select pid, count(*) as n from jrn where flag = 'A' group by 1) j on pat.pid = j.pid")
def _(t):
    j = journals(t).where("flag = 'A'").groupBy("pid").agg(F.count("*").alias("n"))
    return patients(t).select("pid").join(j, "pid", "left").fillna(0, ["n"])


@query("jon_11_condition_tags", "select d.doc_id, coalesce(quality, 0) as quality, coalesce(toxic, 0) as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("jon_13_code_clusters", f"with {EPI} select epi.code, coalesce(m.cluster, -1) as cluster, count(*) as n from epi left join (values ('1', 0), ('2', 1), ('3', 1)) m(code, cluster) on epi.code = m.code group by 1, 2")
def _(t):
    m = t.spark.createDataFrame([("1", 0), ("2", 1), ("3", 1)], "code string, cluster int")
    return episodes(t).join(m, "code", "left").groupBy("code", F.coalesce("cluster", F.lit(-1)).alias("cluster")).agg(F.count("*").alias("n"))


@query("prj_03_name_selection", "select distinct event_type || '_' || user_id % 5 as name from events where regexp_matches(event_type, '^(cl|pu)')")
def _(t):
    """Of the feature names that events give, those of two kinds."""
    names = [r[0] for r in t.events.select(F.concat("event_type", F.lit("_"), (F.col("user_id") % 5).cast("string"))).distinct().collect()]
    return t.spark.createDataFrame([(c,) for c in sorted(R.select_names(names, r"^(cl|pu)"))], "name string")


@query("rsh_04_decode_names", "select distinct '0_24_tw_icpc_ep_cats' || p_size % 3 || '_' || p_brand as name, 'icpc_ep' as var, 'cats' || p_size % 3 || '_' || p_brand as code from part")
def _(t):
    c = t.part.select(F.concat(F.lit("0_24_tw_icpc_ep_cats"), (F.col("p_size") % 3).cast("string"), F.lit("_"), "p_brand").alias("name")).distinct()
    p = r"^\d+_\d+_(?:tw|m|n|mx)_(.*?)_(cats\d+_.*)$"
    return c.select("name", F.regexp_extract("name", p, 1).alias("var"), F.regexp_extract("name", p, 2).alias("code"))


@query("smp_02_first_rows", "select o_orderkey from orders order by o_orderkey limit 100")
def _(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("smp_04_half", None)
def _(t):
    return t.documents.sample(0.5, 42).select("doc_id")



@query("txt_02_trim_by_time", f"with {OUT} select jrn.pid, count(*) as n from jrn join outc on jrn.pid = outc.pid where day >= last - 400 group by 1")
def _(t):
    return journals(t).join(outcomes(t), "pid").where(F.col("day") >= F.col("last") - 400).groupBy("pid").agg(F.count("*").alias("n"))


@query("txt_10_random_chunks", None)
def _(t):
    """Chunks of 50 tokens from pseudo-random starts, one for each 50 tokens."""
    d = t.documents.select("doc_id", T.tokens(F.col("text"), "[a-z]+").alias("tok"))
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.size("tok") / 50).cast("int")), lambda i: F.pmod(F.xxhash64(F.lit(42), "doc_id", i), F.greatest(F.size("tok") - 49, F.lit(1))).cast("int"))
    return d.select("doc_id", F.explode(starts).alias("start"), "tok").select("doc_id", "start", F.size(F.slice("tok", F.col("start") + 1, 50)).alias("n"))


@query("ml_07_knee")
def _(t):
    """Where the parts' revenues, by falling size, bend."""
    total = [r[0] for r in t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").cast("double").alias("s")).orderBy(F.desc("s")).limit(100).select("s").collect()]
    return t.spark.createDataFrame([(int(R.knee(total)),)], "knee int")


@query("ml_08_boosted_importance", None)
def _(t):
    return t.spark.createDataFrame(M.importance(_model_frame(t), ["q", "l_discount", "l_tax"], "y", trees=5, boosted=True), "name string, importance double")


@query("ml_10_forward_selection", None)
def _(t):
    s = M.stepwise(_model_frame(t).withColumn("y", F.col("q") * 2 + F.col("l_tax")), ["l_discount", "l_tax", "l_extendedprice"], "y", backward=False, family="gaussian")
    return t.spark.createDataFrame([(i, ",".join(c), x) for i, (c, x) in enumerate(s)], "round int, columns string, aic double")


@query("ml_14_event_rates", f"with {OUT}, s as (select last - 9131 as tte, event, sex from outc join pat on outc.pid = pat.pid) select sex, sum(case when event and tte <= 730 then 1 else 0 end)::bigint as within_two, round(sum(case when event then 1 else 0 end) * 1000.0::double / (sum(tte) / 365.25::double), 6) as per_1000 from s group by 1")
def _(t):
    s = outcomes(t).join(patients(t), "pid").withColumn("tte", F.col("last") - 9131)
    y = F.col("event").cast("long")
    return s.groupBy("sex").agg(F.sum((F.col("event") & (F.col("tte") <= 730)).cast("long")).alias("within_two"), S.r6(F.sum(y) * 1000.0 / (F.sum("tte") / F.lit(365.25))).alias("per_1000"))



@query("top_05_all_topic_words", """with v as (select vec_id, embedding::double[] as e from embeddings), t as (select label as topic, list(x order by i) as v from (select label, i, avg(x) as x from (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings) group by 1, 2) group by 1),
 n as (select topic, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from t), s as (select topic, vec_id, list_inner_product(e, v) as s from v, n)
 select topic, vec_id from (select *, row_number() over (partition by topic order by s desc, vec_id) as r from s) where r <= 50""")
def _(t):
    """The 50 best of all vectors for each topic."""
    s = P.similarities(t.embeddings, "vec_id", "embedding", *_topics(t))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "vec_id"))).where("r <= 50").select("topic", "vec_id")


@query("top_07_multi_reduce", None)
def _(t):
    tv = P.topic_vectors(t.embeddings, "label", "embedding")
    names, v = P.matrix(tv, "label", "vec")
    size = dict(tv.select("label", "size").collect())
    rows = [(k, i, names[x]) for k in (2, 4, 8) for i, g in enumerate(P.reduce_topics(v, [size[n] for n in names], k)[1]) for x in g]
    return t.spark.createDataFrame(rows, "topics int, topic int, label int")


@query("top_12_topic_documents", f"with {_TV}, a as (select vec_id, arg_max(topic, s) as topic, max(s) as s from sim group by 1), r as (select topic, vec_id, row_number() over (partition by topic order by s desc, vec_id)::int as r from a) select topic, vec_id, r from r where r <= 10")
def _(t):
    s = P.similarities(t.embeddings, "vec_id", "embedding", *_topics(t), top=1)
    return s.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "vec_id"))).where("r <= 10").select("topic", "vec_id", "r")


@query("top_14_index_search", None)
def _(t):
    """The ten nearest rows of every vector whose id is divisible by 100, by the inverted-list index of all rows."""
    from ..operators.index import build_index

    index = build_index(t.embeddings, "vec_id", "embedding")
    return index.search(t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


@query("pip_02_person_distillation", f"""with {EPI} select pid, min(start_day) as t_min, max(coalesce(end_day, start_day)) as t_max, bool_or(status = 'P') as any_p, arg_max(code, (start_day, episode_id)) as last_code,
 min(case when code = '1' then start_day end) as t_1, min(case when code = '5' then start_day end) as t_5 from epi group by 1""")
def _(t):
    """One pass over the episodes of a person."""
    return episodes(t).groupBy("pid").agg(F.min("start_day").alias("t_min"), F.max(F.coalesce("end_day", "start_day")).alias("t_max"), F.bool_or(F.col("status") == "P").alias("any_p"), R.latest("code", "start_day", "episode_id").alias("last_code"), *(R.first_when(F.col("code") == c, "start_day").alias(f"t_{c}") for c in "15"))


@query("pip_03_cohort_extraction", f"""with {JRN}, f as (select jrn.pid, min(day) as t_0, max(day) as t_max from jrn join pat on jrn.pid = pat.pid where day >= -age_days + 18 * 365.25 and day >= 9500 group by 1)
 select pid, t_0, t_max, round((t_max - t_0) / 365.25::double, 6) as years from f where t_max > t_0""")
def _(t):
    j = journals(t).join(patients(t).select("pid", "age_days"), "pid").where((F.col("day").cast("double") >= -F.col("age_days") + 18 * 365.25) & (F.col("day") >= 9500))
    f = j.groupBy("pid").agg(F.min("day").alias("t_0"), F.max("day").alias("t_max")).where("t_max > t_0")
    return f.withColumn("years", S.r6((F.col("t_max") - F.col("t_0")) / F.lit(365.25)))


@query("pip_04_cohort_merge", f"with {OUT}, s as (select pat.pid, practice_id < 12 as first_source, last - 9131 as tte from outc join pat on outc.pid = pat.pid) select pid, case when first_source then 'a' else 'b' end as source_db, round(case when tte = 0 then 1e-9 else tte / 365.25::double / 10 end, 6) as tte from s")
def _(t):
    s = outcomes(t).join(patients(t), "pid").withColumn("tte", F.col("last") - 9131).withColumn("tte", S.r6(F.when(F.col("tte") == 0, 1e-9).otherwise(F.col("tte") / F.lit(365.25) / 10)))
    a, b = (s.where(c).select("pid", F.lit(n).alias("source_db"), "tte") for c, n in (("practice_id < 12", "a"), ("practice_id >= 12", "b")))
    return C.merge_disjoint(a, b, "pid")


@query("pip_06_start_times", None)
def _(t):
    """Control start dates matched to case start dates within sex and decade of birth."""
    p = patients(t).select("pid", "sex", F.floor(-F.col("age_days") / 3653).alias("band"), "event")
    e = episodes(t).join(p, "pid").select("pid", "sex", "band", F.col("start_day").alias("day"), "event")
    return C.match_dates(e.where("event"), e.where("not event"), ["sex", "band"])


@query("jon_19_matched_draws", None)
def _(t):
    """Controls get a sampled case start date of their sex that fits their own consults, out of 50 draws at most."""
    p = patients(t).select("pid", "sex", "event")
    cases = episodes(t).join(p.where("event"), "pid").select("sex", F.col("start_day").alias("day"))
    controls = journals(t).select("pid", "day").join(p.where("not event"), "pid").select("pid", "sex", "day")
    return C.match_draws(cases, controls, ["sex"])


@query("pip_08_code_prevalence", f"""with {EPI}, d as (select distinct epi.pid, epi.code, event from epi join pat on epi.pid = pat.pid), n as (select event, count(*) as total from pat group by 1)
 select code, d.event, count(*) as n, round(100.0::double * count(*) / any_value(total), 6) as pct from d join n on d.event = n.event group by 1, 2""")
def _(t):
    p = patients(t).select("pid", "event")
    n = p.groupBy("event").agg(F.count("*").alias("total"))
    d = episodes(t).select("pid", "code").distinct().join(p, "pid")
    return d.groupBy("code", "event").agg(F.count("*").alias("n")).join(n, "event").select("code", "event", "n", S.r6(F.col("n") * 100.0 / F.col("total")).alias("pct"))


@query("feat_windowed_events", f"with {OUT} select episode_id, t, round(greatest(t, 0)::double / 730 * 0.5 + 0.5, 4) as w from (select episode_id, start_day - last + 730 as t from epi join outc on epi.pid = outc.pid) where t between 0 and 730")
def _(t):
    return X.windowed(episodes(t), outcomes(t), "start_day").select("episode_id", "t", "w")


