"""Queries: scans, projections, filters, joins and nesting of the cohort tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cohort as C
from ..operators import frames as R
from ..operators import tagging as G
from ..sources import readers, sinks
from .registry import Tables, query
from .standins import EPI, JRN, OUT, PAT, episodes, journals, outcomes, patients, sql_day

START = 9131  # 1995-01-01


@query("src_01_read_table", "select n_nationkey, n_name, n_regionkey from nation")
def _(t: Tables):
    return readers.read_table(t.spark, f"{t.folder}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


@query("src_02_declared_csv", "select c_custkey, c_name, round(c_acctbal, 2) as c_acctbal from customer")
def _(t):
    path = sinks.write_table(t.customer.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal")), readers.scratch(t.spark, "csv"))
    return readers.read_table(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("src_03_tsv", "select p_partkey, p_name, p_type from part")
def _(t):
    path = sinks.write_table(t.part.select("p_partkey", "p_name", "p_type"), readers.scratch(t.spark, "tsv"))
    return readers.read_table(t.spark, path, "p_partkey long, p_name string, p_type string")


@query("src_04_first_rows", "select n_nationkey, n_name from nation order by n_nationkey limit 7")
def _(t):
    return t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey").limit(7)


@query("src_05_defined_csv", f"select o_orderkey as episode_id, o_orderstatus as status, {sql_day('o_orderdate')} as start_day from orders")
def _(t):
    twice = t.orders.select(F.concat(F.lit("  "), F.col("o_orderkey").cast("string")).alias("Id"), F.col("o_orderstatus").alias("St"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Dt"), F.lit("x").alias("Unused"))
    path = readers.scratch(t.spark, "csv")
    twice.union(twice).write.option("header", True).option("sep", "|").option("ignoreLeadingWhiteSpace", False).csv(path)
    spec = {"Id": {"name": "episode_id", "dtype": "int", "index": True}, "St": {"name": "status"}, "Dt": {"name": "start", "dtype": "datetime"}}
    return readers.read_defined_csv(t.spark, path, spec).select("episode_id", "status", S.days("start").alias("start_day"))


@query("src_06_patients", f"with {PAT} select pid, age_days, sex, event from pat where practice_id < 20")
def _(t):
    ids = patients(t).where("practice_id < 20").select("pid")
    return C.first_per_key(C.keep_ids(patients(t), ids, "pid"), ["pid"], [F.col("person_id")]).select("pid", "age_days", "sex", "event")


@query("src_07_episodes", f"""with {OUT} select episode_id, epi.pid, start_day, end_day, last from epi join outc on epi.pid = outc.pid
 where (end_day is null or start_day <= end_day) and start_day <= last and last - start_day <= 820""")
def _(t):
    e = episodes(t).where(C.valid_interval("start_day", "end_day"))
    return C.latest_band(e, outcomes(t), "pid", "start_day").select("episode_id", "pid", "start_day", "end_day", "last")


@query("src_08_journals", f"""with {OUT} select pid, episode_id, line, day from (select jrn.pid, episode_id, line, day, last,
 row_number() over (partition by episode_id, line order by day desc, partkey, suppkey, price, quantity, flag) as r from jrn join outc on jrn.pid = outc.pid) where r = 1 and day <= last and last - day <= 820""")
def _(t):
    j = C.first_per_key(journals(t), ["episode_id", "line"], [F.col("day").desc(), *map(F.col, ("partkey", "suppkey", "price", "quantity", "flag"))])
    return C.latest_band(j, outcomes(t), "pid", "day").select("pid", "episode_id", "line", "day")


@query("src_09_medications", f"""with {JRN} select distinct pid, day, p_brand as atc_code, p_name || ' ' || p_type as medication_txt from jrn join part on partkey = p_partkey where day between {START} and 11000""")
def _(t):
    m = journals(t).where(F.col("day").between(START, 11000)).join(t.part, F.col("partkey") == F.col("p_partkey"))
    return m.select("pid", "day", F.col("p_brand").alias("atc_code"), S.join_text("p_name", "p_type").alias("medication_txt")).distinct()


@query("src_10_measurements", f"""select user_id, {sql_day('ts')} as day, event_type, round(value, 6) as value, event_type || ' ' || props as txt from events where value is not null""")
def _(t):
    return t.events.dropna(subset=["value"]).select("user_id", S.days("ts").alias("day"), "event_type", S.r6(F.col("value")).alias("value"), S.join_text("event_type", "props").alias("txt"))


_MAPS = ({"1": "urgent", "2": "urgent", "3": "normal"}, {"3": "plain", "4": "plain"})
_MAP_SQL = "(values ('1', 'cats0_urgent'), ('2', 'cats0_urgent'), ('3', 'cats1_plain'), ('4', 'cats1_plain')) as m(code, category)"


@query("src_11_code_map", f"select code, category from {_MAP_SQL}")
def _(t):
    return R.code_map(t.spark, _MAPS)


@query("src_15_adjudication", f"with {PAT} select doc_id, pid, quality from labels join pat on doc_id % 100 + 1 = person_id where quality is not null")
def _(t):
    adj = t.labels.where("quality is not null").withColumn("person_id", F.col("doc_id") % 100 + 1)
    return adj.join(patients(t).select("person_id", "pid").dropDuplicates(["person_id"]), "person_id").select("doc_id", "pid", "quality")


@query("snk_06_json", """select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' as js from orders""")
def _(t):
    return t.orders.select("o_orderkey", sinks.as_json("o_orderkey", "o_orderstatus").alias("js"))


@query("snk_07_histogram", """with b as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem)
 select cast(least(floor((l_quantity - lo) / ((hi - lo) / 20)), 19) as bigint) as bin, count(*) as n from lineitem, b group by 1""")
def _(t):
    return sinks.histogram(t.lineitem, "l_quantity", 20)


@query("prj_01_projection", "select o_orderkey as episode_id, o_custkey as person_id, o_orderstatus as status from orders")
def _(t):
    return t.orders.select("o_custkey", "o_orderkey", "o_orderstatus").withColumnsRenamed({"o_orderkey": "episode_id", "o_custkey": "person_id", "o_orderstatus": "status"})


@query("prj_02_nested_projection", f"with {JRN} select epi.episode_id, count(day) as n_journals, min(day) as first_day, max(day) as last_day from epi left join jrn on epi.episode_id = jrn.episode_id group by 1")
def _(t):
    n = C.nest(episodes(t).select("episode_id", "pid"), journals(t).select("episode_id", "day", "flag", "line"), "episode_id", "journals", ["day", "line"])
    days = F.transform("journals", lambda j: j["day"])
    return n.select("episode_id", F.size(days).cast("long").alias("n_journals"), F.array_min(days).alias("first_day"), F.array_max(days).alias("last_day"))


@query("prj_05_single_valued", "select 'k' as dropped")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.lit(1).alias("k"))
    return t.spark.createDataFrame([(c,) for c in R.single_valued(rows)], "dropped string")


@query("prj_06_contrast", f"with {PAT} select sum(case when event then 1 else 0 end) > 50 and sum(case when event then 0 else 1 end) > 50 as enough from pat")
def _(t):
    return patients(t).agg(((F.sum(F.col("event").cast("int")) > 50) & (F.sum((~F.col("event")).cast("int")) > 50)).alias("enough"))


@query("fil_01_membership", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(t):
    ids = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return C.keep_ids(t.orders, ids, "o_custkey").select("o_orderkey")


@query("fil_01_not_member", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(t):
    ids = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return C.keep_ids(t.orders, ids, "o_custkey", negate=True).select("o_orderkey")


@query("fil_02_date_range", "select count(*) as n from lineitem where l_shipdate between timestamp '1996-01-01' and timestamp '1997-12-31'")
def _(t):
    return t.lineitem.where(F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))).agg(F.count("*").alias("n"))


@query("fil_03_valid_interval", f"with {EPI} select episode_id from epi where (end_day is null or start_day <= end_day) and start_day <= 10500")
def _(t):
    return episodes(t).where(C.valid_interval("start_day", "end_day") & (F.col("start_day") <= 10500)).select("episode_id")


@query("fil_04_missing_date", f"with {EPI} select episode_id, end_day from epi where end_day is not null")
def _(t):
    return episodes(t).dropna(subset=["end_day"]).select("episode_id", "end_day")


@query("fil_05_min_age", f"with {OUT} select pat.pid, last + age_days as age from outc join pat on outc.pid = pat.pid where last + age_days > 35 * 365.2422")
def _(t):
    return outcomes(t).join(patients(t), "pid").where(C.old_enough(F.col("last"), F.col("age_days"))).select("pid", (F.col("last") + F.col("age_days")).alias("age"))


@query("fil_05_age_groups", f"with {OUT} select cast(floor((last + age_days) / 1825.0 + 0.5) as bigint) as g, count(*) as n from outc join pat on outc.pid = pat.pid group by 1")
def _(t):
    return outcomes(t).join(patients(t), "pid").groupBy(F.floor((F.col("last") + F.col("age_days")) / 1825.0 + 0.5).cast("long").alias("g")).agg(F.count("*").alias("n"))


@query("fil_06_min_consults", f"with {JRN} select pid, count(*) as n, max(day) as last_consult from jrn group by 1 having count(*) >= 12 and max(day) >= 9496")
def _(t):
    return journals(t).groupBy("pid").agg(F.count("*").alias("n"), F.max("day").alias("last_consult")).where((F.col("n") >= 12) & (F.col("last_consult") >= 9496))


@query("fil_07_before_cohort", f"with {OUT} select pid from outc where last >= 10500")
def _(t):
    return outcomes(t).where("last >= 10500").select("pid")


@query("fil_08_censor", f"""with {OUT} select jrn.episode_id, line, day, count(*) as n from jrn join outc on jrn.pid = outc.pid join pat on jrn.pid = pat.pid
 where not event or day + 90 < last group by 1, 2, 3""")
def _(t):
    o = outcomes(t).join(patients(t).select("pid", "event"), "pid").select("pid", F.when(F.col("event"), F.col("last")).alias("t_event"))
    return journals(t).join(o, "pid").where(C.not_censored(F.col("day"), F.col("t_event"))).groupBy("episode_id", "line", "day").agg(F.count("*").alias("n"))


@query("fil_09_in_follow_up", f"""with {OUT} select distinct epi.episode_id from epi join outc on epi.pid = outc.pid left join jrn on epi.episode_id = jrn.episode_id
 where (start_day >= {START} and start_day <= last and start_day >= last - 2 * 365.2422) or (day >= {START} and day <= last and day >= last - 2 * 365.2422)""")
def _(t):
    """An episode counts by its own start or by one of its consults: both are (episode, day) rows of one filter, nothing is nested."""
    e = episodes(t).select("episode_id", "pid", F.col("start_day").alias("day"))
    own = e.select("episode_id", "pid").join(t.lineitem.select(F.col("l_orderkey").alias("k"), S.days("l_shipdate").alias("day")), F.col("episode_id") == F.col("k"))
    rows = e.union(own.select("episode_id", "pid", "day")).join(outcomes(t), "pid")
    return rows.where(C.in_follow_up(F.col("day"), F.col("last"), START)).select("episode_id").distinct()


@query("fil_10_effective_end", f"with {OUT} select pat.pid, case when event then last - 90 else last end as follow_up_effective from outc join pat on outc.pid = pat.pid")
def _(t):
    return outcomes(t).join(patients(t), "pid").select("pid", C.effective_end(F.col("event"), F.col("last")).alias("follow_up_effective"))


@query("fil_11_boolean_patterns", """select doc_id, regexp_matches(text, '(?i)token|secret') and not regexp_matches(text, '(?i)license') as tagged from documents""")
def _(t):
    return t.documents.select("doc_id", G.matches("text", ("and", ("or", "token", "secret"), ("not", "license"))).alias("tagged"))


@query("fil_12_code_prefix", "select p_partkey, p_type like 'ECON%' or p_brand like 'Brand#1%' as hit from part")
def _(t):
    return t.part.select("p_partkey", (G.has_code(["p_type"], ["ECON"]) | G.has_code(["p_brand"], "Brand#1")).alias("hit"))


@query("fil_13_code_format", "select p_partkey, case when regexp_full_match(p_brand, 'Brand#[12]\\d*') then p_brand end as code from part")
def _(t):
    return t.part.select("p_partkey", G.valid_code("p_brand", r"Brand#[12]\d*").alias("code"))


@query("fil_16_recent_positives", f"with {OUT} select pat.pid, last from outc join pat on outc.pid = pat.pid where event and last >= 10957")
def _(t):
    return outcomes(t).join(patients(t).where("event").select("pid"), "pid").where("last >= 10957").select("pid", "last")


@query("fil_17_adult_contacts", f"with {JRN} select jrn.pid, count(*) as n from jrn join pat on jrn.pid = pat.pid where day >= -age_days + 18 * 365.25 group by 1")
def _(t):
    return journals(t).join(patients(t).select("pid", "age_days"), "pid").where(F.col("day").cast("double") >= -F.col("age_days") + 18 * 365.25).groupBy("pid").agg(F.count("*").alias("n"))


@query("fil_18_interesting_clusters", """with c as (select label, count(*) as n, sum(case when vec_id % 7 = 0 then 1 else 0 end) as pos from embeddings group by 1)
 select label from c where n / (select sum(n) from c) >= 0.005 and pos / n >= 1.05 * (select sum(pos) / sum(n) from c)""")
def _(t):
    s = R.cluster_shares(t.embeddings.withColumn("y", F.col("vec_id") % 7 == 0), "label", "y")
    from pyspark.sql import Window

    base = F.sum("n_pos").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    return s.withColumn("base", base).where("mass >= 0.005 and incidence >= 1.05D * base").select("label")


@query("fil_20_medication_rows", f"with {OUT} select jrn.pid, count(*) as n from jrn join outc on jrn.pid = outc.pid where day - last + 730 between 0 and 730 group by 1")
def _(t):
    m = journals(t).join(outcomes(t), "pid").withColumn("t", S.rebase(F.col("day"), F.col("last")))
    return m.where("t is not null and t >= 0").groupBy("pid").agg(F.count("*").alias("n"))


@query("fil_21_text_eligibility", "select lang, count(distinct source) as n_patients, count(*) as n_docs, sum(case when length(text) > 0 then 1 else 0 end)::bigint as n_full from documents group by 1 having count(*) >= 100 and count(distinct source) >= 10")
def _(t):
    g = t.documents.groupBy("lang").agg(F.countDistinct("source").alias("n_patients"), F.count("*").alias("n_docs"), F.sum((F.length("text") > 0).cast("long")).alias("n_full"))
    return g.where("n_docs >= 100 and n_patients >= 10")


@query("jon_01_left_outcome", f"with {OUT} select pat.pid, last from pat left join outc on pat.pid = outc.pid")
def _(t):
    return patients(t).join(outcomes(t), "pid", "left").select("pid", "last")


@query("jon_02_band", f"with {OUT} select jrn.pid, count(*) as n, min(day) as first_day from jrn join outc on jrn.pid = outc.pid where day <= last and last - day <= 820 group by 1")
def _(t):
    return C.latest_band(journals(t), outcomes(t), "pid", "day").groupBy("pid").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


@query("jon_03_start_times", f"with {EPI}, st as (select pid, min(start_day) as s from epi group by 1) select epi.episode_id, start_day - s as since from epi join st on epi.pid = st.pid")
def _(t):
    s = episodes(t).groupBy("pid").agg(F.min("start_day").alias("s"))
    return episodes(t).join(s, "pid").select("episode_id", (F.col("start_day") - F.col("s")).alias("since"))


@query("jon_04_disagreement", "select d.doc_id from documents d join labels l on d.doc_id = l.doc_id where (length(text) > 1000) and quality = 0")
def _(t):
    return t.documents.where(F.length("text") > 1000).join(t.labels, "doc_id").where("quality = 0").select("doc_id")


@query("jon_05_exclude_pairs", f"with {EPI}, fp as (select pid, start_day from epi where code = '1') select episode_id from epi where not exists (select 1 from fp where fp.pid = epi.pid and fp.start_day = epi.start_day)")
def _(t):
    fp = episodes(t).where("code = '1'").select("pid", "start_day")
    return episodes(t).join(fp, ["pid", "start_day"], "left_anti").select("episode_id")


@query("jon_06_attributes", f"with {EPI} select pid, count(*) as n, max(price) as top, count(distinct code) as codes from epi group by 1")
def _(t):
    return episodes(t).groupBy("pid").agg(F.count("*").alias("n"), F.max("price").alias("top"), F.countDistinct("code").alias("codes"))


@query("jon_07_rebase", f"with {OUT} select episode_id, case when start_day - last + 730 <= 730 then start_day - last + 730 end as t from epi join outc on epi.pid = outc.pid")
def _(t):
    return episodes(t).join(outcomes(t), "pid").select("episode_id", S.rebase(F.col("start_day"), F.col("last")).alias("t"))


@query("jon_08_full_outer", f"with {JRN}, a as (select pid, count(*) as n_eps from epi where code = '1' group by 1), b as (select pid, count(*) as n_js from jrn where flag = 'R' group by 1) select coalesce(a.pid, b.pid) as pid, coalesce(n_eps, 0) as n_eps, coalesce(n_js, 0) as n_js from a full join b on a.pid = b.pid")
def _(t):
    rows = episodes(t).where("code = '1'").select("pid", F.lit(1).alias("e"), F.lit(0).alias("j")).union(journals(t).where("flag = 'R'").select("pid", F.lit(0), F.lit(1)))
    return rows.groupBy("pid").agg(F.sum("e").alias("n_eps"), F.sum("j").alias("n_js"))


@query("jon_10_left_chain", f"with {OUT}, n as (select pid, count(*) as n from epi group by 1) select pat.pid, sex, last, n from pat left join outc on pat.pid = outc.pid left join n on pat.pid = n.pid")
def _(t):
    one = episodes(t).groupBy("pid").agg(F.max("start_day").alias("last"), F.count("*").alias("n"))
    return patients(t).select("pid", "sex").join(one, "pid", "left")


@query("jon_12_cohort_clusters", "select vec_id, e.label, d.lang, l.quality from embeddings e join documents d on vec_id = d.doc_id join labels l on vec_id = l.doc_id")
def _(t):
    return t.embeddings.select(F.col("vec_id"), "label").join(t.documents.select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id").join(t.labels.select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id")


@query("jon_14_full_clusters", "select coalesce(e.vec_id, l.doc_id) as id, label, quality from embeddings e full join labels l on e.vec_id = l.doc_id")
def _(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "label").join(t.labels.select(F.col("doc_id").alias("id"), "quality"), "id", "full_outer")


@query("jon_15_theta", f"with {JRN}, s as (select pid, min(start_day) as t0 from epi where code = '2' group by 1) select s.pid, count(day) as n_before from s left join jrn on jrn.pid = s.pid and day < t0 group by 1")
def _(t):
    s = episodes(t).where("code = '2'").groupBy("pid").agg(F.min("start_day").alias("t0"))
    j = journals(t).select("pid", "day")
    return s.join(j, "pid", "left").groupBy("pid").agg(F.sum((F.col("day") < F.col("t0")).cast("long")).alias("n")).select("pid", F.coalesce("n", F.lit(0)).alias("n_before"))


@query("jon_16_nesting", f"with {JRN}, l as (select episode_id, list(day order by day) as days from jrn group by 1) select epi.pid, count(*) as n, sum(coalesce(len(days), 0))::bigint as n_days, max(days[1]) as latest_first from epi left join l on epi.episode_id = l.episode_id group by 1")
def _(t):
    inner = C.nest(episodes(t).select("episode_id", "pid", "start_day"), journals(t).select("episode_id", "day"), "episode_id", "journals", ["day"])
    outer = C.nest(patients(t).select("pid"), inner, "pid", "episodes", ["start_day", "episode_id"], descending=True).where(F.size("episodes") > 0)
    first = F.array_max(F.transform("episodes", lambda e: F.get(e["journals"], F.lit(0))["day"]))
    return outer.select("pid", F.size("episodes").cast("long").alias("n"), F.aggregate("episodes", F.lit(0).cast("long"), lambda s, e: s + F.size(e["journals"])).alias("n_days"), first.alias("latest_first"))


@query("jon_17_attach_lists", f"with {JRN}, m as (select pid, list(distinct partkey) as parts from jrn where flag = 'R' group by 1) select pat.pid, coalesce(len(parts), 0) as n from pat left join m on pat.pid = m.pid")
def _(t):
    m = journals(t).where("flag = 'R'").select("pid", "partkey").distinct()
    return C.nest(patients(t).select("pid"), m, "pid", "parts", ["partkey"]).select("pid", F.size("parts").cast("long").alias("n"))


@query("jon_18_code_lookup", f"with {EPI} select episode_id, coalesce(category, 'UNDEFINED_' || epi.code) as category from epi left join {_MAP_SQL} on epi.code = m.code")
def _(t):
    return R.roll_up(episodes(t), "code", R.code_map(t.spark, _MAPS)).select("episode_id", "category")


@query("jon_19_match_dates")
def _(t):
    p = patients(t).select("pid", "sex", "event")
    e = episodes(t).join(p, "pid").select("pid", "sex", F.col("start_day").alias("day"), "event")
    return C.match_dates(e.where("event"), e.where("not event"), ["sex"])


@query("pip_05_outcome", f"with {EPI} select pat.pid, case when event then min(start_day) else max(start_day) end as last, event as positive from pat left join epi on pat.pid = epi.pid group by pat.pid, event")
def _(t):
    return C.assemble_outcome(patients(t).select("pid", F.col("event").alias("confirmed")), episodes(t), patients(t))
