"""Queries: aggregation, windows, sampling, sets, deduplication, reshaping, scaling, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables
from ..operators import cohort as C
from ..operators import features as X
from ..operators import frames as R
from .registry import Tables, query
from .standins import EPI, JRN, OUT, PAT, episodes, journals, outcomes, patients, sql_day

CODES = ["1", "2", "3", "4", "5"]
_WSQL = "round(greatest(t, 0)::double / 730 * 0.5 + 0.5, 4)"
WIN = f"""{OUT}, win as (select *, {_WSQL} as w from (select epi.*, last, start_day - last + 730 as t from epi join outc on epi.pid = outc.pid) where t between 0 and 730)"""


def _slice(t: Tables):
    e = episodes(t)
    e = X.windowed_by_own(e, "start_day")
    n = F.count("*").cast("double")
    f = e.groupBy("pid").agg(
        S.r6(F.sum("w")).alias("0_24_n_eps_"),
        S.r6(F.sum(F.when(F.col("end_day").isNull() | (F.col("end_day") > F.col("last")), 1.0).otherwise(0.0)) / n).alias("0_24_p_c2uces"),
        *(S.r6(F.sum(F.when(F.col("code") == c, F.col("w")).otherwise(0.0)) / n).alias(f"0_24_tw_icpc_{c}") for c in CODES),
    )
    return patients(t).select("pid", "sex", "event").join(f, "pid", "left").fillna(0.0)


_COLS = ", ".join(f"coalesce(round(sum(case when code = '{c}' then w else 0 end) / count(t), 6), 0) as \"0_24_tw_icpc_{c}\"" for c in CODES)


@query("slice_features", f"""with {WIN} select pat.pid, sex, event, coalesce(round(sum(w), 6), 0) as "0_24_n_eps_",
 coalesce(round(sum(case when t is not null and (end_day is null or end_day > last) then 1.0::double else 0 end) / nullif(count(t), 0), 6), 0) as "0_24_p_c2uces", {_COLS.replace('/ count(t)', '/ nullif(count(t), 0)')}
 from pat left join win on pat.pid = win.pid group by 1, 2, 3""")
def slice_features(t: Tables):
    """Time-weighted features of each patient in the follow-up window, with the outcome."""
    return _slice(t)


@query("agg_01_value_counts", "select o_orderstatus, count(*) as n from orders group by 1")
def _(t):
    return R.value_counts(t.orders, "o_orderstatus")


@query("agg_02_min_max_day", f"with {JRN} select pid, min(day) as t_min, max(day) as t_max from jrn group by 1")
def _(t):
    return journals(t).groupBy("pid").agg(F.min("day").alias("t_min"), F.max("day").alias("t_max"))


@query("agg_03_any", "select o_custkey, bool_or(o_orderstatus = 'P') as any_p from orders group by 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_p"))


@query("agg_04_last_value", f"with {EPI} select pid, arg_max(status, (start_day, episode_id)) as status, arg_max(end_day, (start_day, episode_id)) filter (where end_day is not null) as end_day from epi group by 1")
def _(t):
    return episodes(t).groupBy("pid").agg(R.latest("status", "start_day", "episode_id").alias("status"), R.latest("end_day", "start_day", "episode_id").alias("end_day"))


@query("agg_05_first_by_condition", f"with {EPI} select pid, {', '.join(f'''min(case when code = '{c}' then start_day end) as t_{c}''' for c in CODES)} from epi group by 1")
def _(t):
    return episodes(t).groupBy("pid").agg(*(R.first_when(F.col("code") == c, "start_day").alias(f"t_{c}") for c in CODES))


@query("agg_06_row_extremes", f"with {EPI} select episode_id, greatest(start_day, end_day) as hi, least(start_day, end_day) as lo from epi")
def _(t):
    return episodes(t).select("episode_id", F.greatest("start_day", "end_day").alias("hi"), F.least("start_day", "end_day").alias("lo"))


@query("agg_07_first_after", f"with {EPI} select pid, min(case when start_day >= 9862 then start_day end) as t_0 from epi group by 1")
def _(t):
    return episodes(t).groupBy("pid").agg(R.first_when(F.col("start_day") >= 9862, "start_day").alias("t_0"))


@query("agg_08_weighted_count", f"with {WIN} select pid, round(sum(w), 6) as n_eps from win group by 1")
def _(t):
    return X.windowed(episodes(t), outcomes(t), "start_day").groupBy("pid").agg(S.r6(F.sum("w")).alias("n_eps"))


@query("agg_09_mean_weights", f"with {WIN} select pid, {', '.join(f'''round(sum(case when code = '{c}' then round(w * 10000)::bigint else 0 end)::double / (count(*) * 10000), 9) as tw_{c}''' for c in CODES)} from win group by 1")
def _(t):
    """Mean weight of each code.  It takes the place of ``agg_09_code_means``, whose SQL summed doubles and rounded ties of the sum to six places, so that its last digit hung on the order of rows."""
    m = X.code_means(X.windowed(episodes(t), outcomes(t), "start_day"), "code", CODES, "tw_")
    return m.select("pid", *(F.round(f"tw_{c}", 9).alias(f"tw_{c}") for c in CODES))


@query("agg_10_code_sums", f"with {WIN} select pid, {', '.join(f'''round(coalesce(sum(case when code = '{c}' then w end), 0), 6) as sum_{c}''' for c in CODES)} from win group by 1")
def _(t):
    p = R.pivot_codes(X.windowed(episodes(t), outcomes(t), "start_day"), "pid", "code", CODES, F.col("w"), "sum_")
    return p.select("pid", *(S.r6(F.col(f"sum_{c}")).alias(f"sum_{c}") for c in CODES))


@query("agg_11_open_share", f"with {EPI} select pid, round(avg(case when end_day is null then 1.0::double else 0 end), 6) as p_open from epi group by 1")
def _(t):
    return episodes(t).groupBy("pid").agg(S.r6(F.avg(F.when(F.col("end_day").isNull(), 1.0).otherwise(0.0))).alias("p_open"))


@query("agg_12_acceleration", f"""with {WIN}, g as (select pid, t, count(*) as c from win group by 1, 2),
 h as (select pid, t, sum(c) over (partition by pid order by t) as s, t - lag(t) over (partition by pid order by t) as dt, sum(c) over (partition by pid) as n from g)
 select pid, round(case when max(n) >= 3 and sum(dt) > 0 then coalesce(sum(case when dt is not null and t > 0 then {_WSQL} * 2000 * (s::double / t) / dt * dt end), 0) / sum(dt) else 0 end, 4) as acceleration from h group by 1""")
def _(t):
    a = X.acceleration(X.windowed(episodes(t), outcomes(t), "start_day"))
    return a.select("pid", F.round("acceleration", 4).alias("acceleration"))


@query("agg_13_dispatch", "select event_type, round(avg(value), 6) as m_value, round(max(value), 6) as mx_value, count(value) as n_value, round(sum(value), 4) as value from events group by 1")
def _(t):
    return t.events.groupBy("event_type").agg(S.r6(F.avg("value")).alias("m_value"), S.r6(F.max("value")).alias("mx_value"), F.count("value").alias("n_value"), F.round(F.sum("value"), 4).alias("value"))


@query("agg_14_frequent_codes", "select p_type, n, row_number() over (order by p_type) - 1 as idx from (select p_type, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1 having count(*) > 100)")
def _(t):
    f = R.frequent_codes(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), "p_type", 100)
    return f.withColumn("idx", F.col("idx").cast("long"))


@query("agg_15_roll_up", f"with {WIN} select pid, coalesce(case when code in ('1', '2') then 'cats0_urgent' when code in ('3', '4') then 'cats1_plain' end, 'UNDEFINED_' || code) as category, round(sum(w), 6) as w from win group by 1, 2")
def _(t):
    m = R.code_map(t.spark, ({"1": "urgent", "2": "urgent", "3": "normal"}, {"3": "plain", "4": "plain"}))
    return R.roll_up(X.windowed(episodes(t), outcomes(t), "start_day"), "code", m).groupBy("pid", "category").agg(S.r6(F.sum("w")).alias("w"))


@query("agg_16_code_level", "select rpad(substr(upper(p_type), 1, 4), 7, '_') as level3, count(*) as n from part group by 1")
def _(t):
    return t.part.groupBy(S.atc_level(F.upper("p_type")).alias("level3")).agg(F.count("*").alias("n"))


@query("agg_17_first_letter", "select regexp_extract(event_type, '[A-Za-z]', 0) as letter, count(*) as n from events group by 1")
def _(t):
    return t.events.groupBy(F.regexp_extract("event_type", "[A-Za-z]", 0).alias("letter")).agg(F.count("*").alias("n"))


_CL = "(select label, vec_id, coalesce(quality, 0) as y from embeddings left join labels on vec_id = doc_id)"


def _clusters(t):
    return t.embeddings.select("vec_id", "label").join(t.labels.select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left").select("vec_id", "label", F.coalesce("quality", F.lit(0)).alias("y"))


@query("agg_18_cluster_shares", f"""with c as (select label, count(*) as n, sum(y)::bigint as n_pos from {_CL} group by 1)
 select label, n, n_pos, round(n_pos / n, 6) as incidence, round(n / (select sum(n) from c), 6) as mass,
 round((n_pos / (select sum(n_pos) from c)) / nullif((n - n_pos) / (select sum(n) - sum(n_pos) from c), 0), 6) as support from c""")
def _(t):
    s = R.cluster_shares(_clusters(t), "label", "y")
    return s.select("label", "n", "n_pos", *(S.r6(F.col(c)).alias(c) for c in ("incidence", "mass", "support")))


@query("agg_19_cluster_all", f"select coalesce(cast(label as varchar), 'ALL') as label, count(*) as n, sum(y)::bigint as n_pos, round(avg(y), 6) as incidence from {_CL} group by rollup (label)")
def _(t):
    return R.with_all(_clusters(t), "label", [F.count("*").alias("n"), F.sum("y").alias("n_pos"), S.r6(F.avg("y")).alias("incidence")])


@query("agg_20_cluster_score", "select l_returnflag, round(avg(l_discount), 6) as mean, round(stddev_samp(l_quantity), 6) as sd, round(avg(case when l_tax > 0.04 then 1.0::double else 0 end), 6) as incidence from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(S.r6(F.avg("l_discount")).alias("mean"), S.r6(F.stddev_samp("l_quantity")).alias("sd"), S.r6(F.avg(F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0))).alias("incidence"))


@query("agg_21_conditional_counts", "select o_orderpriority, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as n_f, sum(case when o_totalprice > 200000 then 1 else 0 end)::bigint as n_high from orders group by 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("n_f"), F.sum((F.col("o_totalprice") > 200000).cast("long")).alias("n_high"))


@query("agg_22_means_medians", "select coalesce(l_linestatus, 'ALL') as l_linestatus, round(avg(l_quantity), 6) as mean, median(l_quantity)::double as median from lineitem group by rollup (l_linestatus)")
def _(t):
    return R.with_all(t.lineitem, "l_linestatus", [S.r6(F.avg("l_quantity")).alias("mean"), F.median("l_quantity").cast("double").alias("median")])


@query("agg_23_age_by_group", f"with {PAT} select sex, event, round(avg(age_days), 6) as mean, round(stddev_samp(age_days), 6) as sd, round(quantile_cont(age_days, 0.25), 6) as q25, round(quantile_cont(age_days, 0.5), 6) as q50, round(quantile_cont(age_days, 0.75), 6) as q75 from pat group by 1, 2")
def _(t):
    q = F.percentile("age_days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = patients(t).groupBy("sex", "event").agg(S.r6(F.avg("age_days")).alias("mean"), S.r6(F.stddev_samp("age_days")).alias("sd"), q.alias("q"))
    return a.select("sex", "event", "mean", "sd", *(S.r6(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("q25", "q50", "q75"))))


@query("agg_24_thresholds", "select thr, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end)::bigint as n_pos, round(avg(case when l_returnflag = 'R' then 1.0::double else 0 end), 6) as incidence from lineitem, (values (10), (20), (30)) v(thr) where l_quantity >= thr group by 1")
def _(t):
    rows = t.lineitem.select("l_quantity", (F.col("l_returnflag") == "R").cast("long").alias("y"))
    rows = rows.withColumn("thr", F.explode(F.filter(F.array(F.lit(10), F.lit(20), F.lit(30)), lambda x: F.col("l_quantity") >= x)))
    return rows.groupBy("thr").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"), S.r6(F.avg("y")).alias("incidence"))


@query("agg_26_practice_incidence", f"with {PAT} select practice_id, count(*) as n, round(avg(case when event then 1.0::double else 0 end), 6) as incidence from pat group by 1")
def _(t):
    return patients(t).groupBy("practice_id").agg(F.count("*").alias("n"), S.r6(F.avg(F.col("event").cast("double"))).alias("incidence"))


@query("agg_27_describe_clusters", """with u as (select l_returnflag as cluster, 'quantity' as var, l_quantity::double as v from lineitem union all select l_returnflag, 'tax', l_tax from lineitem),
 g as (select var, avg(v) as gm, stddev_samp(v) / sqrt(count(*)) as gsem from u group by 1)
 select cluster, u.var, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd, round(stddev_samp(v) / sqrt(count(*)), 6) as sem, round(abs(avg(v) - any_value(gm)) / any_value(gsem), 4) as sigma from u join g on u.var = g.var group by 1, 2""")
def _(t):
    u = t.lineitem.select(F.col("l_returnflag").alias("cluster"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_tax").alias("tax")).unpivot("cluster", ["quantity", "tax"], "var", "v")
    sem = F.stddev_samp("v") / F.sqrt(F.count("*"))
    c = u.groupBy("cluster", "var").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), sem.alias("sem"))
    g = u.groupBy("var").agg(F.avg("v").alias("gm"), sem.alias("gsem"))
    return c.join(g, "var").select("cluster", "var", *(S.r6(F.col(x)).alias(x) for x in ("mean", "sd", "sem")), F.round(F.abs(F.col("mean") - F.col("gm")) / F.col("gsem"), 4).alias("sigma"))


@query("agg_28_summary", "select round(min(o_totalprice), 4) as lo, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(median(o_totalprice), 4) as q2, round(quantile_cont(o_totalprice, 0.75), 4) as q3, round(max(o_totalprice), 4) as hi, round(avg(o_totalprice), 4) as mean, round(stddev_pop(o_totalprice), 4) as sd from orders")
def _(t):
    c = "o_totalprice"
    s = t.orders.agg(F.min(c).alias("lo"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).alias("hi"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"))
    return s.select(*(F.round(x, 4).alias(n) for n, x in (("lo", "lo"), ("q1", F.get("q", F.lit(0))), ("q2", F.get("q", F.lit(1))), ("q3", F.get("q", F.lit(2))), ("hi", "hi"), ("mean", "mean"), ("sd", "sd"))))


@query("agg_29_missing", f"with {EPI} select round(100.0::double * (count(*) - count(end_day)) / count(*), 6) as pct_end, count(distinct end_day) as n_end, count(distinct code) as n_code from epi")
def _(t):
    return episodes(t).agg(S.r6((F.count("*") - F.count("end_day")) * 100.0 / F.count("*")).alias("pct_end"), F.countDistinct("end_day").alias("n_end"), F.countDistinct("code").alias("n_code"))


@query("agg_30_corpus_stats", "with w as (select doc_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+')) as w from documents), d as (select doc_id, count(*) as n from w where w <> '' group by 1) select (select count(distinct w) from w where w <> '') as vocabulary, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as sd, median(n)::double as median from d")
def _(t):
    w = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+")).alias("w")).where("w <> ''")
    d = w.groupBy("doc_id").agg(F.count("*").alias("n"))
    v = w.select("w").distinct().agg(F.count("*").alias("vocabulary"))
    return d.agg(S.r6(F.avg("n")).alias("mean"), S.r6(F.stddev_pop("n")).alias("sd"), F.median("n").cast("double").alias("median")).withColumn("vocabulary", v.scalar())


@query("agg_31_correlations", "select round(corr(l_quantity, l_extendedprice), 6) as qp, round(corr(l_quantity, l_discount), 6) as qd, round(corr(l_extendedprice, l_tax), 6) as pt from lineitem")
def _(t):
    return t.lineitem.agg(S.r6(F.corr("l_quantity", "l_extendedprice")).alias("qp"), S.r6(F.corr("l_quantity", "l_discount")).alias("qd"), S.r6(F.corr("l_extendedprice", "l_tax")).alias("pt"))


@query("agg_32_person_years", f"with {OUT}, s as (select last - 9131 as tte, event, age_days from outc join pat on outc.pid = pat.pid), q as (select quantile_cont(age_days, 0.5) as m from s) select age_days >= m as high, round(sum(case when event then tte else 0 end)::double / sum(tte), 6) as rate from s, q group by 1")
def _(t):
    s = outcomes(t).join(patients(t), "pid").select((F.col("last") - 9131).alias("tte"), "event", "age_days")
    m = s.agg(F.percentile("age_days", 0.5).alias("m")).scalar()
    return s.groupBy((F.col("age_days") >= m).alias("high")).agg(S.r6(F.sum(F.when(F.col("event"), F.col("tte")).otherwise(0)) / F.sum("tte")).alias("rate"))


@query("agg_33_calibration", """with q as (select quantile_cont(l_extendedprice, [0.0, 1/7, 2/7, 3/7, 4/7, 5/7, 6/7]) as e from lineitem), b as (select l_extendedprice as p, l_returnflag = 'R' as y, greatest(1, len(list_filter(e, lambda x: x < l_extendedprice))) as bin from lineitem, q)
 select cast(bin as bigint) as bin, round(avg(p), 4) as predicted, round(avg(case when y then 1.0::double else 0 end), 6) as observed from b group by 1""")
def _(t):
    e = t.lineitem.agg(F.percentile("l_extendedprice", F.array(*(F.lit(i / 7) for i in range(7)))).alias("e")).scalar()
    b = t.lineitem.select(F.col("l_extendedprice").alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"), e.alias("e"))
    b = b.withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("e", lambda x: x < F.col("p")))).cast("long"))
    return b.groupBy("bin").agg(F.round(F.avg("p"), 4).alias("predicted"), S.r6(F.avg("y")).alias("observed"))


@query("agg_34_crosstab", "select l_returnflag, sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as f, sum(case when l_linestatus = 'O' then 1 else 0 end)::bigint as o from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("agg_36_best_cluster", f"with c as (select label, avg(y) as inc, count(*) as n from {_CL} group by 1) select label, n from c where n = (select max(n) from c)")
def _(t):
    c = _clusters(t).groupBy("label").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.rank().over(Window.orderBy(F.desc("n")))).where("r = 1").select("label", "n")


@query("agg_38_first_contact", f"with {JRN}, j as (select pid, min(day) as d from jrn group by 1), e as (select pid, min(start_day) as s, max(coalesce(end_day, 11688)) as z from epi group by 1) select e.pid, least(s, d) as first_day, z - least(s, d) as duration from e left join j on e.pid = j.pid")
def _(t):
    j = journals(t).groupBy("pid").agg(F.min("day").alias("d"))
    e = episodes(t).groupBy("pid").agg(F.min("start_day").alias("s"), F.max(F.coalesce("end_day", F.lit(11688))).alias("z")).join(j, "pid", "left")
    return e.select("pid", F.least("s", "d").alias("first_day"), (F.col("z") - F.least("s", "d")).alias("duration"))


@query("agg_39_auc", """with g as (select l_quantity as s, sum(case when l_returnflag = 'R' then 1 else 0 end) as p, count(*) as n from lineitem group by 1), r as (select *, sum(n) over (order by s) - n + (n + 1) / 2.0::double as rank from g)
 select round((sum(p * rank) - sum(p) * (sum(p) + 1) / 2.0::double) / (sum(p)::double * (sum(n) - sum(p))), 6) as auc from r""")
def _(t):
    return R.auc(t.lineitem.withColumn("y", F.col("l_returnflag") == "R"), "l_quantity", "y").select(S.r6(F.col("auc")).alias("auc"))


@query("agg_40_confusion", "select sum(case when l_quantity >= 25 and l_returnflag = 'R' then 1 else 0 end)::bigint as tp, sum(case when l_quantity >= 25 and l_returnflag <> 'R' then 1 else 0 end)::bigint as fp, sum(case when l_quantity < 25 and l_returnflag <> 'R' then 1 else 0 end)::bigint as tn, sum(case when l_quantity < 25 and l_returnflag = 'R' then 1 else 0 end)::bigint as fn from lineitem")
def _(t):
    p, y = F.col("l_quantity") >= 25, F.col("l_returnflag") == "R"
    return t.lineitem.agg(*(F.sum(c.cast("long")).alias(n) for n, c in (("tp", p & y), ("fp", p & ~y), ("tn", ~p & ~y), ("fn", ~p & y))))


@query("agg_41_prevalence", f"with {OUT} select cast(floor((last - 9131) / 365.25) as bigint) as year, count(*) as n, sum(case when event then 1 else 0 end)::bigint as n_event from outc join pat on outc.pid = pat.pid group by 1")
def _(t):
    return outcomes(t).join(patients(t), "pid").groupBy(F.floor((F.col("last") - 9131) / F.lit(365.25)).alias("year")).agg(F.count("*").alias("n"), F.sum(F.col("event").cast("long")).alias("n_event"))


@query("agg_42_distribution", "select cast(floor(l_discount * 100 / 2) as bigint) as bin, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end)::bigint as n_r from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy(F.floor(F.col("l_discount") * 100 / 2).alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("n_r"))


@query("win_01_keep_first", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey, l_suppkey, l_extendedprice) as r from lineitem) where r = 1")
def _(t):
    return C.first_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), *map(F.col, ("l_partkey", "l_suppkey", "l_extendedprice"))]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("win_02_first_last_episode", f"with {EPI} select pid, arg_min(episode_id, (start_day, episode_id)) as first_ep, arg_max(episode_id, (start_day, episode_id)) as last_ep from epi group by 1")
def _(t):
    o = F.struct("start_day", "episode_id")
    return episodes(t).groupBy("pid").agg(F.min_by("episode_id", o).alias("first_ep"), F.max_by("episode_id", o).alias("last_ep"))


@query("win_04_velocity", f"with {EPI} select episode_id, start_day - lag(start_day) over w as delta, count(*) over (partition by pid order by start_day, episode_id) as running from epi window w as (partition by pid order by start_day, episode_id)")
def _(t):
    w = Window.partitionBy("pid").orderBy("start_day", "episode_id")
    return episodes(t).select("episode_id", (F.col("start_day") - F.lag("start_day").over(w)).alias("delta"), F.count("*").over(w).alias("running"))


@query("win_05_top_per_family", "select p_type, p_partkey from (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as r from part) where r <= 3")
def _(t):
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_type", "p_partkey")


@query("win_06_cumulative", f"with c as (select label, count(*) as n, sum(y)::bigint as p from {_CL} group by 1), d as (select *, p / n as inc from c) select label, sum(n) over w::bigint as cum_n, sum(p) over w::bigint as cum_p from d window w as (order by inc desc, label)")
def _(t):
    c = _clusters(t).groupBy("label").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    w = Window.orderBy(F.desc(F.col("p") / F.col("n")), "label")
    return c.select("label", F.sum("n").over(w).alias("cum_n"), F.sum("p").over(w).alias("cum_p"))


@query("srt_01_sorted_arrays", f"with {JRN} select episode_id, list(day order by day)[1] as first_day, list(day order by day desc)[1] as last_day from jrn group by 1")
def _(t):
    j = journals(t).groupBy("episode_id").agg(F.collect_list("day").alias("d"))
    return j.select("episode_id", F.get(F.sort_array("d"), F.lit(0)).alias("first_day"), F.get(F.sort_array("d", False), F.lit(0)).alias("last_day"))


@query("srt_03_earliest", "select o_orderkey from orders order by o_orderdate, o_orderkey limit 10")
def _(t):
    return t.orders.orderBy("o_orderdate", "o_orderkey").limit(10).select("o_orderkey")


@query("smp_01_shuffle")
def _(t):
    return t.orders.select("o_orderkey").orderBy(F.rand(42)).limit(100)


@query("smp_03_stratified")
def _(t):
    return t.orders.sampleBy("o_orderstatus", {"F": 0.5, "O": 0.25, "P": 1.0}, 42).select("o_orderkey", "o_orderstatus")


@query("smp_05_folds", f"with {PAT} select pid, cast(row_number() over (partition by event order by md5(pid || '#42'), pid) % 4 as int) as fold from pat")
def _(t):
    return R.folds(patients(t), 4, "event", "pid").select("pid", "fold")


@query("smp_06_class_weights", f"with {PAT} select pid, round(case when event then (select sum(case when event then 0 else 1 end) from pat) else (select sum(case when event then 1 else 0 end) from pat) end::double / (select count(*) from pat), 6) as weight from pat")
def _(t):
    n = patients(t).agg(F.count("*").alias("n"), F.sum(F.col("event").cast("long")).alias("p"))
    share = n.select((F.col("p") / F.col("n")).alias("s")).scalar()
    return patients(t).select("pid", S.r6(F.when(F.col("event"), F.lit(1.0) - share).otherwise(share)).alias("weight"))


@query("prt_01_even_split", "select n_nationkey, cast(ntile(4) over (order by n_nationkey) as int) as part from nation")
def _(t):
    return R.even_split(t.nation.select("n_nationkey"), "n_nationkey", 4)


_A, _B = "select distinct o_custkey as k from orders where o_orderstatus = 'F'", "select distinct o_custkey as k from orders where o_orderpriority like '1%'"
for _how, _sql in (("union", f"{_A} union {_B}"), ("intersection", f"({_A}) intersect ({_B})"), ("difference", f"({_A}) except ({_B})"), ("symmetric", f"(({_A}) except ({_B})) union (({_B}) except ({_A}))")):

    @query(f"set_01_{_how}", _sql)
    def _(t, how=_how):
        a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
        b = t.orders.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k"))
        return R.set_operation(a, b, how)


@query("set_02_distinct", "select distinct p_brand from part where p_brand is not null")
def _(t):
    return t.part.select("p_brand").dropna().dropDuplicates()


@query("set_03_row_union", "select c_custkey as k, c_name as name, null::bigint as n from customer union all select s_suppkey, s_name, s_nationkey from supplier")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("n")), allowMissingColumns=True)


@query("set_04_merge_sources", "select c_custkey from customer")
def _(t):
    return C.merge_disjoint(t.customer.where("c_nationkey < 12").select("c_custkey"), t.customer.where("c_nationkey >= 12").select("c_custkey"), "c_custkey")


@query("ded_02_ignore_ids", "select distinct l_orderkey, l_partkey, l_suppkey from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").dropDuplicates()


@query("ded_03_before_truncation", f"with {JRN} select pid, substr(p_type, 1, 4) as code, count(*) as n from (select distinct pid, p_type, day from jrn join part on partkey = p_partkey) group by 1, 2")
def _(t):
    m = journals(t).join(t.part, F.col("partkey") == F.col("p_partkey")).select("pid", "p_type", "day").dropDuplicates()
    return m.groupBy("pid", F.substring("p_type", 1, 4).alias("code")).agg(F.count("*").alias("n"))


@query("ded_04_texts", "select source, count(*) as n from (select distinct source, trim(text) as x from documents) where x <> '' group by 1")
def _(t):
    return t.documents.select("source", F.trim("text").alias("x")).where("x <> ''").dropDuplicates().groupBy("source").agg(F.count("*").alias("n"))


@query("ded_05_day_code", f"with {JRN} select pid, count(*) as n from (select distinct pid, day, flag from jrn) group by 1")
def _(t):
    return journals(t).select("pid", "day", "flag").distinct().groupBy("pid").agg(F.count("*").alias("n"))


@query("rsh_01_pivot", "select p_brand, " + ", ".join(f"coalesce(sum(case when p_type = '{x}' then 1 else 0 end), 0)::bigint as {x.lower()}" for x in ("ECONOMY", "STANDARD", "PROMO")) + " from part group by 1")
def _(t):
    p = t.part.groupBy("p_brand").pivot("p_type", ["ECONOMY", "STANDARD", "PROMO"]).count().fillna(0)
    return p.select("p_brand", *(F.col(x).alias(x.lower()) for x in ("ECONOMY", "STANDARD", "PROMO")))


@query("rsh_02_dummies", "select o_orderkey, case when o_orderstatus = 'O' then 1 else 0 end as is_o, case when o_orderstatus = 'P' then 1 else 0 end as is_p from orders")
def _(t):
    return t.orders.select("o_orderkey", *((F.col("o_orderstatus") == c).cast("int").alias(f"is_{c.lower()}") for c in "OP"))


@query("rsh_03_weighted_one_hot", f"with {WIN} select episode_id, {', '.join(f'''case when code = '{c}' then w else 0 end as c{c}''' for c in CODES)} from win")
def _(t):
    e = X.windowed(episodes(t), outcomes(t), "start_day")
    return e.select("episode_id", *(F.when(F.col("code") == c, F.col("w")).otherwise(0.0).alias(f"c{c}") for c in CODES))


@query("rsh_06_flatten", f"with {JRN} select pid, jrn.episode_id, day, flag from jrn")
def _(t):
    n = C.nest(episodes(t).select("episode_id", "pid"), journals(t).select("episode_id", "day", "flag", "line"), "episode_id", "journals", ["day", "line"])
    return n.select("pid", "episode_id", F.explode("journals").alias("j")).select("pid", "episode_id", "j.day", "j.flag")


@query("rsh_06_flat_rows", f"with {JRN} select pid, jrn.episode_id, day, flag from jrn")
def _(t):
    """Nested journals made flat by a lateral table function."""
    tables.register(t.spark)
    n = C.nest(episodes(t).select("episode_id", "pid"), journals(t).select("episode_id", "day", "flag", "line"), "episode_id", "journals", ["day", "line"])
    return t.spark.sql("select n.pid, n.episode_id, f.day, f.flag from {n} n, lateral flat_days(n.journals) f", n=n)


@query("scl_01_max_abs", "select s_suppkey, round(s_acctbal / (select max(abs(s_acctbal)) from supplier), 6) as x from supplier")
def _(t):
    return R.max_abs(t.supplier, ["s_acctbal"])[0].select("s_suppkey", S.r6(F.col("s_acctbal")).alias("x"))


@query("scl_02_robust", "select c_custkey, round((c_acctbal - (select median(c_acctbal) from customer)) / (select quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) from customer), 6) as x from customer")
def _(t):
    return R.robust(t.customer, ["c_acctbal"])[0].select("c_custkey", S.r6(F.col("c_acctbal")).alias("x"))


@query("scl_03_min_max", "select p_partkey, round((p_retailprice - (select min(p_retailprice) from part)) / (select max(p_retailprice) - min(p_retailprice) from part), 6) as x from part")
def _(t):
    return R.min_max(t.part, ["p_retailprice"]).select("p_partkey", S.r6(F.col("p_retailprice")).alias("x"))


@query("scl_04_inverse", "select c_custkey, round(c_acctbal, 4) as x from customer")
def _(t):
    df, by = R.robust(t.customer, ["c_acctbal"])
    return df.select("c_custkey", F.round(F.col("c_acctbal") * by["c_acctbal"][1] + by["c_acctbal"][0], 4).alias("x"))


@query("scl_05_fill", f"with {EPI} select episode_id, coalesce(end_day, 0) as end_day from epi")
def _(t):
    return episodes(t).fillna(0, ["end_day"]).select("episode_id", "end_day")


@query("scl_06_lift", "select event_id, case when v is null then null else greatest(v * 2 - 1, 0) end as v from (select event_id, round(0.6 + (event_id % 40) / 100.0::double, 6) as v from events)")
def _(t):
    return R.lift_scores(t.events.select("event_id", S.r6(F.lit(0.6) + (F.col("event_id") % 40) / 100.0).alias("v")), ["v"])


@query("scl_07_time_to_event", f"with {OUT} select pat.pid, coalesce(event and 9862 <= last, false) as le, coalesce(event and 9862 < last, false) as lt from pat left join outc on pat.pid = outc.pid")
def _(t):
    x = patients(t).join(outcomes(t), "pid", "left")
    return x.select("pid", F.coalesce(F.col("event") & (F.lit(9862) <= F.col("last")), F.lit(False)).alias("le"), F.coalesce(F.col("event") & (F.lit(9862) < F.col("last")), F.lit(False)).alias("lt"))


@query("scl_09_severity", "with q as (select p_type, quantile_cont(p_retailprice, 0.33) as a, quantile_cont(p_retailprice, 0.66) as b from part group by 1) select p_partkey, case when p_retailprice <= a then 'lo' when p_retailprice <= b then 'med' else 'hi' end as sev from part join q on part.p_type = q.p_type")
def _(t):
    q = t.part.groupBy("p_type").agg(F.percentile("p_retailprice", F.array(F.lit(0.33), F.lit(0.66))).alias("q"))
    p = t.part.join(q, "p_type")
    return p.select("p_partkey", F.when(F.col("p_retailprice") <= F.get("q", F.lit(0)), "lo").when(F.col("p_retailprice") <= F.get("q", F.lit(1)), "med").otherwise("hi").alias("sev"))


@query("str_01_key_split", f"with {PAT} select pid, split_part(pid, '|', 1) as person, split_part(pid, '|', 2) as practice from pat")
def _(t):
    return patients(t).select("pid", S.split_key(F.col("pid"), 0).alias("person"), S.split_key(F.col("pid"), 1).alias("practice"))


@query("str_03_pieces", "select p_partkey, rpad(lower(trim(p_name)), 30, '_') as padded, starts_with(p_type, 'PRO') as pro from part")
def _(t):
    return t.part.select("p_partkey", F.rpad(F.lower(F.trim("p_name")), 30, "_").alias("padded"), F.startswith("p_type", F.lit("PRO")).alias("pro"))


@query("str_04_parse_icpc", "select p_partkey, nullif(regexp_extract(upper('K' || lpad((p_partkey % 100)::varchar, 2, '0')), '[ABDFHKLNPRSTUWXYZ](?:0[1-9]|[1-9][0-9])(?:[.](?:0[1-9]|[1-9][0-9]))?', 0), '') as icpc from part")
def _(t):
    return t.part.select("p_partkey", S.parse_icpc(F.concat(F.lit("K"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))).alias("icpc"))


@query("str_06_levels", "select p_partkey, substr(p_name, 1, 4) as level, split_part(p_brand, '#', 1) as top from part")
def _(t):
    return t.part.select("p_partkey", F.substring("p_name", 1, 4).alias("level"), F.substring_index("p_brand", "#", 1).alias("top"))


@query("str_07_unescape")
def _(t):
    return t.pages.select("page_id", F.length(S.html_unescape(F.col("html"))).alias("n"))


@query("str_08_regex", "select doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+'))::bigint as n, regexp_matches(text, 'the') as has, length(regexp_replace(text, '[aeiou]', '', 'g')) as consonants from documents")
def _(t):
    return t.documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).cast("long").alias("n"), F.col("text").rlike("the").alias("has"), F.length(F.regexp_replace("text", "[aeiou]", "")).cast("long").alias("consonants"))


@query("dt_01_days", f"select event_id, {sql_day('ts')} as day, cast(round_even(epoch_us(ts) / 86400e6, 0) as bigint) as rounded from events")
def _(t):
    return t.events.select("event_id", S.days("ts").alias("day"), S.days_rounded("ts").alias("rounded"))


@query("dt_02_day_string", f"with {EPI} select episode_id, strftime(date '1970-01-01' + cast(start_day as int), '%Y-%m-%d') as d from epi")
def _(t):
    return episodes(t).select("episode_id", S.day_string(F.col("start_day")).alias("d"))


@query("dt_03_years", "select o_orderkey, round((epoch_us(l.s) - epoch_us(o_orderdate)) / 86400e6 / 365.25, 6) as years from orders join (select l_orderkey, max(l_shipdate) as s from lineitem group by 1) l on o_orderkey = l_orderkey")
def _(t):
    s = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    return t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", S.r6(S.year_difference("s", "o_orderdate")).alias("years"))


@query("dt_04_midnight", "select event_id, epoch_us(date_trunc('day', ts)) as us from events")
def _(t):
    return t.events.select("event_id", F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("us"))


@query("dt_05_decades", f"with {OUT} select pat.pid, round_even((last + age_days) / 3653.0::double, 0) as decades, round((last + age_days) / 365.25::double, 6) as years from outc join pat on outc.pid = pat.pid")
def _(t):
    a = (F.col("last") + F.col("age_days")).cast("double")
    return outcomes(t).join(patients(t), "pid").select("pid", F.bround(a / 3653.0).alias("decades"), S.r6(a / F.lit(365.25)).alias("years"))


@query("mth_02_safe_percent", "select s_suppkey, round(100.0::double * s_nationkey / greatest(s_nationkey - s_nationkey, 1e-6), 2) as a, round((s_acctbal / 20000 + 1) / 2, 6) as b from supplier")
def _(t):
    return t.supplier.select("s_suppkey", F.round(S.safe_percent(F.col("s_nationkey"), F.lit(0)), 2).alias("a"), S.r6(S.cosine_unit(F.col("s_acctbal") / 20000)).alias("b"))


@query("mth_04_phi", """with c as (select o_orderstatus as code, o_orderpriority as cluster, count(*) as a from orders group by 1, 2),
 d as (select *, sum(a) over (partition by code) - a as b, sum(a) over (partition by cluster) - a as c, sum(a) over () as n from c)
 select code, cluster, a as n, round((a::double * (n - a - b - c) - b::double * c) / sqrt((a + b)::double * (n - a - b)::double * (a + c)::double * (n - a - c)::double), 6) as phi from d""")
def _(t):
    p = R.phi(t.orders.select(F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("cluster")), "code", "cluster")
    return p.select("code", "cluster", "n", S.r6(F.col("phi")).alias("phi"))


@query("mth_05_softmax", "select p_partkey, round(exp(p_size - max(p_size) over w) / sum(exp(p_size)) over w * exp(max(p_size) over w), 6) as p from part window w as (partition by p_type)")
def _(t):
    w = Window.partitionBy("p_type")
    e = F.exp(F.col("p_size") - F.max("p_size").over(w))
    return t.part.withColumn("e", e).select("p_partkey", S.r6(F.col("e") / F.sum("e").over(w)).alias("p"))


@query("arr_01_flatten", f"with {JRN} select episode_id, count(*) as n, sum(day)::bigint as total, max(day) as last_day from jrn group by 1")
def _(t):
    j = journals(t).groupBy("episode_id").agg(F.collect_list(F.array("day")).alias("a"))
    f = F.flatten("a")
    return j.select("episode_id", F.size(f).cast("long").alias("n"), F.aggregate(f, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.element_at(F.reverse(F.sort_array(f)), 1).alias("last_day"))


@query("arr_02_positions", "select vec_id, len(list_filter(embedding, lambda x: x > 0.1))::bigint as n, cast(list_position(embedding, list_max(embedding)) as bigint) as best from embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.size(F.filter("embedding", lambda x: x.cast("double") > F.lit(0.1))).cast("long").alias("n"), F.array_position("embedding", F.array_max("embedding")).alias("best"))


@query("arr_04_smoothing", "select n_nationkey, round(avg(n_regionkey) over (order by n_nationkey rows between 2 preceding and 2 following), 6) as smooth from nation")
def _(t):
    return t.nation.select("n_nationkey", S.r6(F.avg("n_regionkey").over(Window.orderBy("n_nationkey").rowsBetween(-2, 2))).alias("smooth"))


@query("jsn_01_parse", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("map_01_invert", "select o_orderstatus as category, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as codes from orders group by 1")
def _(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("category")).agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("codes"))


@query("ml_05_correlation_prune", "select 'b' as dropped")
def _(t):
    df = t.lineitem.select(F.col("l_quantity").alias("a"), (F.col("l_quantity") * 2 + 1).alias("b"), F.col("l_tax").alias("c"))
    return t.spark.createDataFrame([(c,) for c in R.correlation_prune(df, ["a", "b", "c"])], "dropped string")


@query("ml_13_risk_score", f"with {OUT}, m as (select avg(age_days) as ma, avg(case when event then 1.0::double else 0 end) as me from pat) select pid, round(exp(0.0001::double * (age_days - ma) + 0.5::double * (case when event then 1 else 0 end - me)), 6) as risk from pat, m")
def _(t):
    p = patients(t).select("pid", "age_days", F.col("event").cast("int").alias("event"))
    m = p.agg(F.avg("age_days").alias("age_days"), F.avg("event").alias("event")).first()
    return p.select("pid", S.r6(X.risk_score({"age_days": 0.0001, "event": 0.5}, m.asDict())).alias("risk"))


@query("ml_15_kaplan_meier", f"""with {OUT}, s as (select last - 9131 as tte, event from outc join pat on outc.pid = pat.pid), g as (select tte, count(*) as n, sum(case when event then 1 else 0 end)::bigint as d from s group by 1),
 r as (select tte, d, sum(n) over (order by tte desc)::bigint as at_risk from g) select tte, at_risk, d, round(exp(sum(ln(1 - d::double / at_risk)) over (order by tte)), 6) as survival from r where d > 0 and d < at_risk""")
def _(t):
    s = outcomes(t).join(patients(t), "pid").select((F.col("last") - 9131).alias("tte"), "event")
    return X.kaplan_meier(s, "tte", "event").where("d < at_risk").select("tte", "at_risk", "d", S.r6(F.col("survival")).alias("survival"))


@query("ml_16_time_to_event", f"with {OUT} select pat.pid, round(case when least(last, 11000) - 9131 = 0 then 1e-9 else (least(last, 11000) - 9131) / 365.25::double / 10 end, 6) as tte, sex = 'M' as male from outc join pat on outc.pid = pat.pid")
def _(t):
    d = F.least(F.col("last"), F.lit(11000)) - 9131
    return outcomes(t).join(patients(t), "pid").select("pid", S.r6(F.when(d == 0, 1e-9).otherwise(d / F.lit(365.25) / 10)).alias("tte"), (F.col("sex") == "M").alias("male"))


@query("pip_07_missed", f"with {EPI}, x as (select pid, min(case when code = '1' then start_day end) as t_text, min(case when code = '2' then start_day end) as t_code from epi group by 1) select pid, coalesce(t_text < t_code, false) or (t_text is not null and t_code is null) as missed from x")
def _(t):
    x = episodes(t).groupBy("pid").agg(R.first_when(F.col("code") == "1", "start_day").alias("t_text"), R.first_when(F.col("code") == "2", "start_day").alias("t_code"))
    return x.select("pid", (F.coalesce(F.col("t_text") < F.col("t_code"), F.lit(False)) | (F.col("t_text").isNotNull() & F.col("t_code").isNull())).alias("missed"))
