"""Registered queries of report tables, lookup files, stored tables, and model selection."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import frames as R
from ..operators import reports as W
from ..operators import selection as L
from ..operators import survival
from ..sources import readers, sheets
from .q_text import _model_frame
from .registry import query
from .standins import EPI, OUT, episodes, outcomes, patients

_AGE = "age_days"


@query(
    "agg_25_table_one",
    f"""with {OUT} select sex, count(*) as n, round(quantile_cont(age_days, 0.25), 4) as q1, round(quantile_cont(age_days, 0.5), 4) as median, round(quantile_cont(age_days, 0.75), 4) as q3,
 sum(event::int)::bigint as event_n, round(sum(event::int) * 100.0::double / count(*), 4) as event_percent, round(sum(event::int) * 1000.0::double / (sum(last - 9131) / 365.2422::double), 6) as rate from outc join pat on outc.pid = pat.pid group by 1""",
)
def _(t):
    rows = outcomes(t).join(patients(t), "pid").withColumn("days", F.col("last") - 9131)
    one = W.table_one(rows, "sex", [_AGE], ["event"], "event", "days")
    r4 = lambda c: F.round(F.col(c).cast("double"), 4)
    return one.select("sex", "n", *(r4(f"{_AGE}_{x}").alias(x) for x in ("q1", "median", "q3")), "event_n", r4("event_percent").alias("event_percent"), S.r6(F.col("rate")).alias("rate"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg_31_correlation_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for a in _COLS for b in _COLS))
def _(t):
    return W.correlations(t.lineitem, _COLS).withColumn("r", S.r6(F.col("r")))


_TOK = "regexp_extract_all(lower(text), '[a-z]+')"


@query("agg_30_term_lists", f"with c as (select word, count(*) as n from (select unnest({_TOK}) as word from documents) group by 1), q as (select quantile_cont(n, 0.25) as lo, quantile_cont(n, 0.99) as hi from c) select word, n, case when n >= hi then 'common' else 'rare' end as kind from c, q where n <= lo or n >= hi")
def _(t):
    return W.corpus_terms(t.documents, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))


@query("agg_30_document_lengths", f"with c as (select len({_TOK}) as n from documents) select count(*) as documents, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as sd, quantile_cont(n, 0.25)::double as q1, quantile_cont(n, 0.5)::double as median, quantile_cont(n, 0.75)::double as q3 from c")
def _(t):
    n = W.document_lengths(t.documents, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return n.select("documents", S.r6(F.col("mean")).alias("mean"), S.r6(F.col("sd")).alias("sd"), "q1", "median", "q3")


_SHARES = f"""{OUT}, p as (select epi.code, event from epi join pat on epi.pid = pat.pid), g as (select code, count(*) as n, sum(event::int)::bigint as n_pos from p group by 1),
 s as (select code, round(n_pos::double / n, 9) as incidence, round(n::double / sum(n) over (), 9) as mass, n_pos from g)"""


@query("agg_36_best_per_metric", f"with {_SHARES}" + " union all ".join(f" select '{m}' as metric, code, incidence, mass, n_pos from s where {m} = (select max({m}) from s)" for m in ("incidence", "mass", "n_pos")))
def _(t):
    p = episodes(t).join(patients(t).select("pid", "event"), "pid")
    s = R.cluster_shares(p, "code", "event").select("code", F.round("incidence", 9).alias("incidence"), F.round("mass", 9).alias("mass"), "n_pos")
    return W.best_clusters(s, "code", ["incidence", "mass", "n_pos"])


_RISK = f"with {OUT}, r as (select (age_days % 1000) / 1000.0::double as risk, event, (last - 9131) / 365.25::double as years from outc join pat on outc.pid = pat.pid)"


def _risk(t):
    return outcomes(t).join(patients(t), "pid").select((F.col("age_days") % 1000 / 1000.0).alias("risk"), "event", ((F.col("last") - 9131) / F.lit(365.25)).alias("years"))


@query("agg_41_risk_thresholds", _RISK + " union all ".join(f" select {x}::double as threshold, count(*) filter (where risk >= {x}) as n, round(count(*) filter (where risk >= {x}) / count(*)::double, 6) as share, count(*) filter (where risk >= {x} and event) as events, count(*) filter (where risk >= {x} and event and years <= 5) as within, round(count(*) filter (where risk >= {x} and event) / count(*) filter (where risk >= {x})::double, 6) as prevalence from r" for x in (0.25, 0.5, 0.75)))
def _(t):
    return W.above_thresholds(_risk(t), "risk", "event", "years", [0.25, 0.5, 0.75], 5).withColumns({c: S.r6(F.col(c)) for c in ("share", "prevalence")})


@query("agg_41_outcomes_by_year", _RISK + " select y::int as year, count(*) filter (where years >= y) as at_risk, count(*) filter (where event and floor(years) = y) as events from r, range(0, 6) k(y) group by 1")
def _(t):
    return W.outcomes_by_year(_risk(t), "years", "event", 5)


@query("prj_06_low_contrast_columns", "with x as (select (l_returnflag = 'R')::int as y, (l_linenumber = 7)::int as seven, (l_orderkey < 20)::int as few, l_quantity from lineitem) select 'seven' as col from x having least(count(*) filter (where y = 1 and seven <> 0), count(*) filter (where y = 0 and seven <> 0)) <= 50 union all select 'few' from x having least(count(*) filter (where y = 1 and few <> 0), count(*) filter (where y = 0 and few <> 0)) <= 50 union all select 'l_quantity' from x having least(count(*) filter (where y = 1 and l_quantity <> 0), count(*) filter (where y = 0 and l_quantity <> 0)) <= 50")
def _(t):
    x = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linenumber") == 7).cast("int").alias("seven"), (F.col("l_orderkey") < 20).cast("int").alias("few"), "l_quantity")
    return t.spark.createDataFrame([(c,) for c in W.low_contrast(x, ["seven", "few", "l_quantity"], "y")], "col string")


@query("win_03_latest_events", f"with {EPI}, r as (select *, row_number() over (partition by pid order by start_day desc, episode_id desc) as r from epi) select pid, count(*) as n, max(case when r = 1 then code end) as last_code, max(case when r = 3 then episode_id end) as third from r where r <= 3 group by 1")
def _(t):
    e = W.latest_events(episodes(t), "pid", ["start_day", "episode_id"], 3, ["episode_id", "code"])
    return e.select("pid", F.size("events").cast("long").alias("n"), F.get("events", F.lit(0))["code"].alias("last_code"), F.get("events", F.lit(2))["episode_id"].alias("third"))


@query("srt_04_closest_patients", "select vec_id % 20 as pid, round(max(embedding[1]::double), 6) as score from embeddings group by 1 order by max(embedding[1]) desc, 1 limit 10")
def _(t):
    s = t.embeddings.select((F.col("vec_id") % 20).alias("pid"), F.get("embedding", F.lit(0)).cast("double").alias("score"))
    return W.closest_to_topic(s, "pid", "score").withColumn("score", S.r6(F.col("score")))


@query("src_11_json_files", f"with {EPI} select episode_id, coalesce(case code when '1' then 'cats0_urgent' when '2' then 'cats1_high' when '3' then 'cats1_normal' end, 'UNDEFINED_' || code) as category from epi")
def _(t):
    """Two JSON files of code categories, written and read back; the later one wins."""
    paths = []
    for m in ({"1": "urgent", "2": "urgent"}, {"2": "high", "3": "normal"}):
        paths.append(readers.scratch(t.spark, "json"))
        t.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.text(paths[-1])
    return R.roll_up(episodes(t), "code", readers.read_code_maps(t.spark, paths)).select("episode_id", "category")


@query("src_12_sheet", "select n_nationkey::varchar as n_nationkey, n_name from nation")
def _(t):
    """A lookup written as one sheet of a workbook and read back."""
    path = readers.scratch(t.spark, "xlsx")
    sheets.write_report(t.spark, path, {"nations": (t.nation.select("n_nationkey", "n_name"), ["n_nationkey"]), "regions": (t.region, ["r_regionkey"])})
    return sheets.read_sheet(t.spark, path, "nations")


@query("snk_04_report", f"with {EPI}, c as (select status, count(*) as n, round(avg(price), 2) as mean from epi group by 1) select status, n::varchar as n, mean from c")
def _(t):
    """A report of two sheets, the first sorted by falling count, read back."""
    path = readers.scratch(t.spark, "xlsx")
    per = episodes(t).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("price"), 2).alias("mean"))
    sheets.write_report(t.spark, path, {"by_status": (per, [F.desc("n"), "status"]), "patients": (patients(t).limit(5), ["pid"])})
    return sheets.read_sheet(t.spark, path, 0).withColumn("mean", F.col("mean").cast("double"))


@query("snk_04_workbooks", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def _(t):
    """All orders as workbooks in the order of their keys, read back with their kinds."""
    folder = readers.scratch(t.spark, "books")
    sheets.write_workbooks(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), folder, ["o_orderkey"], most=5000)
    return sheets.read_workbooks(t.spark, folder, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query("src_13_stored_tables", "select true as there, true as deleted, false as after, false as again")
def _(t):
    path = readers.stored("regions", readers.scratch(t.spark, "tables"), subsample=True)
    t.region.write.parquet(path)
    there = readers.table_exists(t.spark, path)
    deleted = readers.delete_table(t.spark, path)
    return t.spark.createDataFrame([(there, deleted, readers.table_exists(t.spark, path), readers.delete_table(t.spark, path))], "there boolean, deleted boolean, after boolean, again boolean")


@query("src_14_cached_stage", "select n_regionkey, count(*) as n from nation group by 1")
def _(t):
    """A stage made once: the second call must not make it again, a forced one must."""
    calls = []

    def make():
        calls.append(1)
        return t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))

    name = readers.scratch(t.spark, "stage").rsplit("/", 1)[-1]
    readers.cached_table(t.spark, name, make)
    readers.cached_table(t.spark, name, make)
    out = readers.cached_table(t.spark, name, make, override=True)
    if len(calls) != 2:
        raise AssertionError(f"made {len(calls)} times")
    return out


@query("fil_19_shadowed_columns", "with n as (select distinct event_type as c, user_id % 2 = 0 as twice from events) select c as col from n where twice union select 't_' || c from n where c not in (select c from n where twice)")
def _(t):
    """A flag goes where the plain name, here of the kinds of events that even users have, is there too."""
    rows = t.events.select("event_type", (F.col("user_id") % 2 == 0).alias("both")).distinct().collect()
    return t.spark.createDataFrame([(c,) for c in R.drop_shadowed(sorted({f"t_{r.event_type}" for r in rows} | {r.event_type for r in rows if r.both}))], "col string")


@query("ml_01_mixture_grid")
def _(t):
    df = t.lineitem.select((F.col("l_quantity") / 50.0).alias("q"), (F.col("l_returnflag") == "R").cast("double").alias("r"))
    return t.spark.createDataFrame([(r["k"], r["aic"], r["bic"]) for r in L.mixture_grid(df, ["q"], ["r"], [3, 4, 5], iterations=10)], "k int, aic double, bic double")


@query("ml_02_class_weights", "select event, round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as w from (select c_custkey % 5 = 0 as event from customer) group by 1")
def _(t):
    return t.spark.createDataFrame([(k, round(w, 6)) for k, w in L.class_weights(patients(t), "event").items()], "event boolean, w double")


@query("ml_11_stepwise_by_p")
def _(t):
    s = L.stepwise_by_p(_model_frame(t), ["q", "l_discount", "l_tax"], "y", guard="adjr2")
    return t.spark.createDataFrame([(i, ",".join(c), f["adjr2"], f["aic"]) for i, (c, f) in enumerate(s)], "round int, columns string, adjr2 double, aic double")


@query("ml_12_backward_with_auc")
def _(t):
    s = L.backward_logistic(_model_frame(t), ["q", "l_discount", "l_tax"], "y", "fold")
    return t.spark.createDataFrame([(i, ",".join(r["columns"]), r["aic"], r["auc_mean"], r["auc_sd"]) for i, r in enumerate(s)], "round int, columns string, aic double, auc_mean double, auc_sd double")


@query("scl_08_singular_scores")
def _(t):
    rows = t.lineitem.withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    scores, _ = L.singular_scores(rows, "id", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)
    return scores


@query("agg_13_by_prefix", "select event_type, round(avg(value), 6) as m_value, round(max(value), 6) as mx_value, count(value)::double as n_value, round(sum(value), 4) as value from events group by 1")
def _(t):
    a = t.events.groupBy("event_type").agg(*R.aggregates({"m_value": "value", "mx_value": "value", "n_value": "value", "value": "value"}))
    return a.select("event_type", S.r6(F.col("m_value")).alias("m_value"), S.r6(F.col("mx_value")).alias("mx_value"), F.col("n_value").cast("double").alias("n_value"), F.round("value", 4).alias("value"))


@query("win_06_captured_share", f"""with {_SHARES}, r as (select incidence, mass, sum(mass) over w as m, sum(incidence * mass) over w as p, (select sum(incidence * mass) / sum(mass) from s) as base from s window w as (order by incidence desc, mass desc)),
 f as (select *, bool_and(p / m >= base * 1.02) over (order by incidence desc, mass desc) as ok from r) select count(*) filter (where ok)::int as taken, round(coalesce(max(p) filter (where ok), 0) / max(base), 6) as share from f""")
def _(t):
    """Clusters by falling incidence while they stay above a ratio of the base, and the share of all positives they hold."""
    p = episodes(t).join(patients(t).select("pid", "event"), "pid")
    rows = R.cluster_shares(p, "code", "event").select(F.round("incidence", 9), F.round("mass", 9)).collect()
    taken, share = L.captured_share([tuple(r) for r in rows], 1.02)
    return t.spark.createDataFrame([(taken, round(share, 6))], "taken int, share double")


@query("smp_01_with_replacement")
def _(t):
    return R.sampled(t.orders.select("o_orderkey"), 100, "o_orderkey", replacement=True)


@query("ml_15_cox")
def _(t):
    """Proportional hazards of age and sex on the time to the last episode."""
    rows = outcomes(t).join(patients(t), "pid").select((F.col("last") - 9131).alias("time"), "event", (F.col("age_days") / 3652.5).alias("decades"), (F.col("sex") == "M").cast("int").alias("male"))
    m = L.cox(rows, ["decades", "male"], "time", "event")
    return t.spark.createDataFrame([(k, v, e) for (k, v), e in zip(m["coefficients"].items(), m["errors"], strict=True)], "name string, coefficient double, error double")


_LIVES = "select (c_custkey * 37) % 365 + 1 as t, c_custkey % 3 = 0 as e, round(c_acctbal) as s from customer"


def _lives(t):
    return t.customer.select(((F.col("c_custkey") * 37) % 365 + 1).alias("t"), (F.col("c_custkey") % 3 == 0).alias("e"), F.round("c_acctbal").alias("s"), (F.col("c_nationkey") / 25).alias("nation"), ((F.col("c_custkey") * 7) % 11).alias("k"))


@query(
    "ml_15_concordance",
    f"""with p as ({_LIVES}), v as (select a.s as x, b.s as y from p a join p b on b.t > a.t or (b.t = a.t and not b.e) where a.e)
 select count(*) filter (where x > y)::bigint as concordant, count(*) filter (where x < y)::bigint as discordant, count(*) filter (where x = y)::bigint as tied,
 round((count(*) filter (where x > y) + count(*) filter (where x = y) / 2.0::double) / count(*), 6) as concordance from v""",
)
def _(t):
    """Pairs of customers in the order that their balances foretell, counted by ranges."""
    c = survival.concordance(_lives(t), "t", "e", "s")
    return t.spark.createDataFrame([(*(int(c[k]) for k in ("concordant", "discordant", "tied")), round(c["concordance"], 6))], "concordant long, discordant long, tied long, concordance double")


@query("ml_15_penalised_cox")
def _(t):
    """Proportional hazards of all customers with an absolute penalty; tested by the conditions of an optimum."""
    m = survival.penalised_cox(_lives(t).withColumn("e", F.col("e").cast("int")), ["s", "nation", "k"], "t", "e", penalty=0.005)
    return t.spark.createDataFrame(list(m["coefficients"].items()), "name string, coefficient double")
