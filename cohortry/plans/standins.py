"""Cohort tables made from the generated star schema, and the same as SQL for the oracle.

customer plays the patient (nation the practice), orders the episode, lineitem the consult
and the prescription, part the code dictionary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import days, key
from .registry import Tables


def patients(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(
        F.col("c_custkey").alias("person_id"),
        F.col("c_nationkey").cast("long").alias("practice_id"),
        key("c_custkey", "c_nationkey").alias("pid"),
        (14600 - (F.col("c_custkey") * 37) % 25000).alias("age_days"),
        F.element_at(F.array(*map(F.lit, "MVNO")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("sex"),
        (F.col("c_custkey") % 5 == 0).alias("event"),
    )


def episodes(t: Tables) -> DataFrame:
    """Open orders have no end; others end with their last shipment."""
    ends = t.lineitem.groupBy("l_orderkey").agg(F.max(days("l_shipdate")).alias("last_ship"))
    p = patients(t).select("person_id", "pid")
    o = t.orders.join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(p, F.col("o_custkey") == F.col("person_id"))
    return o.select(
        F.col("o_orderkey").alias("episode_id"),
        "pid",
        days("o_orderdate").alias("start_day"),
        F.when(F.col("o_orderstatus") != "O", F.col("last_ship")).alias("end_day"),
        F.substring("o_orderpriority", 1, 1).alias("code"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )


def journals(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey")
    p = patients(t).select("person_id", "pid")
    j = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("o_custkey") == F.col("person_id"))
    return j.select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("line"), "pid", days("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


def outcomes(t: Tables) -> DataFrame:
    """Last day of follow-up of each patient with an episode."""
    return episodes(t).groupBy("pid").agg(F.max("start_day").alias("last"))


def sql_day(x: str) -> str:
    return f"date_diff('day', date '1970-01-01', cast({x} as date))"


PAT = """pat as (select c_custkey as person_id, cast(c_nationkey as bigint) as practice_id, c_custkey || '|' || c_nationkey as pid,
 14600 - (c_custkey * 37) % 25000 as age_days, substr('MVNO', cast(c_custkey % 4 + 1 as int), 1) as sex, c_custkey % 5 = 0 as event from customer)"""
EPI = f"""{PAT}, epi as (select o_orderkey as episode_id, pid, {sql_day("o_orderdate")} as start_day,
 case when o_orderstatus <> 'O' then last_ship end as end_day, substr(o_orderpriority, 1, 1) as code, o_orderstatus as status, o_totalprice as price
 from orders join pat on o_custkey = person_id left join (select l_orderkey, max({sql_day("l_shipdate")}) as last_ship from lineitem group by 1) on o_orderkey = l_orderkey)"""
JRN = f"""{EPI}, jrn as (select l_orderkey as episode_id, l_linenumber as line, pid, {sql_day("l_shipdate")} as day, l_returnflag as flag,
 l_partkey as partkey, l_suppkey as suppkey, l_quantity as quantity, l_extendedprice as price
 from lineitem join orders on l_orderkey = o_orderkey join pat on o_custkey = person_id)"""
OUT = f"""{JRN}, outc as (select pid, max(start_day) as last from epi group by 1)"""
