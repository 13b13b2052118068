"""Cohort operators: keyed deduplication, band filters, outcomes, censoring, nesting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; give an order without ties.  One shuffle on the keys; only one row of a key is kept while sorting."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_ids(df: DataFrame, ids: DataFrame, on: str, negate: bool = False) -> DataFrame:
    """Membership filter: a semi (or anti) join, whatever the length of the list."""
    return df.join(ids, on, "left_anti" if negate else "left_semi")


def valid_interval(start: str, end: str) -> Column:
    """A missing end counts as infinitely late."""
    return F.col(end).isNull() | (F.col(start) <= F.col(end))


def old_enough(last: Column, age_days: Column, years: float = config.MIN_AGE_YEARS) -> Column:
    return last + age_days > years * config.YEAR_DAYS


def in_band(day: Column, last: Column, width: int = config.FOLLOW_UP_DAYS) -> Column:
    return (day <= last) & (last - day <= width)


def in_follow_up(day: Column, last: Column, start_day: int) -> Column:
    """Two years (of 365.2422 days) before the end, within the cohort."""
    return (day >= start_day) & (day <= last) & (day.cast("double") >= last - 2 * config.YEAR_DAYS)


def effective_end(event: Column, last: Column) -> Column:
    return F.when(event, last - config.CENSOR_DAYS).otherwise(last)


def not_censored(day: Column, t_event: Column) -> Column:
    """Rows of patients with an event count only up to the censor window before it."""
    return t_event.isNull() | (day + config.CENSOR_DAYS < t_event)


def latest_band(events: DataFrame, outcome: DataFrame, on: str, day: str, last: str = "last", width: int = config.FOLLOW_UP_DAYS) -> DataFrame:
    """Events joined to their patient's outcome and cut to the follow-up band."""
    return events.join(outcome, on).where(in_band(F.col(day), F.col(last), width))


def nest(parents: DataFrame, children: DataFrame, on: str, into: str, order: Sequence[str], descending: bool = False) -> DataFrame:
    """Children as a sorted array of structs under their parent; an empty array where there are none.

    ``order`` names the leading struct fields, so the array's own order is the wanted one.
    """
    fields = [*order, *(c for c in children.columns if c != on and c not in order)]
    lists = children.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(*fields)), not descending).alias(into))
    kind = lists.schema[into].dataType.simpleString()
    return parents.join(lists, on, "left").withColumn(into, F.coalesce(into, F.array().cast(kind)))


def assemble_outcome(adjudicated: DataFrame, episodes: DataFrame, patients: DataFrame) -> DataFrame:
    """(pid, last, positive): confirmed patients end at their first episode, others at their last, patients without any at none.

    ``adjudicated`` has pid and confirmed (one definition: the rejecting mark is missing).
    """
    side = adjudicated.groupBy("pid").agg(F.max("confirmed").alias("confirmed"))
    bounds = episodes.groupBy("pid").agg(F.min("start_day").alias("first_day"), F.max("start_day").alias("last_day"))
    rows = patients.select("pid").join(bounds, "pid", "left").join(side, "pid", "left")
    yes = F.coalesce("confirmed", F.lit(False))
    return rows.select("pid", F.when(yes, F.col("first_day")).otherwise(F.col("last_day")).alias("last"), yes.alias("positive"))


def merge_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of two sources that must not share keys."""
    if not a.select(key).intersect(b.select(key)).isEmpty():
        raise ValueError(f"the sources share values of {key}")
    return a.unionByName(b, allowMissingColumns=True)


def match_dates(cases: DataFrame, controls: DataFrame, strata: Sequence[str], *, day: str = "day", within: int = 90, seed: int = 42) -> DataFrame:
    """For each control a date of its own (pid, day) nearest to a sampled case's start date of its stratum, within so many days.

    Cases are drawn for a control by a hash of its pid; band join by buckets of ``within``
    days, so candidates meet by stratum and neighbouring bucket, never all with all.
    """
    c = cases.select(*strata, F.col(day).alias("case_day")).distinct().withColumn("b", F.floor(F.col("case_day") / within))
    near = controls.withColumn("b", F.explode(F.array(*(F.floor(F.col(day) / within) + d for d in (-1, 0, 1)))))
    hit = near.join(c, [*strata, "b"]).where(F.abs(F.col(day) - F.col("case_day")) <= within)
    w = Window.partitionBy("pid").orderBy(F.xxhash64(F.lit(seed), "pid", "case_day"), F.abs(F.col(day) - F.col("case_day")), day)
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("pid", *strata, day, "case_day")


def match_draws(cases: DataFrame, controls: DataFrame, strata: Sequence[str], *, day: str = "day", within: int = 90, draws: int = 50, least_events: int = 2, least_days: int = 180, seed: int = 42) -> DataFrame:
    """(pid, strata, drawn, day) of each control that a drawn date fits: the first of ``draws`` case dates of its stratum, drawn with replacement, that has an event of the control within so many days.

    From the earliest such event on, the control must have ``least_events`` events and
    ``least_days`` days of them.  Draws come from a hash of the pid, so reruns agree; controls
    that no draw fits are left out.  A stratum's dates, with how often each occurs, are at
    most a row a day: these go to the tasks; a control's own days are one row.
    """
    table: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    per = cases.where(F.col(day).isNotNull()).groupBy(*strata, day).agg(F.count("*").alias("n")).collect()  # strata x days
    for k in {tuple(r[s] for s in strata) for r in per}:
        own = sorted((r[day], r["n"]) for r in per if tuple(r[s] for s in strata) == k)
        table[k] = np.array([d for d, _ in own], np.int64), np.cumsum([n for _, n in own])
    nested = controls.where(F.col(day).isNotNull()).groupBy("pid", *strata).agg(F.sort_array(F.collect_list(F.col(day).cast("long"))).alias("days"), F.xxhash64(F.lit(seed), "pid").alias("h"))

    def run(frames):
        for f in frames:
            out = []
            for i, (h, days, *k) in enumerate(zip(f["h"], f["days"], *(f[s] for s in strata), strict=True)):
                if tuple(k) not in table:
                    continue
                dates, upto = table[tuple(k)]
                days = np.asarray(days)
                u = np.random.default_rng(h & (2**63 - 1)).integers(0, upto[-1], draws)
                drawn = dates[np.searchsorted(upto, u, side="right")]
                first = np.searchsorted(days, drawn - within)
                ok = first < len(days)
                at = np.minimum(first, len(days) - 1)
                ok &= (np.abs(days[at] - drawn) <= within) & (len(days) - first >= least_events) & (days[-1] - days[at] >= least_days)
                if ok.any():
                    j = int(ok.argmax())
                    out.append((i, int(drawn[j]), int(days[at[j]])))
            got = f.iloc[[o[0] for o in out]][["pid", *strata]].copy()
            got["drawn"], got["day"] = [o[1] for o in out], [o[2] for o in out]
            yield got

    kinds = ", ".join(f"`{c}` {nested.schema[c].dataType.simpleString()}" for c in ("pid", *strata))
    return nested.mapInPandas(run, f"{kinds}, drawn long, day long")
