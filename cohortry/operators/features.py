"""Feature formulas of time-weighted events, acceleration and risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rebase, time_weight


def windowed(events: DataFrame, outcome: DataFrame, day: str, on: str = "pid") -> DataFrame:
    """Events in the feature window with t (0 to 730) and weight w."""
    e = events.join(outcome.select(on, "last"), on).withColumn("t", rebase(F.col(day), F.col("last")))
    return e.where("t is not null and t >= 0").withColumn("w", time_weight(F.col("t")))


def windowed_by_own(events: DataFrame, day: str, on: str = "pid") -> DataFrame:
    """``windowed`` where a patient's last day is that of their own events: a window over the patient, so the events are made and dealt once."""
    e = events.withColumn("last", F.max(day).over(Window.partitionBy(on))).withColumn("t", rebase(F.col(day), F.col("last")))
    return e.where("t is not null and t >= 0").withColumn("w", time_weight(F.col("t")))


def code_means(events: DataFrame, code: str, codes: Sequence[str], prefix: str, on: str = "pid") -> DataFrame:
    """Weight of each code over all the patient's rows, not only those with the code.  Weights have four decimals, so they are summed as whole ten-thousandths: no order of summing shows."""
    n = F.count("*") * 10_000
    whole = F.round(F.col("w") * 10_000).cast("long")
    return events.groupBy(on).agg(*((F.sum(F.when(F.col(code) == c, whole).otherwise(0)) / n).alias(f"{prefix}{c}") for c in codes))


def acceleration(events: DataFrame, on: str = "pid", t: str = "t") -> DataFrame:
    """Contact acceleration of each patient; fewer than three events, or all on one day: 0.

    Events of a day form a group; with u the running count over time, every later group adds
    2000 u / dt weighted by its share of the elapsed time and by the weight of its day.
    Windows over a patient's own days only.
    """
    g = events.groupBy(on, t).agg(F.count("*").alias("c"))
    w = Window.partitionBy(on).orderBy(t)
    g = g.withColumn("S", F.sum("c").over(w)).withColumn("dt", F.col(t) - F.lag(t).over(w)).withColumn("total", F.sum("c").over(Window.partitionBy(on)))
    a = F.lit(2000.0) * (F.col("S") / F.col(t)) / F.col("dt")
    part = F.when(F.col("dt").isNotNull() & (F.col(t) > 0), time_weight(F.col(t)) * a * F.col("dt"))
    s = g.withColumn("part", part).groupBy(on).agg(F.sum("part").alias("s"), F.sum("dt").alias("d"), F.max("total").alias("n"))
    return s.select(on, F.when((F.col("n") >= 3) & (F.col("d") > 0), F.coalesce("s", F.lit(0.0)) / F.col("d")).otherwise(0.0).alias("acceleration"))


def risk_score(coefficients: Mapping[str, float], means: Mapping[str, float]) -> Column:
    """Partial hazard: exp of the coefficients times the distance from the mean, matched by name."""
    total = F.lit(0.0)
    for k, b in coefficients.items():
        total = total + F.lit(float(b)) * (F.col(k).cast("double") - F.lit(float(means[k])))
    return F.exp(total)


def kaplan_meier(df: DataFrame, time: str, event: str) -> DataFrame:
    """Product-limit survival at each event time; the window runs over distinct times."""
    g = df.groupBy(time).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("d"))
    w = Window.orderBy(F.col(time).desc())
    g = g.withColumn("at_risk", F.sum("n").over(w))
    up = Window.orderBy(time)
    keep = g.where("d > 0").withColumn("log_s", F.sum(F.log1p(-F.col("d") / F.col("at_risk"))).over(up))
    return keep.select(time, "at_risk", "d", F.exp("log_s").alias("survival"))
