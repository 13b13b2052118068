"""Tables of reports: table one, correlations, corpus terms, best clusters, risk thresholds, outcomes by year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def table_one(df: DataFrame, group: str, numeric: Sequence[str], binary: Sequence[str], event: str, days: str) -> DataFrame:
    """For each group: rows, median and quartiles of numeric columns, count and percentage of binary ones, events for 1000 person-years."""
    out = [F.count("*").alias("n")]
    for c in numeric:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out += [F.get(q, F.lit(i)).alias(f"{c}_{name}") for i, name in enumerate(("q1", "median", "q3"))]
    for c in binary:
        n = F.count_if(F.col(c))
        out += [n.alias(f"{c}_n"), (n * 100.0 / F.count("*")).alias(f"{c}_percent")]
    out.append(F.try_divide(F.count_if(F.col(event)) * 1000.0, F.sum(days) / F.lit(config.YEAR_DAYS)).alias("rate"))
    return df.groupBy(group).agg(*out)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, itself included: Pearson's r of all pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")
    return long.union(long.where("a <> b").select("b", "a", "r"))


def corpus_terms(docs: DataFrame, doc: str, tokens: Column, rare: float = 0.25, common: float = 0.99) -> DataFrame:
    """(word, n, kind) of words at or below the ``rare`` quantile of counts, or at or above the ``common`` one."""
    counts = docs.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    q = counts.agg(F.percentile("n", F.array(F.lit(rare), F.lit(common))).alias("q"))
    lo, hi = q.first().q if not counts.isEmpty() else (0, 0)
    return counts.where((F.col("n") <= lo) | (F.col("n") >= hi)).withColumn("kind", F.when(F.col("n") >= hi, "common").otherwise("rare"))


def document_lengths(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: documents, mean, deviation, median and quartiles of their lengths in tokens."""
    n = F.size(tokens)
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return docs.select(n.alias("n")).agg(F.count("*").alias("documents"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), *(F.get(q, F.lit(i)).alias(x) for i, x in enumerate(("q1", "median", "q3"))))


def best_clusters(shares: DataFrame, cluster: str, metrics: Sequence[str]) -> DataFrame:
    """(metric, cluster and all metrics) of the cluster that leads each metric; ties are kept.  shares has a row a cluster."""
    top = shares.agg(*(F.max(m).alias(m) for m in metrics)).first()
    leads = F.filter(F.array(*(F.when(F.col(m) == F.lit(top[m]), F.lit(m)) for m in metrics)), lambda x: x.isNotNull())
    return shares.select(F.explode(leads).alias("metric"), cluster, *metrics)


def above_thresholds(df: DataFrame, risk: str, event: str, years: str, thresholds: Sequence[float], within: float = 2.0) -> DataFrame:
    """For each threshold: rows at or above it, their share, events among them, events within some years, and prevalence; one pass."""
    all_ = F.count("*")
    out = []
    for t in thresholds:
        hit = F.col(risk) >= t
        n = F.count_if(hit)
        out.append(F.struct(F.lit(float(t)).alias("threshold"), n.alias("n"), (n / all_).alias("share"), F.count_if(hit & F.col(event)).alias("events"), F.count_if(hit & F.col(event) & (F.col(years) <= within)).alias("within"), F.try_divide(F.count_if(hit & F.col(event)), n).alias("prevalence")))
    return df.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def outcomes_by_year(df: DataFrame, years: str, event: str, last: int) -> DataFrame:
    """(year, at_risk, events) of each whole year of follow-up up to ``last``."""
    rows = [F.struct(F.lit(y).alias("year"), F.count_if(F.col(years) >= y).alias("at_risk"), F.count_if(F.col(event) & (F.floor(years) == y)).alias("events")) for y in range(last + 1)]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def low_contrast(df: DataFrame, cols: Sequence[str], label: str, least: int = 50, nonzero: bool = True) -> list[str]:
    """Columns without more than ``least`` rows of each label; ``nonzero`` counts rows in which the column is neither null nor 0, else all rows (then all columns fall or none)."""
    use = lambda c, y: F.count_if((F.col(label) == y) & (F.col(c) != 0 if nonzero else F.lit(True))).alias(f"{c}_{y}")
    row = df.agg(*(use(c, y) for c in cols for y in (0, 1))).first()
    return [c for c in cols if min(row[f"{c}_0"], row[f"{c}_1"]) <= least]


def latest_events(df: DataFrame, patient: str, order: Sequence[str], n: int, cols: Sequence[str]) -> DataFrame:
    """(patient, events): the ``n`` latest events of each patient, latest first; no patient's whole history meets in a task but what partial aggregates keep of it."""
    w = Window.partitionBy(patient).orderBy(*(F.desc(c) for c in order))
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy(patient).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.struct(*cols).alias("e")))), lambda x: x["e"]).alias("events"))


def closest_to_topic(scores: DataFrame, patient: str, score: str, n: int = 10) -> DataFrame:
    """The patients with the highest best score of a topic: a distributed top-k."""
    best = scores.groupBy(patient).agg(F.max(score).alias(score))
    return best.orderBy(F.desc(score), patient).limit(n)
