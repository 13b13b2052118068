"""General frame operators: aggregates, reshaping, scaling, sets, statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of a column's values, null among them."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def latest(value: str | Column, *order: str) -> Column:
    """Value of the latest row; nulls are passed over."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.when(v.isNotNull(), F.struct(*order, v.alias("v"))))


def first_when(flag: Column, day: str) -> Column:
    """First day on which a condition holds."""
    return F.min(F.when(flag, F.col(day)))


def pivot_codes(df: DataFrame, row: str, code: str, codes: Sequence[str], value: Column, prefix: str = "", fill: float | None = 0.0) -> DataFrame:
    """One column for each code, in one aggregation: no pivot job, no list of values to be found first."""
    out = df.groupBy(row).agg(*(F.sum(F.when(F.col(code) == c, value)).alias(f"{prefix}{c}") for c in codes))
    return out if fill is None else out.fillna(fill, [f"{prefix}{c}" for c in codes])


def frequent_codes(df: DataFrame, col: str, least: int = config.MIN_CODE_COUNT) -> DataFrame:
    """Codes of more than ``least`` rows, numbered in code order from 0."""
    n = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).where(F.col("n") > least)
    return n.withColumn("idx", F.row_number().over(Window.orderBy(col)) - 1)


def roll_up(df: DataFrame, code: str, lookup: DataFrame) -> DataFrame:
    """Category of each code; codes without one fall to ``UNDEFINED_<code>``.  lookup: (code, category), broadcast by Spark where it is small."""
    side = lookup.select(F.col("code").alias("_c"), "category")
    return df.join(side, F.col(code) == F.col("_c"), "left").withColumn("category", F.coalesce("category", F.concat(F.lit("UNDEFINED_"), code))).drop("_c")


def code_map(spark, maps: Sequence[Mapping[str, str]]) -> DataFrame:
    """Union of code to category maps, map i prefixed ``cats<i>_``; a later map overwrites a code's category."""
    rows = [(c, f"cats{i}_{v}", i) for i, m in enumerate(maps) for c, v in m.items()]
    all_ = spark.createDataFrame(rows, "code string, category string, i int")
    return all_.groupBy("code").agg(F.max_by("category", "i").alias("category"))


def single_valued(df: DataFrame) -> list[str]:
    """Columns with one value (null counts as one), found in one pass."""
    row = df.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"), F.count("*").alias("all")).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if row[c].n == 0 or row[c].n == row[c].all and row[c].lo == row[c].hi]


def redundant_categories(columns: Sequence[str], skip: Sequence[str] = ("postcode", "_ctyp_")) -> list[str]:
    """The last numbered column of each one-hot family."""
    last: dict[str, tuple[int, str]] = {}
    for c in columns:
        m = re.fullmatch(r"(.*)_(\d+)", c)
        if m and not any(s in c for s in skip):
            last[m[1]] = max(last.get(m[1], (-1, "")), (int(m[2]), c))
    return sorted(c for _, c in last.values())


def select_names(columns: Sequence[str], pattern: str) -> list[str]:
    return [c for c in columns if re.search(pattern, c)]


# Helper columns by name, and the prefixes by which columns have their type.
HELPERS = r"(index|level|Unnamed)"
TYPE_PREFIXES = {"t_": "condition", "n_": "count", "p_": "share", "tw_": "weighted", "sum_": "sum", "mx_": "maximum", "m_": "mean"}


def drop_helpers(df: DataFrame, pattern: str = HELPERS) -> DataFrame:
    """Without the columns that only came along: saved row numbers and levels."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not re.search(pattern, c)))


def type_census(columns: Sequence[str], prefixes: Mapping[str, str] = TYPE_PREFIXES) -> dict[str, int]:
    """How many columns each type has by the longest prefix that fits the name after its period (``0_24_``); ``other`` for the rest."""
    out: dict[str, int] = {}
    for c in columns:
        name = re.sub(r"^\d+_\d+_", "", c)
        kind = next((prefixes[p] for p in sorted(prefixes, key=len, reverse=True) if name.startswith(p)), "other")
        out[kind] = out.get(kind, 0) + 1
    return out


def drop_shadowed(columns: Sequence[str], prefix: str = "t_") -> list[str]:
    """Without ``t_x`` where ``x`` itself is among the columns."""
    have = set(columns)
    return [c for c in columns if not (c.startswith(prefix) and c.removeprefix(prefix) in have)]


def frame_of(spark, nested: Mapping[str, Mapping[str, float]], key: str = "key") -> DataFrame:
    """A small dict of dicts as a frame: a row for each outer key, a column for each inner one (null where it has none)."""
    cols = sorted({c for v in nested.values() for c in v})
    return spark.createDataFrame([(k, *(None if v.get(c) is None else float(v[c]) for c in cols)) for k, v in nested.items()], f"{key} string, " + ", ".join(f"`{c}` double" for c in cols))


def transposed(df: DataFrame, key: str, rows: Sequence[str], name: str = "column") -> DataFrame:
    """Columns become rows and the named values of ``key`` columns: unpivot, then one aggregation."""
    value = [c for c in df.columns if c != key]
    long = df.unpivot([key], value, name, "_v")
    return long.groupBy(name).agg(*(F.max(F.when(F.col(key) == r, F.col("_v"))).alias(r) for r in rows))


def split_sparse(df: DataFrame, cols: Sequence[str], most: float = 0.5) -> tuple[list[str], list[str]]:
    """Dense and sparse columns: sparse where at most ``most`` of the rows are neither null nor 0.  One pass."""
    row = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c) != 0).alias(c) for c in cols)).first()
    sparse = [c for c in cols if row[c] <= most * max(1, row.n)]
    return [c for c in cols if c not in set(sparse)], sparse


def stacked(blocks: Sequence[Sequence[str]], out: str = "features"):
    """A transformer of column blocks, side by side, to one vector (sparse where that is shorter)."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[c for b in blocks for c in b], outputCol=out, handleInvalid="keep")


#: The aggregate that the beginning of a feature's name asks for; no such beginning: a sum.
BY_PREFIX = {"mx_": F.max, "m_": F.avg, "n_": F.count}


def aggregates(columns: Mapping[str, str]) -> list[Column]:
    """An aggregate for each {name: column}, chosen by the name after its period (``0_24_``); NaN counts as null."""
    out = []
    for name, c in columns.items():
        rest = re.sub(r"^\d+_\d+_", "", name)
        f = next((BY_PREFIX[p] for p in sorted(BY_PREFIX, key=len, reverse=True) if rest.startswith(p)), F.sum)
        out.append(f(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(name))
    return out


def sampled(df: DataFrame, n: int, key: str, replacement: bool = False, seed: int = 42) -> DataFrame:
    """About ``n`` rows, the same on every run: by a hash of the key below a threshold (exactly ``n`` then), or with replacement by Poisson counts drawn from that hash."""
    total = max(1, df.count())
    h = F.xxhash64(F.lit(seed), key)
    if not replacement:
        near = df.where(h.cast("double") / 2.0**64 + 0.5 <= min(1.0, (n + 10 * math.sqrt(n) + 10) / total))
        return near.orderBy(h, key).limit(n)
    u, rate = h.cast("double") / 2.0**64 + 0.5, n / total
    upto, p, times = 0.0, math.exp(-rate), F.lit(0)
    for k in range(int(rate + 12 * math.sqrt(rate) + 12)):
        upto += p
        times = times + (u > upto).cast("int")
        p *= rate / (k + 1)
    return df.withColumn("_n", F.explode(F.array_repeat(F.lit(0), times))).drop("_n")


def period_name(start: int, end: int) -> str:
    return f"{start // 30}_{end // 30}"


def max_abs(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """Columns divided by their largest absolute value (0 stays); and the multipliers."""
    row = df.agg(*(F.max(F.abs(c)).cast("double").alias(c) for c in cols)).first()
    by = {c: row[c] if row[c] else 1.0 for c in cols}
    return df.withColumns({c: F.col(c).cast("double") / by[c] for c in cols}), by


def quantiles(df: DataFrame, cols: Sequence[str], at: Sequence[float], narrow: int = 1_000_000) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between ranks) without one task that holds all values.

    A sketch gives bounds around each wanted rank; rows between them are counted, and bounds
    that still hold more than ``narrow`` rows are drawn closer by another sketch of these.
    Then only the distinct values between the bounds are sorted.  Null columns give None.
    """
    out: dict[str, list[float | None]] = {}
    for c in cols:
        x = df.select(F.col(c).cast("double").alias("x")).where("x is not null")
        n = x.count()
        out[c] = [None] * len(at)
        for k, p in enumerate(at if n else ()):
            rank = p * (n - 1)
            lo, hi, part, below, total = None, None, x, 0, n
            while total > narrow:
                share = (rank - below) / max(1, total - 1)
                low, high = part.stat.approxQuantile("x", [max(0.0, share - 0.002), min(1.0, share + 0.002)], 0.001)
                inside = part.agg(F.count_if(F.col("x") < low).alias("b"), F.count_if(F.col("x") <= high).alias("u")).first()
                if inside.u - inside.b >= total or not (below + inside.b <= math.floor(rank) and math.ceil(rank) < below + inside.u):
                    break  # one value holds most rows, or the sketch missed: sort what is left
                lo, hi = low, high
                part, below, total = part.where(F.col("x").between(low, high)), below + inside.b, inside.u - inside.b
            counts = part.groupBy("x").agg(F.count("*").alias("n"))
            upto = F.sum("n").over(Window.orderBy("x")) + F.lit(below)
            near = counts.withColumn("upto", upto).where(F.col("upto") > math.floor(rank)).orderBy("x").limit(2).collect()
            first = near[0].x
            second = first if near[0].upto > math.ceil(rank) else near[1].x
            out[c][k] = first + (second - first) * (rank - math.floor(rank))
    return out


def robust(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(x - median) / IQR with exact quantiles; where the IQR is 0 it counts as 1."""
    row = quantiles(df, cols, (0.25, 0.5, 0.75))
    by = {c: (row[c][1], (row[c][2] - row[c][0]) or 1.0) for c in cols if row[c][1] is not None}
    return df.withColumns({c: (F.col(c).cast("double") - by[c][0]) / by[c][1] for c in by}), by


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns brought to 0 to 1; a constant column becomes 0."""
    row = df.agg(*(F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in cols)).first()
    return df.withColumns({c: (F.col(c).cast("double") - row[c].lo) / ((row[c].hi - row[c].lo) or 1.0) for c in cols})


def lift_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """max(2 v - 1, 0) for columns whose least non-zero value exceeds 0.5 and whose largest is at most 1."""
    row = df.agg(*(F.struct(F.min(F.when(F.col(c) != 0, F.col(c))).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols)).first()
    hit = [c for c in cols if row[c].lo is not None and row[c].lo > 0.5 and row[c].hi <= 1]
    return df.withColumns({c: F.greatest(F.col(c) * 2.0 - 1.0, F.lit(0.0)) for c in hit})


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def set_operation(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Union, intersection, difference or symmetric difference of distinct rows."""
    if how == "union":
        return a.union(b).distinct()
    if how == "intersection":
        return a.intersect(b)
    if how == "difference":
        return a.subtract(b)
    return a.union(b).distinct().subtract(a.intersect(b))


def with_all(df: DataFrame, cluster: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of each cluster and, as ``ALL``, of all rows."""
    return df.rollup(cluster).agg(F.grouping(cluster).alias("_g"), *aggs).withColumn(cluster, F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(cluster).cast("string"))).drop("_g")


def cluster_shares(df: DataFrame, cluster: str, event: str) -> DataFrame:
    """Incidence, support, positives and mass of each cluster; one small row a cluster enters the window."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("n_pos"))
    w = Window.partitionBy()
    n, pos = F.sum("n").over(w), F.sum("n_pos").over(w)
    return per.select(
        cluster,
        "n",
        "n_pos",
        (F.col("n_pos") / F.col("n")).alias("incidence"),
        (F.col("n") / n).alias("mass"),
        F.try_divide(F.col("n_pos") / pos, (F.col("n") - F.col("n_pos")) / (n - pos)).alias("support"),
    )


def phi(df: DataFrame, code: str, cluster: str, compat: bool = False) -> DataFrame:
    """Phi coefficient of each (code, cluster) table of counts; ``compat`` uses the row sum in the place of the column sum for the fourth cell."""
    n = df.groupBy(code, cluster).agg(F.count("*").alias("a"))
    row, col, all_ = (F.sum("a").over(w) for w in (Window.partitionBy(code), Window.partitionBy(cluster), Window.partitionBy()))
    n = n.withColumns({"row": row, "col": col, "all": all_}).withColumns({"b": F.col("row") - F.col("a"), "c": F.col("col") - F.col("a")})
    n = n.withColumn("d", F.col("all") - F.col("row") - (F.col("a") if compat else F.col("c")))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    return n.select(code, cluster, F.col("a").alias("n"), F.try_divide(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d))).alias("phi"))


def auc(df: DataFrame, score: str, label: str, ranges: int = 256) -> DataFrame:
    """Area under the ROC curve by average ranks of tied scores.

    Equal scores meet in one group; groups are dealt by ranges of scores (bounds from a
    sketch), a running sum goes over each range, and the ranges' totals, a row each, give
    where it starts.
    """
    bounds = df.select(F.col(score).cast("double").alias("x")).where("x is not null").stat.approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.5 / ranges)
    place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col(score))), F.lit(0)) if bounds else F.lit(0)
    g = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")).withColumn("range", place)
    totals = g.groupBy("range").agg(F.sum("n").alias("m"))
    totals = totals.select(F.col("range").alias("r2"), (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("base"))
    before = F.col("base") + F.sum("n").over(Window.partitionBy("range").orderBy(score)) - F.col("n")
    r = g.join(totals, F.col("range") == F.col("r2")).withColumn("rank", before + (F.col("n") + 1) / 2.0)
    s = r.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def aic(log_likelihood: float, n: int, k: int) -> float:
    """From the mean log-likelihood of a row."""
    return -2 * log_likelihood * n + 2 * k


def bic(log_likelihood: float, n: int, k: int) -> float:
    return -2 * log_likelihood * n + k * math.log(n)


def knee(values: Sequence[float]) -> int:
    """Place of the value furthest from the chord between the first and the last."""
    n = len(values)
    if n < 3:
        return 0
    lo, hi = values[0], values[-1]
    away = [abs((hi - lo) * i / (n - 1) + lo - v) for i, v in enumerate(values)]
    return max(range(n), key=away.__getitem__)


def correlation_prune(df: DataFrame, cols: Sequence[str], limit: float = config.CORRELATION_LIMIT) -> list[str]:
    """Columns to drop: the later one of each pair with |r| at or above the limit.  One pass over the rows for all pairs."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        return []
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs))).first()
    gone: list[str] = []
    for i, (a, b) in enumerate(pairs):
        r = row[f"r{i}"]
        if a not in gone and b not in gone and r is not None and abs(r) >= limit:
            gone.append(b)
    return gone


def folds(df: DataFrame, k: int, label: str, key: str, seed: int = 42) -> DataFrame:
    """Stratified folds: rows of each label dealt in the order of a hash of their key.

    The place in that order is counted within 4096 ranges of the hash, so a label's rows are
    never in one task; the ranges' totals give where each begins.
    """
    rows = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))).withColumn("_b", F.substring("_h", 1, 3))
    n = rows.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_b2")).agg(F.count("*").alias("_n"))
    n = n.withColumn("_base", F.sum("_n").over(Window.partitionBy("_l").orderBy("_b2")) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_base")
    out = rows.join(n, F.col(label).eqNullSafe(F.col("_l")) & F.col("_b").eqNullSafe(F.col("_b2")))
    return out.withColumn("fold", F.pmod(place, F.lit(k)).cast("int")).drop("_h", "_b", "_l", "_b2", "_n", "_base")


def even_split(df: DataFrame, order: str, parts: int, ranges: int = 256) -> DataFrame:
    """``part`` 1 to ``parts`` of rows in the order of a numeric column without repeats, sizes as even as can be, larger ones first: places are counted within ranges of the column."""
    bounds = sorted(set(df.stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.5 / ranges)))
    rows = df.withColumn("_r", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0))
    n = rows.groupBy(F.col("_r").alias("_r2")).agg(F.count("*").alias("_n"))
    n = n.select("_r2", (F.sum("_n").over(Window.orderBy("_r2")) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(order)) + F.col("_base") - 1
    big, small = F.pmod("_all", F.lit(parts)), F.floor(F.col("_all") / parts)
    part = F.when(place < big * (small + 1), F.floor(place / (small + 1))).otherwise(big + F.floor((place - big * (small + 1)) / F.greatest(small, F.lit(1))))
    return rows.join(n, F.col("_r") == F.col("_r2")).withColumn("part", (part + 1).cast("int")).drop("_r", "_r2", "_base", "_all")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))
