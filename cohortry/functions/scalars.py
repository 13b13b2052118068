"""Scalar column builders: keys, days since the epoch, time weights, codes, text pieces."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def key(*parts: str) -> Column:
    """Composite key: parts joined by ``|``; a null part is written ``<NA>`` so that keys stay apart."""
    return F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("<NA>")) for p in parts))


def split_key(col: Column, part: int) -> Column:
    return F.split_part(col, F.lit("|"), F.lit(part + 1))


def join_text(*parts: str) -> Column:
    """Text columns with a blank between; nulls are empty and leave no blank behind."""
    return F.concat_ws(" ", *(F.nullif(F.trim(F.col(p)), F.lit("")) for p in parts))


def days(col: str | Column) -> Column:
    """Whole days since the epoch (floor)."""
    return F.datediff(F.to_date(F.col(col) if isinstance(col, str) else col), F.lit(config.EPOCH).cast("date")).cast("long")


def days_rounded(col: str) -> Column:
    """Days since the epoch, the time of day rounded half-even."""
    return F.bround(F.unix_micros(F.col(col).cast("timestamp")).cast("double") / F.lit(86400e6)).cast("long")


def day_string(col: Column) -> Column:
    return F.date_format(F.date_add(F.lit(config.EPOCH).cast("date"), col.cast("int")), "yyyy-MM-dd")


def year_difference(a: str, b: str) -> Column:
    """Years (of 365.25 days) from b to a."""
    return (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))).cast("double") / F.lit(86400e6) / F.lit(config.YEAR_DAYS_TAGGING)


def time_weight(t: Column) -> Column:
    """0.5 at the window's start and before, 1 at its end."""
    return F.round(F.greatest(t.cast("double"), F.lit(0.0)) / F.lit(float(config.FEATURE_DAYS)) * F.lit(0.5) + F.lit(0.5), 4)


def rebase(day: Column, last: Column) -> Column:
    """Day within the feature window; null beyond its end."""
    t = day - last + config.FEATURE_DAYS
    return F.when(t <= config.FEATURE_DAYS, t)


def atc_level(code: Column, level: int = 3) -> Column:
    """Leading part of an ATC code (levels take 1, 3, 4, 5 and 7 characters), padded to seven with ``_``."""
    return F.rpad(F.substring(code, 1, (1, 3, 4, 5, 7)[level - 1]), 7, "_")


def icpc_top(code: Column) -> Column:
    return F.substring_index(code, ".", 1)


#: Fixed formats of the two code systems.
ICPC_PATTERN = r"[ABDFHKLNPRSTUWXYZ](?!00)\d{2}(\.(?!00)\d{2})?"
ATC_PATTERN = r"[A-Z]\d{2}[A-Z]{2}((?!00)\d{2})?"


def parse_icpc(col: Column) -> Column:
    """First ICPC code in a text, upper case; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(col), ICPC_PATTERN, 0), F.lit(""))


def parse_atc(col: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(col), ATC_PATTERN, 0), F.lit(""))


def safe_percent(n: Column, total: Column) -> Column:
    return n.cast("double") * 100.0 / F.greatest(total.cast("double"), F.lit(1e-6))


def cosine_unit(x: Column) -> Column:
    """Cosine from [-1, 1] to [0, 1]."""
    return (x + 1.0) / 2.0


def html_unescape(col: Column, times: int = 2) -> Column:
    """All named and numeric entities, ``times`` over (the built-in functions know none): in Arrow batches, texts without an ampersand as they are."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, t in enumerate(out):
            for _ in range(times):
                if t is None or "&" not in t:
                    break
                t = html.unescape(t)
            out[i] = t
        return pa.array(out, pa.string())

    return run(col)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(a)), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def chunks(tokens: Column, length: int, overlap: float = 0.0, most: int | None = None) -> Column:
    """Runs of ``length`` tokens, each overlapping the one before by the ratio; at most ``most``."""
    step = max(1, length - int(length * overlap))
    begin = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(step))
    out = F.transform(begin, lambda i: F.slice(tokens, i + 1, length))
    return F.slice(out, 1, most) if most else out


def r6(col: Column) -> Column:
    return F.round(col.cast("double"), 6)
