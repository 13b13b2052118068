"""Sinks: Parquet, TSV, CSV reports, JSON rows; and the data of plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """By the path's ending: Parquet, or CSV or TSV with a header."""
    ending = path.rsplit(".", 1)[-1]
    if ending in ("csv", "tsv"):
        df.write.mode(mode).option("header", True).option("sep", "\t" if ending == "tsv" else ",").csv(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def as_json(*cols: str) -> Column:
    return F.to_json(F.struct(*cols))


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """(bin, n) of equal-width bins between the column's extremes, which count in."""
    row = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    if row.lo is None:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    width = (row.hi - row.lo) / bins or 1.0
    place = F.least(F.floor((F.col(col).cast("double") - row.lo) / width), F.lit(bins - 1)).cast("long")
    return df.where(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
