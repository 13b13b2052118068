"""Readers: tables by extension, declared CSV, definition-driven CSV; and a shared place for intermediate tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of types in table definitions.
TYPES = {"int": T.LongType(), "int64": T.LongType(), "float": T.DoubleType(), "float64": T.DoubleType(), "str": T.StringType(), "category": T.StringType(), "bool": T.BooleanType(), "datetime": T.TimestampType()}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder only where none is set (one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, first: int | None = None) -> DataFrame:
    """Parquet, CSV, TSV or JSON by the path's ending; ``first`` rows only if given.  CSV and TSV take a schema, so no pass infers one."""
    ending = path.rsplit(".", 1)[-1]
    if ending in ("csv", "tsv"):
        df = read_csv(spark, path, schema, sep="\t" if ending == "tsv" else ",")
    else:
        r = spark.read.format({"json": "json", "orc": "orc"}.get(ending, "parquet"))
        df = (r.schema(schema) if schema else r).load(path)
    return df.limit(first) if first else df


def read_csv(spark: SparkSession, path: str, schema, sep: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, header=header)


def read_defined_csv(spark: SparkSession, path: str, definition: Mapping | str, sep: str = "|", encoding: str = "ISO-8859-1", drop_duplicates: bool = True) -> DataFrame:
    """CSV by a definition {column: {name, dtype, index}}: columns that it does not name are not read into rows.

    Leading blanks go, columns are renamed, dates that don't parse become null, equal rows
    fall together; an index column must be unique (ValueError otherwise).
    """
    spec = json.loads(definition) if isinstance(definition, str) else definition
    raw = spark.read.csv(path, sep=sep, encoding=encoding, header=True, ignoreLeadingWhiteSpace=True)
    cols = []
    for old, d in spec.items():
        kind = TYPES[d.get("dtype", "str")]
        c = F.col(f"`{old}`")
        cols.append((F.try_to_timestamp(c) if isinstance(kind, T.TimestampType) else c.try_cast(kind)).alias(d.get("name", old)))
    df = raw.select(*cols)
    if drop_duplicates:
        df = df.dropDuplicates()
    index = [d.get("name", old) for old, d in spec.items() if d.get("index")]
    if index and not df.groupBy(*index).count().where("count > 1").isEmpty():
        raise ValueError(f"{index} is not unique")
    return df


def read_code_maps(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(code, category) of several JSON files {code: category}, file i prefixed ``cats<i>_``; a later file overwrites a code's category.  Files of lookup size."""
    from ..operators.frames import code_map

    maps = [json.loads("".join(r.value for r in spark.read.text(p, wholetext=True).collect())) for p in paths]
    return code_map(spark, maps)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored(name: str, folder: str, subsample: bool = False) -> str:
    """Path of a stored table; a subsample's tables lie apart from the full ones."""
    return f"{folder.rstrip('/')}/{'subsample/' if subsample else ''}{name}"


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return bool(fs.exists(p))


def delete_table(spark: SparkSession, path: str) -> bool:
    """Whether there was one."""
    fs, p = _hadoop(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))


def cached_table(spark: SparkSession, name: str, make: Callable[[], DataFrame], override: bool = False) -> DataFrame:
    """A stage's result, kept as Parquet in the shared folder and made again only if asked."""
    path = f"{shared_folder(spark)}/cache/{name}"
    if override or not table_exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, ending: str) -> str:
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}.{ending}"
