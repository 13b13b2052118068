"""Table functions for SQL: chunks of ordered token rows, and nested rows made flat.

``register(spark)`` names them ``token_chunks`` and ``flat_days``.  Spark partitions and orders
the rows of a TABLE argument; a function sees one partition after the other, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="id long, chunk int, tokens array<string>")
class TokenChunks:
    """``token_chunks(TABLE(rows) PARTITION BY id ORDER BY (place), length, overlap)``: runs of ``length`` tokens, each beginning
    ``length`` less the overlapping part after the one before, as ``scalars.chunks`` makes them from an array.

    Columns are taken by place: id, place, and a token or an array of tokens that follow each other; rows that share an id are one text.  Null
    tokens are left out; an id with none else has one empty chunk.  No more than ``length`` tokens and a row's own are held, however long a text is.
    """

    def __init__(self):
        self.id, self.seen, self.made, self.held = None, False, 0, []
        self.length = self.step = 1

    def eval(self, row: Row, length: int, overlap: float) -> Iterator[tuple]:
        self.id, self.seen = row[0], True
        self.length, self.step = length, max(1, length - int(length * overlap))
        if row[2] is None:
            return
        self.held += [t for t in row[2] if t is not None] if isinstance(row[2], list) else [row[2]]
        at = 0
        while len(self.held) - at >= self.length:
            yield self.id, self.made, self.held[at : at + self.length]
            self.made, at = self.made + 1, at + self.step
        self.held = self.held[at:] if at else self.held

    def cut(self) -> tuple:
        out = (self.id, self.made, self.held)
        self.made, self.held = self.made + 1, self.held[self.step :]
        return out

    def terminate(self) -> Iterator[tuple]:
        while self.held or (self.seen and not self.made):
            yield self.cut()


@udtf(returnType="day long, flag string")
class FlatDays:
    """``flat_days(journals)``, lateral: a row for each nested entry with its fields ``day`` and ``flag``; none for null or empty lists."""

    def eval(self, journals: list[Row] | None) -> Iterator[tuple]:
        for j in journals or []:
            yield j["day"], j["flag"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("token_chunks", TokenChunks)
    spark.udtf.register("flat_days", FlatDays)
