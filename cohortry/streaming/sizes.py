"""Topic sizes under additions, moves and deletions of documents that arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def topic_changes(events: DataFrame, doc: str, number: str, topic: str) -> DataFrame:
    """(topic, change): -1 and 1 for each document that leaves or joins a topic, from events (document, number, topic).

    The event with the largest number holds for a document, so events may come late, in any
    order and more than once; events of a document have different numbers.  A null topic
    deletes the document, and its number stays known, so that no older event brings it back.
    Rows without a document or a number are left out.  State is a row a document, dealt by
    document, so a topic that holds most of them is no hot key; a query that is started again
    from its checkpoint goes on where it stopped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, now = state.get if state.exists else (None, None)
        old = now
        for f in frames:
            top = f.loc[f["number"].idxmax()]
            if last is None or top["number"] > last:
                last, now = int(top["number"]), None if pd.isna(top["topic"]) else int(top["topic"])
        state.update((last, now))
        if old != now:
            rows = [(t, n) for t, n in ((old, -1), (now, 1)) if t is not None]
            yield pd.DataFrame(rows, columns=["topic", "change"])

    rows = events.select(F.col(doc).alias("doc"), F.col(number).cast("long").alias("number"), F.col(topic).cast("int").alias("topic")).where("doc is not null and number is not null")
    return rows.groupBy("doc").applyInPandasWithState(step, "topic int, change int", "number long, topic int", "append", GroupStateTimeout.NoTimeout)


def write_changes(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Takes all that is there and ends; each change is written once, also after a restart."""
    changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sizes_of_changes(changes: DataFrame) -> DataFrame:
    """(topic, size) of written changes; topics that lost all their documents are absent."""
    return changes.groupBy("topic").agg(F.sum("change").alias("size")).where("size > 0")
