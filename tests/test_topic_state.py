import random
from collections import Counter

from cohortry.streaming.sizes import sizes_of_changes, topic_changes, write_changes

SCHEMA = "doc long, number long, topic int"


def test_sizes_after_restarts(spark, tmp_path):
    rng = random.Random(5)
    events = [(rng.randrange(60), n, rng.choice([None, 0, 0, 0, 1, 2])) for n in range(300)]
    rng.shuffle(events)
    parts = [events[:100], events[100:200] + events[:30], events[200:] + [(None, 1, 1), (1, None, 1)]]  # some come twice
    seen: dict[int, tuple] = {}
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        write_changes(topic_changes(stream, "doc", "number", "topic"), f"{tmp_path}/out", f"{tmp_path}/mark")
        for doc, number, topic in part:
            if doc is not None and number is not None and number > seen.get(doc, (-1,))[0]:
                seen[doc] = (number, topic)
        want = Counter(t for _, t in seen.values() if t is not None)
        got = sizes_of_changes(spark.read.parquet(f"{tmp_path}/out")).collect()
        assert {r["topic"]: r["size"] for r in got} == dict(want)


def test_deleted_documents_stay_deleted(spark, tmp_path):
    for part in ([(1, 5, 2), (2, 1, 2)], [(1, 7, None)], [(1, 6, 3), (9, 1, None)]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        write_changes(topic_changes(stream, "doc", "number", "topic"), f"{tmp_path}/out", f"{tmp_path}/mark")
    assert [tuple(r) for r in sizes_of_changes(spark.read.parquet(f"{tmp_path}/out")).collect()] == [(2, 1)]
