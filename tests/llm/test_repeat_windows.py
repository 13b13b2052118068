"""Windows of a bucket by slices and ranges of hashes, against pairs of windows."""

import numpy as np
import pytest

from cohortry.llm import repeats


@pytest.mark.parametrize("step, most", [(7, 3), (64, 1), (1 << 20, 1 << 17)])
def test_windows_of_smaller_owners(monkeypatch, step, most):
    monkeypatch.setattr(repeats, "STEP", step)
    monkeypatch.setattr(repeats, "WINDOWS", most)
    rng = np.random.default_rng(step + most)
    width = 5
    data = rng.integers(97, 99, 300).astype(np.uint8)
    # pieces in any order of the data, owners rising, some with several pieces
    begin = rng.permutation(np.arange(0, 290, 12))
    start = (begin[:, None] + np.arange(6)[None, :]).ravel().astype(np.int32)
    owner = np.repeat(np.sort(rng.integers(0, 8, len(begin))), 6).astype(np.int32)
    text = [data[s : s + width].tobytes() for s in start]
    want = [any(text[j] == text[i] and owner[j] < owner[i] for j in range(len(text))) for i in range(len(text))]
    assert repeats._gone(data, width, start, owner).tolist() == want
    assert any(want) and not all(want)


def test_places_beyond_32_bits():
    assert repeats._places(2**31 - 1) is np.int32 and repeats._places(2**31) is np.int64


def test_memory_of_a_large_bucket(monkeypatch):
    """Ten megabytes of pieces, most windows shared: peak below 16 bytes a byte of text beside the windows' own columns."""
    import tracemalloc

    rng = np.random.default_rng(5)
    width = 50
    phrase = rng.integers(97, 123, 1_000_000).astype(np.uint8)
    data = np.tile(phrase, 10)
    begin = np.arange(0, len(data) - 62, 62)
    count = 13
    start = (begin[:, None] + np.arange(count)[None, :]).ravel().astype(np.int32)
    owner = np.repeat((begin // len(phrase)).astype(np.int32), count)
    tracemalloc.start()
    got = repeats._gone(data, width, start, owner)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(data)
    assert not got[owner == 0].any()


def test_minima_fill_buckets_evenly():
    """Smallest hashes lie near zero; the fullest of 64 buckets still has at most a fifth more than the mean."""
    data = np.random.default_rng(3).integers(97, 123, 1 << 20).astype(np.uint8)
    low = repeats.segments(data, np.array([0, len(data)]), 50, 24)[3] & ~np.uint64(1)
    count = np.bincount(repeats.bucket_of(low, 64).astype(np.int64), minlength=64)
    assert count.max() < 1.2 * count.mean()
    raw = np.bincount(((low >> np.uint64(32)) * np.uint64(64) >> np.uint64(32)).astype(np.int64), minlength=64)
    assert raw.max() > 10 * raw.mean()


def test_minima_are_sent_once_a_bucket():
    """However many blocks there are, a task sends a row for each bucket; the minima that two texts share come back for their blocks."""
    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(9)
    common = "".join(chr(c) for c in rng.integers(97, 123, 80))
    texts = ["".join(chr(c) for c in rng.integers(97, 123, 200)) + common for _ in range(60)]
    batch = pa.record_batch({"block": pa.array(np.arange(60) % 30, pa.int32()), "key": [str(i) for i in range(60)], "text": texts})
    rows = pa.Table.from_batches(repeats._anchors(50, 24, 30, 8)([batch])).to_pandas()
    assert len(rows) <= 8
    found = pd.concat([repeats._shared(f) for _, f in rows.groupby("bucket")])
    got = {(b, int(x)) for b, raw in zip(found["block"], found["x"]) for x in np.frombuffer(raw, np.uint64)}
    low = {}
    for i, t in enumerate(texts):
        for m in repeats.segments(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 50, 24)[3].tolist():
            low.setdefault(m & ~1, set()).add(i)
    assert got == {(i % 30, m) for m, own in low.items() if len(own) > 1 for i in own} and got
