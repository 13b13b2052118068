"""Removal of repeated byte strings across documents by suffix order and longest previous factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import release, saved

LAST = 2**63 - 1  # order of a null doc_id
#: Bytes of text in a block, pieces' buckets for each block, and minima that a task holds (a bucket gets about as many).
BLOCK_BYTES, FAN, HELD = 8 << 20, 4, 1 << 19
#: Bytes of pieces that are hashed at once, and windows that are put in suffix order at once (more only where they have one hash).
STEP, WINDOWS = 1 << 20, 1 << 17

arrays.apart()  # in every worker of this operator


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one with a smaller value, -1 if there is none."""
    at = np.arange(-1, len(values) - 1)
    live = np.flatnonzero(at >= 0)
    while True:
        live = live[(at[live] >= 0) & (values[at[live]] >= values[live])]
        if not len(live):
            return at
        at[live] = at[at[live]]


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest later one with a smaller value, the length if there is none."""
    return len(values) - 1 - previous_smaller(values[::-1])[::-1]


def repeated(windows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which windows (rows of equal width, bytes) also belong to a smaller owner.

    The windows are put in suffix order, ties in place order.  In that order the previous
    and the next place of a smaller owner give the longest earlier match of each, its
    longest previous factor; a window is repeated if that reaches its whole width.
    """
    width = windows.shape[1]
    text = np.ascontiguousarray(windows).view(f"S{width}").ravel()
    order = np.argsort(text, kind="stable")
    own, text = owner[order], text[order]
    out = np.zeros(len(order), bool)
    for other, there in ((p := previous_smaller(own), p >= 0), (q := next_smaller(own), q < len(own))):
        i = np.flatnonzero(there)
        out[order[i]] |= text[i] == text[other[i]]
    return out


def minima(data: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each position the smallest gram hash in the window of ``width`` bytes from it: equal windows have equal minima."""
    low, have, want = arrays.rolling(data, gram), 1, width - gram + 1
    if len(low) < want:
        return np.zeros(0, np.uint64)
    while have * 2 <= want:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = want - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def segments(data: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts in one document with equal minimum: (document, first start, last start, minimum)."""
    low = minima(data, width, gram)
    n = len(low)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    edge = np.zeros(n + 1, np.int32)  # starts that would leave their document
    ends = off[1:]
    np.add.at(edge, np.clip(np.maximum(off[:-1], ends - width + 1), 0, n), 1)
    np.add.at(edge, np.clip(ends, 0, n), -1)
    ok = np.cumsum(edge[:-1]) == 0
    cut = np.ones(n, bool)
    cut[1:] = (low[1:] != low[:-1]) | ~ok[:-1]
    cut[off[:-1][off[:-1] < n]] = True
    first = np.flatnonzero(ok & cut)
    stop = np.ones(n, bool)
    stop[:-1] = cut[1:] | ~ok[1:]
    last = np.flatnonzero(ok & stop)
    return np.searchsorted(off, first, side="right") - 1, first, last, low[first]


def bucket_of(low: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of minima.  Smallest hashes lie near zero, so their own high bits would fill the first buckets: they are mixed anew."""
    return ((arrays.mix64(low) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _distinct():
    """Cuts batches (key, text, ...) into slices and leaves out the texts that the task has had before."""
    seen: set[str] = set()

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text", arrays.SLICE_BYTES // 2):
                keys = part.column("key").to_pylist()
                take = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
                if len(seen) > 1 << 20:
                    seen.clear()
                yield part if len(take) == len(keys) else part.take(pa.array(take, pa.int64()))

    return run


def _anchors(width: int, gram: int, blocks: int, buckets: int):
    """For each bucket the minima of a task's texts by blocks, with (block, count of its minima); the lowest bit says that two texts have it."""

    def run(batches):
        held, size = [], 0

        def flush():
            block, low = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            bucket = bucket_of(low, buckets)
            group = bucket.astype(np.int64) * blocks + block
            order = np.lexsort((low, group))
            group, low = group[order], low[order]
            new = np.ones(len(low), bool)
            new[1:] = (group[1:] != group[:-1]) | (low[1:] != low[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(low)))
            packed = (low[begin] & ~np.uint64(1)) | (count > 1).astype(np.uint64)
            group = group[begin]
            cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            runs = np.stack((group[cut] % blocks, np.diff(np.append(cut, len(group)))), axis=1).astype(np.int32)
            own = group[cut] // blocks
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            ends = np.append(edge[1:], len(own))
            at = np.append(cut, len(group))
            run = [runs[a:b].tobytes() for a, b in zip(edge, ends, strict=True)]
            raw = [packed[at[a] : at[b]].tobytes() for a, b in zip(edge, ends, strict=True)]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(own[edge], pa.int32()), pa.array(run, pa.binary()), pa.array(raw, pa.binary())], names=["bucket", "blocks", "low"])

        for part in _distinct()(batches):
            data, off = arrays.buffers(part.column("text"))
            doc, _, _, low = segments(data, off, width, gram)
            low = low & ~np.uint64(1)
            order = np.lexsort((low, doc))
            doc, low = doc[order], low[order]
            new = np.ones(len(low), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])
            held.append((part.column("block").to_numpy()[doc[new]].astype(np.int64), low[new]))
            size += int(new.sum())
            if size >= HELD:
                yield from flush()
                size = 0
        if size:
            yield from flush()
        arrays.trim()

    return run


def _of_one(run):
    """A function of a group that hands memory back once its own arrays are gone."""

    def lean(frame: pd.DataFrame) -> pd.DataFrame:
        out = run(frame)
        arrays.trim()
        return out

    return lean


def _of_two(run):
    """The same for a function of two groups."""

    def lean(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = run(left, right)
        arrays.trim()
        return out

    return lean


@_of_one
def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's minima those of two texts at least, for each block that has them."""
    low = [np.frombuffer(x, np.uint64) for x in frame["low"]]
    block = np.concatenate([np.repeat(*np.frombuffer(x, np.int32).reshape(-1, 2).T) for x in frame["blocks"]])
    low = np.concatenate(low)
    twice, low = (low & np.uint64(1)).astype(bool), low & ~np.uint64(1)
    value, back, count = np.unique(low, return_inverse=True, return_counts=True)
    many = count > 1
    many[back[twice]] = True
    keep = many[back]
    block, low = block[keep], low[keep]
    del value, back, count, many, keep
    order = np.lexsort((low, block))
    block, low = block[order], low[order]
    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
    return pd.DataFrame({"block": block[cut], "kind": 0, "x": [low[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(low)), strict=False)], "y": None})


def _firsts():
    """Packs (key, order, times it stands there) of each text's first document by block."""

    def run(batches):
        for batch in batches:
            block = batch.column("block").to_numpy()
            keys = np.array([bytes.fromhex(k) for k in batch.column("key").to_pylist()], "V16")
            pairs = np.stack([batch.column(c).to_numpy() for c in ("ord", "times")], axis=1)
            own = np.unique(block)
            rows = [(int(b), keys[block == b].tobytes(), pairs[block == b].tobytes()) for b in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "kind", "x", "y"])

    return run


_ZSTD = pa.Codec("zstd", 1)


def _squeeze(raw: bytes) -> bytes:
    """Compressed bytes behind their whole length."""
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _restore(raw: bytes) -> bytes:
    return _ZSTD.decompress(memoryview(raw)[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, compressed with the same bytes of all numbers together."""
    return _squeeze(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns))


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(_restore(raw), np.uint8)
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        w = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


#: Pieces: order of the document, its place in the block, first byte, size.  Spans: place, first byte, end.
_PIECE, _SPAN = ("<i8", "<i4", "<i4", "<i4"), ("<i4", "<i4", "<i4")


def _texts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Distinct texts of a block in the order of their first documents."""
    first = right[right["kind"] == 1]
    if left.empty or first.empty:
        return pd.DataFrame({"key": [], "text": [], "ord": [], "times": []})
    at = {}
    for x, y in zip(first["x"], first["y"], strict=True):
        for i, o in enumerate(np.frombuffer(y, np.int64).reshape(-1, 2).tolist()):
            at[x[16 * i : 16 * i + 16].hex()] = o
    left = left.drop_duplicates("key")
    left = left.assign(ord=[at[k][0] for k in left["key"]], times=[at[k][1] for k in left["key"]])
    return left.sort_values(["ord", "key"], kind="stable")


def _runs(texts: pd.DataFrame):
    """Slices of a block: bytes, offsets, and the place of the first document."""
    raw, size, begin = [], 0, 0
    for i, t in enumerate(texts["text"]):
        b = t.encode("utf-8", "surrogatepass")
        raw.append(b)
        size += len(b)
        if size >= arrays.SLICE_BYTES // 2 or i == len(texts) - 1:
            yield np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64), begin
            raw, size, begin = [], 0, i + 1


def _cut(width: int, gram: int, buckets: int):
    """Pieces of a block's texts around shared minima, by bucket of the minimum; and spans that the block itself settles.

    A piece (run of windows) equal to one of a smaller document of the block is removed
    at once and not sent, so that a common passage is sent once for each block.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts = _texts(left, right)
        names = ["bucket", "block", "kind", "x", "y"]
        hits = right[right["kind"] == 0]["x"]
        if texts.empty or not len(hits):
            return pd.DataFrame({n: [] for n in names})
        block = int(right["block"].iat[0])
        shared = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in hits]))
        ords = texts["ord"].to_numpy(np.int64)
        found, pieces, sizes = [], [], []
        for data, off, begin in _runs(texts):
            doc, first, last, low = segments(data, off, width, gram)
            at = np.minimum(np.searchsorted(shared, low & ~np.uint64(1)), len(shared) - 1)
            hit = shared[at] == (low & ~np.uint64(1))
            doc, first, last, low = doc[hit], first[hit], last[hit], low[hit]
            if not len(doc):
                continue
            whole = arrays.rolling(data, width)
            count = last - first + 1
            same = arrays.mix64(whole[first] ^ arrays.mix64(whole[last] + count.astype(np.uint64)))
            # two windows cover a piece of up to twice their width; a longer one is taken as different from all
            long = count > width
            same[long] = arrays.mix64(np.arange(len(found) << 40, (len(found) << 40) + int(long.sum())).astype(np.uint64) ^ np.uint64(0x5BD1E995F1357AEA))
            size = (count + width - 1).astype(np.int64)
            found.append(pd.DataFrame({"doc": doc + begin, "first": first - off[doc], "size": size, "low": low, "same": same}))
            pieces.append(data[arrays.ranges(first, size)])
            sizes.append(size)
        if not found:
            return pd.DataFrame({n: [] for n in names})
        f = pd.concat(found, ignore_index=True)
        data = np.concatenate(pieces)
        begin = np.cumsum(f["size"].to_numpy()) - f["size"].to_numpy()
        doc = f["doc"].to_numpy()
        _, one, back = np.unique(f["same"].to_numpy(), return_index=True, return_inverse=True)
        settled = ords[doc] > ords[doc[one[back]]]
        start, size = (f[c].to_numpy(np.int64).astype("<i4") for c in ("first", "size"))
        place = doc.astype("<i4")
        rows = [(block % buckets, block, 2, _pack(place[settled], start[settled], start[settled] + size[settled]), b"")] if settled.any() else []
        send = np.flatnonzero(~settled)
        bucket = (arrays.mix64(f["low"].to_numpy()[send]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        send, bucket = send[order], bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(send) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(send)).tolist(), strict=False):
            own = send[a:b]
            rows.append((int(bucket[a]), block, 3, _pack(ords[doc[own]], place[own], start[own], size[own]), _squeeze(data[arrays.ranges(begin[own], size[own].astype(np.int64))].tobytes())))
        return pd.DataFrame(rows, columns=names)

    return _of_two(run)


def _places(n: int) -> type:
    """Numbers wide enough for places among ``n``."""
    return np.int32 if n < 2**31 else np.int64


def _codes(data: np.ndarray, width: int, start: np.ndarray) -> np.ndarray:
    """Hashes of the windows from ``start``, made by slices of the data: hashes of all positions would take eight bytes each several times."""
    code = np.empty(len(start), np.uint64)
    order = np.argsort(start, kind="stable").astype(_places(len(start)))
    edges = np.arange(0, len(data) + STEP, STEP)
    cut = np.searchsorted(start, edges, sorter=order)
    for lo, a, b in zip(edges.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=False):
        if b > a:
            own = order[a:b]
            code[own] = arrays.rolling(data[lo : lo + STEP + width - 1], width)[start[own] - lo]
    return code


def _gone(data: np.ndarray, width: int, start: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of the windows from ``start`` also belong to a smaller owner; owners don't fall along the windows.

    Windows that one owner has several times are put in suffix order once, and those that
    no other owner has not at all (a periodic text is one run of few different windows).
    Equal windows have equal hashes: ranges of hashes are put in order one after the other.
    """
    code = _codes(data, width, start)
    order = np.argsort(code, kind="stable").astype(_places(len(start)))
    code, own = code[order], owner[order]
    value = np.ones(len(code), bool)
    value[1:] = code[1:] != code[:-1]
    del code
    first = value.copy()
    first[1:] |= own[1:] != own[:-1]
    del own
    at = np.flatnonzero(first)
    group = np.cumsum(value[at])
    shared = np.bincount(group)[group] > 1
    place, group = order[at[shared]], group[shared]
    flags = np.zeros(len(place), bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, width)
    a = 0
    while a < len(place):
        b = int(np.searchsorted(group, group[min(a + WINDOWS, len(place)) - 1], side="right"))
        back = np.argsort(place[a:b], kind="stable")  # owners in order
        part = place[a:b][back]
        flags[a + back] = repeated(windows[start[part]], owner[part])
        a = b
    hit = np.zeros(len(at), bool)
    hit[shared] = flags
    out = np.zeros(len(order), bool)
    out[order] = hit[np.cumsum(first) - 1]
    return out


def _match(width: int):
    """Spans of a bucket's pieces that stand in a smaller document."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        done = frame[frame["kind"] == 2][["block", "x"]]
        sent = frame[frame["kind"] == 3]
        out = [done.assign(kind=2)[["block", "kind", "x"]]]
        if len(sent):
            heads = [_unpack(x, *_PIECE) for x in sent["x"]]
            block = np.repeat(sent["block"].to_numpy(), [len(h[0]) for h in heads])
            ords, place, first, size = (np.concatenate(c) for c in zip(*heads, strict=True))
            data = np.frombuffer(b"".join(_restore(y) for y in sent["y"]), np.uint8)
            size = size.astype(np.int64)
            begin = np.cumsum(size) - size
            order = np.lexsort((first, place, block, ords))
            ords, place, first, block, begin, size = (c[order] for c in (ords, place, first, block, begin, size))
            count = size - width + 1
            start = arrays.ranges(begin, count).astype(_places(len(data)))
            piece = np.repeat(np.arange(len(size), dtype=_places(len(size))), count)
            gone = np.flatnonzero(_gone(data, width, start, np.unique(ords, return_inverse=True)[1].astype(_places(len(size)))[piece]))
            if len(gone):
                # runs of window starts in one piece
                new = np.ones(len(gone), bool)
                new[1:] = (gone[1:] != gone[:-1] + 1) | (piece[gone[1:]] != piece[gone[:-1]])
                lo, hi = gone[new], gone[np.append(new[1:], True)]
                p = piece[lo]
                low = (first[p] + start[lo] - begin[p]).astype("<i4")
                high = (first[p] + start[hi] - begin[p] + width).astype("<i4")
                of = block[p]
                for b in np.unique(of).tolist():
                    own = of == b
                    out.append(pd.DataFrame({"block": [b], "kind": [2], "x": [_pack(place[p[own]], low[own], high[own])]}))
        return pd.concat(out, ignore_index=True)

    return _of_one(run)


def _whole_characters(raw: bytes, edge: list[int]) -> str:
    """A text without the bytes between odd and even edges; bytes of characters that an edge cuts in two go as well."""
    return "".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip([0, *edge[1::2]], [*edge[::2], len(raw)], strict=True))


def _strip(as_text: bool):
    """What is left of the texts of a block (bytes, or whole characters), and the spans removed."""
    names = ["ord", "times", "key", "n_bytes", "left", "spans"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts = _texts(left, right)
        if texts.empty:
            return pd.DataFrame({n: [] for n in names})
        found = [_unpack(x, *_SPAN) for x in right[right["kind"] == 2]["x"]] or [[np.zeros(0, np.int32)] * 3]
        doc, lo, hi = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
        rank = np.argsort(doc, kind="stable")
        doc, lo, hi = doc[rank], lo[rank], hi[rank]
        rows = []
        for data, off, begin in _runs(texts):
            a, b = np.searchsorted(doc, [begin, begin + len(off) - 1])
            base = off[doc[a:b] - begin]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, base + lo[a:b], 1)
            np.add.at(change, base + hi[a:b], -1)
            gone = np.cumsum(change[:-1]) > 0
            for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                own = gone[s:e]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).tolist()
                if as_text:
                    kept = _whole_characters(data[s:e].tobytes(), edge)
                else:
                    kept = data[s:e][~own].tobytes() if edge else data[s:e].tobytes()
                rows.append((begin + i, e - s, kept, [{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)]))
        place = [r[0] for r in rows]
        return pd.DataFrame({**{c: texts[c].to_numpy()[place] for c in ("ord", "times", "key")}, "n_bytes": [r[1] for r in rows], "left": [r[2] for r in rows], "spans": [r[3] for r in rows]})

    return _of_two(run)


def remove_repeats(docs: DataFrame, *, width: int = 50, gram: int = 24, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans array<struct<start, end>>, text_md5) for every row of ``docs`` (doc_id long, text).

    Each byte covered by a ``width``-byte string that also stands in a document with a
    smaller doc_id is removed; overlaps count, and strings are judged on the input.
    ``spans`` are the maximal removed runs of bytes.  Null counts as empty text; texts
    below ``width`` bytes lose nothing; rows with equal doc_ids don't affect each other; a
    null doc_id counts as the largest; other columns are ignored.  ``as_text``:
    ``kept`` is a text, without the bytes of characters that a span cuts in two, and rows with
    equal doc_id and text give one row, so that (doc_id, text_md5) names it.

    1. Equal texts fall together by MD5: all but the first document's copies go whole.
    2. Every window has a minimum among its gram hashes; equal windows have equal minima, so
    all windows of one run of equal minimum meet the windows equal to them by that value.
    Minima, packed and each once for a task, block and bucket, show which occur twice.
    3. Runs with such a minimum are sent as pieces of text to its bucket.  There the
    windows are put in suffix order, and longest previous factors tell which are repeated.
    4. The spans return to the blocks of texts.  Documents are dealt to blocks by their
    text's hash, buckets by the minimum's; what a block or task has already seen is sent once.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n", F.octet_length("text").cast("long"))
    long = docs.where(F.col("n") >= width).withColumn("key", F.md5(F.col("text").cast("binary")))
    rows = saved(long.select("ord", "n", "key"), "texts")
    blocks = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // BLOCK_BYTES))
    # about one minimum for width / 4 bytes
    buckets = max(8, -(-blocks * BLOCK_BYTES * 4 // (width * HELD)))
    fan = max(8, blocks * FAN)
    of_block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    keyed = long.select(of_block.alias("block"), "key", "text")
    texts = keyed.mapInArrow(_distinct(), "block int, key string, text string")
    first = rows.groupBy("key", "ord").agg(F.count("*").alias("times")).groupBy("key").agg(F.min("ord").alias("ord"), F.min_by("times", "ord").alias("times"))
    side = "block int, kind int, x binary, y binary"
    firsts = saved(first.select(of_block.alias("block"), "key", "ord", "times").mapInArrow(_firsts(), side), "firsts")
    lows = keyed.mapInArrow(_anchors(width, gram, blocks, buckets), "bucket int, blocks binary, low binary")
    shared = saved(lows.groupBy("bucket").applyInPandas(_shared, side), "shared")
    release(docs.sparkSession)
    sent = texts.groupBy("block").cogroup(shared.union(firsts).groupBy("block")).applyInPandas(_cut(width, gram, fan), "bucket int, block int, kind int, x binary, y binary")
    spans = saved(sent.groupBy("bucket").applyInPandas(_match(width), "block int, kind int, x binary"), "spans")
    release(docs.sparkSession)
    more = spans.select("block", "kind", "x", F.lit(None).cast("binary").alias("y"))
    kind = "string" if as_text else "binary"
    kept = texts.groupBy("block").cogroup(more.union(firsts).groupBy("block")).applyInPandas(_strip(as_text), f"ord long, times long, key string, n_bytes long, left {kind}, spans array<struct<start:long,end:long>>")
    # repeated rows: the first document of a text may stand there several times
    own = kept if as_text else kept.withColumn("t", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    later = rows.join(first.select("key", F.col("ord").alias("one")), "key").where("ord <> one")
    later = later.select("ord", "key", F.col("n").alias("n_bytes"), F.lit("").cast(kind).alias("left"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))).alias("spans"))
    short = docs.where(F.col("n") < width).select("ord", F.md5(F.col("text").cast("binary")).alias("key"), F.col("n").alias("n_bytes"), F.col("text").cast(kind).alias("left"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    if as_text:
        later, short = later.dropDuplicates(["ord", "key"]), short.dropDuplicates(["ord", "key"])
    names = ["ord", "key", "n_bytes", "left", "spans"]
    out = own.select(names).union(later.select(names)).union(short.select(names))
    return out.select(F.nullif("ord", F.lit(LAST)).alias("doc_id"), "n_bytes", F.col("left").alias("kept"), "spans", F.col("key").alias("text_md5"))
