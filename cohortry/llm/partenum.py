"""N-gram Jaccard join by PartEnum signatures: exact links, given as components."""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import components, drop_saved, fold_edges, release, saved, small_batches

_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: First-level partitions are cut into three; a signature covers two of the three, so one error is allowed.
SUBSETS = ((0, 1), (0, 2), (1, 2))
#: Signatures that a task holds before it hands them on, those of a bucket, and in how many steps a bucket is looked at.
FLUSH, BUCKET, STEPS = 1 << 20, 1 << 22, 16
#: Turns in which signatures are sent: a set signs in two bands that follow each other, so each turn has about half of them, and only one turn's are on disk.
TURNS = 2
#: Signatures of a bucket whose sets bring their sketches along.
SKETCHED = 1 << 20
#: Shingles that a task of the exact comparison holds on average, shingles and sets of a candidate group compared at once.
TASK, UNIT_SHINGLES, UNIT = 1 << 19, 1 << 21, 1 << 12
#: Bytes of sketches compared at once, and pairs of sets listed at once.
SKETCH_BYTES, PAIRS = 4 << 20, 1 << 19

arrays.apart()  # in every worker of this operator


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each document, one after the other, and their offsets.

    A-Z count as a-z.  Fewer words than ``width`` are one shingle; no words, none.
    """
    low = arrays.LOWER[data]
    starts, ends, at = arrays.words(low, off)
    word = arrays.word_hashes(low, starts, ends)
    n = max(0, len(word) - width + 1)
    full = np.full(n, np.uint64(width))
    for j in range(width):
        full = full * _PRIME + word[j : j + n]
    full = arrays.mix64(full)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = arrays.mix64(np.array([h ^ w]))[0]
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def set_keys(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set (sets x 2, equal sets: equal keys); sets without elements have key 0, 0."""
    some = np.diff(off) > 0
    out = np.zeros((len(off) - 1, 2), np.uint64)
    for j, salt in enumerate((_PRIME, np.uint64(0xC2B2AE3D27D4EB4F))):
        total = np.concatenate(([np.uint64(0)], np.cumsum(arrays.mix64(flat ^ salt))))
        out[:, j] = arrays.mix64(total[off[1:]] - total[off[:-1]]) * some
    return out.view(np.int64)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of a power of two of cells, in bytes: at least as many elements differ between two sets as parities do."""
    cells = sketch_cells(len(own))
    odd = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def sketch_cells(n: int) -> int:
    return 1 << max(6, math.ceil(math.log2(1.6 * max(1, n))))


class Sketches:
    """Sketches of some sets, one matrix for each length."""

    def __init__(self, marks: list[np.ndarray]):
        self.size = np.array([len(m) for m in marks], np.int64)
        self.row = np.zeros(len(marks), np.int64)
        self.bits = {}
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            self.row[own] = np.arange(len(own))
            self.bits[n] = np.concatenate([marks[k] for k in own.tolist()]).view(np.uint64).reshape(len(own), n // 8)

    def differ(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Parities in which the sets of each pair differ; the longer sketch is folded, as parities of halves add up."""
        out = np.zeros(len(p), np.int64)
        for a in self.bits:
            for b in self.bits:
                own = np.flatnonzero((self.size[p] == a) & (self.size[q] == b))
                short = min(a, b) // 8
                step = max(1, SKETCH_BYTES // max(a, b))
                for k in range(0, len(own), step):
                    o = own[k : k + step]
                    x, y = (np.bitwise_xor.reduce(self.bits[n][self.row[r[o]]].reshape(len(o), -1, short), axis=1) for n, r in ((a, p), (b, q)))
                    out[o] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


@dataclass(frozen=True)
class Band:
    """Sizes low ... high (of the larger set of a pair), and what they need.

    ``errors``: most elements in which two linked sets differ.  ``first`` first-level
    partitions: at least 1 + ``spare`` of them have one error at most.
    """

    index: int
    low: int
    high: int
    errors: int
    first: int
    spare: int


@lru_cache
def bands(threshold: Fraction) -> tuple[Band, ...]:
    """All bands, up to sets larger than any text."""
    out, low = [], 1
    while low < 1 << 40:
        high = math.floor(low / threshold)
        errors = math.floor(2 * high * (1 - threshold) / (1 + threshold))
        base = errors // 2 + 1
        spare = 0 if base < 4 else 2 + base * 12 // 100
        out.append(Band(len(out), low, high, errors, base + spare, spare))
        low = high + 1
    return tuple(out)


def signatures(own: np.ndarray, band: Band) -> np.ndarray:
    """The signatures of one set in one band.

    Elements fall by hash into ``first`` x 3 parts.  For a linked pair at least 1 + spare
    first-level partitions hold one error at most, and in each of these some two of the
    three parts agree.  Signatures of two empty parts are left out, unless the set has
    more than ``spare`` partitions in which that could lose the pair.
    """
    salt = arrays.mix64(np.array([band.index + 1], np.uint64))
    part = arrays.mix64(own ^ salt) % np.uint64(3 * band.first)
    part = part.astype(np.int64)
    sums = np.zeros(3 * band.first, np.uint64)
    np.add.at(sums, part, arrays.mix64(own + _PRIME))
    full = np.zeros(3 * band.first, bool)
    full[part] = True
    sums, full = sums.reshape(-1, 3), full.reshape(-1, 3)
    risky = (full.sum(axis=1) <= 1).sum() > band.spare
    where = np.arange(band.first, dtype=np.uint64)
    out = []
    for k, (i, j) in enumerate(SUBSETS):
        sig = arrays.mix64(sums[:, i] * _PRIME + sums[:, j] + (where * np.uint64(3) + np.uint64(k)) * np.uint64(0xD1342543DE82EF95) + salt)
        out.append(sig if risky else sig[full[:, i] | full[:, j]])
    return np.concatenate(out)


def set_signatures(own: np.ndarray, threshold: Fraction, turn: int | None = None) -> np.ndarray:
    """Signatures in the bands (all, or those of a turn) in which the set may be one of a linked pair of different sets."""
    n, every = len(own), bands(threshold)
    at = bisect_left(every, n, key=lambda b: b.high)
    most = n * threshold.denominator // threshold.numerator
    return np.concatenate([np.zeros(0, np.uint64), *(signatures(own, b) for b in every[at : at + 2] if b.low <= most and b.errors > 0 and (turn is None or b.index % TURNS == turn))])


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells different rows (doc_id and whole text) apart; a null text counts as empty."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))


def row_name(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The same as 128 bits, by which a row is known outside."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def _once(batches):
    """Each ``h`` once a task: a row that is repeated any number of times is sent on once by each."""
    seen: set[int] = set()
    for batch in batches:
        h = batch.column("h").to_pylist()
        keep = []
        for i, x in enumerate(h):
            if x not in seen:
                seen.add(x)
                keep.append(i)
        if len(keep) == len(h):
            yield batch
        elif keep:
            yield batch.take(pa.array(keep, pa.int64()))


def _sets(batches, text: str, width: int):
    for batch in batches:
        for part in arrays.slices(batch, text):
            flat, off = shingle_sets(*arrays.buffers(part.column(text)), width)
            yield part, flat, off


def _summaries(width: int):
    def run(batches):
        for part, flat, off in _sets(batches, "text", width):
            keys = set_keys(flat, off)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), part.column("row"), pa.array(np.diff(off), pa.int64()), *(pa.array(keys[:, j]) for j in (0, 1))], names=["doc_id", "h", "row", "n", "ka", "kb"])
        arrays.trim()

    return run


def _emit(threshold: Fraction, width: int, buckets: int, turn: int):
    """Packed signatures of a turn: for each bucket the first key halves of some sets, and (signature's 48 bits, place of the key) as 64-bit numbers.

    Sets of one task that share a signature are linked here: the first of them goes on under
    that signature, the others as links (rows without signatures), so a signature that very
    many sets share gives its bucket one entry a task.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        keys: list[int] = []
        sigs: list[np.ndarray] = []
        held = 0

        def flush():
            sig = np.concatenate(sigs)
            at = np.repeat(np.arange(len(keys), dtype=np.uint64), [len(s) for s in sigs])
            order = np.argsort(sig, kind="stable")
            sig, at, names = sig[order], at[order], np.array(keys, np.int64)
            first = np.concatenate(([True], sig[1:] != sig[:-1]))
            hub = at[first][np.cumsum(first) - 1]
            pairs = np.stack([names[x[~first].astype(np.int64)] for x in (at, hub)])
            sig, at = sig[first], at[first]
            cut = np.searchsorted(((sig >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16), np.arange(buckets + 1, dtype=np.uint64))
            rows = []
            for b in range(buckets):
                own = slice(cut[b], cut[b + 1])
                used, place = np.unique(at[own], return_inverse=True)
                if len(used):
                    rows.append((b, names[used.astype(np.int64)].tobytes(), ((sig[own] << np.uint64(16)) | place.astype(np.uint64)).tobytes()))
            pairs = np.stack(fold_edges(*pairs[:, pairs[0] != pairs[1]]))
            if pairs.size:
                rows.append((int(pairs[0, 0]) % buckets, pairs.tobytes(), b""))
            keys.clear()
            sigs.clear()
            del sig, at, order, first, hub
            arrays.trim()
            for i in range(0, len(rows), 64):
                part = rows[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.binary())], names=["bucket", "keys", "sigs"])

        for _, flat, off in _sets(batches, "text", width):
            for key, a, b in zip(map(tuple, set_keys(flat, off).tolist()), off[:-1].tolist(), off[1:].tolist(), strict=True):
                if a == b or key in seen:
                    continue
                seen.add(key)
                own = set_signatures(flat[a:b], threshold, turn)
                if not len(own):
                    continue
                keys.append(key[0])
                sigs.append(own)
                held += len(own)
                if held >= FLUSH or len(keys) == 0xFFFF:
                    yield from flush()
                    held = 0
            if len(seen) > 1 << 20:
                seen.clear()
        if keys:
            yield from flush()
        seen.clear()
        arrays.trim()

    return run


def _views(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The numbers in each cell of a binary column, not copied."""
    return [np.frombuffer(chunk[i].as_buffer(), kind) for chunk in column.chunks for i in range(len(chunk))]


def _candidates(table: pa.Table) -> pa.Table:
    """A spanning forest (a, b: first key halves) of the sets of a bucket that share signatures."""
    links, parts = [], []
    for k, s in zip(_views(table.column("keys"), np.int64), _views(table.column("sigs"), np.uint64), strict=True):
        if len(s):
            parts.append((k, s))
        else:
            links.append(k.reshape(2, -1))
    low = min((int(s.min()) >> 16 for _, s in parts), default=0)
    high = max((int(s.max()) >> 16 for _, s in parts), default=0) + 1
    for i in range(STEPS):  # by ranges of signatures: equal ones meet in one step
        a, b = (np.uint64(low + (high - low) * j // STEPS) for j in (i, i + 1))
        sig, key = [], []
        for k, s in parts:
            x = s >> np.uint64(16)
            own = np.flatnonzero((x >= a) & (x < b))
            sig.append(x[own])
            key.append(k[(s[own] & np.uint64(0xFFFF)).astype(np.int64)])
        if sig:
            sig, key = np.concatenate(sig), np.concatenate(key)
            order = np.argsort(sig, kind="stable")
            sig, key = sig[order], key[order]
            same = np.flatnonzero(sig[1:] == sig[:-1])
            links.append(np.stack(fold_edges(key[same], key[same + 1])))
    del parts
    pairs = np.concatenate([np.zeros((2, 0), np.int64), *links], axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    hi, lo = fold_edges(*pairs)
    del links, pairs
    arrays.trim()
    return pa.table({"a": pa.array(hi, pa.int64()), "b": pa.array(lo, pa.int64())})


def _emit_large(threshold: Fraction, width: int, buckets: int, turn: int):
    """Packed signatures of a turn of the sets of large candidate groups: for each bucket the nodes of some sets, and (signature's 48 bits, place of the node) as 64-bit numbers.

    In the first turn nodes, sizes and sketches of all sets go along once, in rows without signatures.
    """

    def run(batches):
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def flush():
            node, n = (np.array([h[j] for h in held], np.int64) for j in (0, 1))
            sig = np.concatenate([h[3] for h in held])
            at = np.repeat(np.arange(len(held), dtype=np.uint64), [len(h[3]) for h in held])
            order = np.argsort(sig, kind="stable")
            sig, at = sig[order], at[order]
            cut = np.searchsorted(((sig >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16), np.arange(buckets + 1, dtype=np.uint64))
            rows = [(int(node[0]) % buckets, node.tobytes(), n.tobytes(), b"".join(h[2].tobytes() for h in held), b"")] if turn == 0 else []
            for b in range(buckets):
                own = slice(cut[b], cut[b + 1])
                used, place = np.unique(at[own].astype(np.int64), return_inverse=True)
                if len(used):
                    rows.append((b, node[used].tobytes(), b"", b"", ((sig[own] >> np.uint64(16) << np.uint64(16)) | place.astype(np.uint64)).tobytes()))
            held.clear()
            del sig, at, order
            arrays.trim()
            for i in range(0, len(rows), 64):
                part = rows[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), *(pa.array([r[j] for r in part], pa.binary()) for j in (1, 2, 3, 4))], names=["bucket", "nodes", "sizes", "marks", "sigs"])

        total = 0
        for part, flat, off in _sets(batches, "text", width):
            given = np.stack([part.column(c).to_numpy() for c in ("ka", "kb")], axis=1)
            same = (set_keys(flat, off) == given).all(axis=1)
            for node, ok, a, b in zip(part.column("node").to_pylist(), same.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                if ok:
                    own = set_signatures(flat[a:b], threshold, turn)
                    held.append((node, b - a, sketch(flat[a:b]) if turn == 0 else None, own))
                    total += len(own)
                if total >= FLUSH or len(held) == 0xFFFF:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return run


def _shared_signatures(table: pa.Table) -> pa.Table:
    """Of a bucket's signatures those that two sets have, for each of these sets; and the sketches that came along."""
    node, n, mark, parts = [], [], [], []
    for k, c, m, s in zip(*(_views(table.column(x), kind) for x, kind in (("nodes", np.int64), ("sizes", np.int64), ("marks", np.uint8), ("sigs", np.uint64))), strict=True):
        if len(c):
            node += k.tolist()
            n += c.tolist()
            mark += [x.tobytes() for x in np.split(m, np.cumsum([sketch_cells(x) // 8 for x in c.tolist()])[:-1])]
        else:
            parts.append((k, s))
    sigs = [None] * len(node)
    low = min((int(s.min()) >> 16 for _, s in parts), default=0)
    high = max((int(s.max()) >> 16 for _, s in parts), default=0) + 1
    found = [np.zeros((2, 0), np.uint64)]
    for i in range(STEPS):  # by ranges of signatures: equal ones meet in one step
        a, b = (np.uint64(low + (high - low) * j // STEPS) for j in (i, i + 1))
        sig, key = [], []
        for k, s in parts:
            x = s >> np.uint64(16)
            own = np.flatnonzero((x >= a) & (x < b))
            sig.append(x[own])
            key.append(k[(s[own] & np.uint64(0xFFFF)).astype(np.int64)])
        if sig:
            sig, key = np.concatenate(sig), np.concatenate(key)
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            fresh = np.ones(len(sig), bool)  # a set whose text stands in several rows counts once
            fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            sig, key = sig[fresh], key[fresh]
            same = np.zeros(len(sig), bool)
            same[1:] = sig[1:] == sig[:-1]
            same[:-1] |= same[1:]
            found.append(np.stack((key[same].view(np.uint64), sig[same] << np.uint64(16))))
    del parts
    key, sig = np.concatenate(found, axis=1)
    order = np.argsort(key, kind="stable")
    key, sig = key[order].view(np.int64), sig[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    node += key[cut].tolist()
    sigs += [sig[a:b].tobytes() for a, b in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=False)]
    none = [None] * len(cut)
    arrays.trim()
    return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n + none, pa.int64()), "mark": pa.array(mark + none, pa.binary()), "sigs": pa.array(sigs, pa.binary())})


def _emit_sketched(buckets: int):
    """Packed signatures of sets (node, n, mark, sigs): for each bucket the nodes, sizes and sketches of some sets, and (signature's 48 bits, place of the set) as 64-bit numbers."""

    def run(batches):
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def flush():
            node, n = (np.array([h[j] for h in held], np.int64) for j in (0, 1))
            sig = np.concatenate([h[3] for h in held])
            at = np.repeat(np.arange(len(held), dtype=np.uint64), [len(h[3]) for h in held])
            order = np.argsort(sig, kind="stable")
            sig, at = sig[order], at[order]
            cut = np.searchsorted(((sig >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16), np.arange(buckets + 1, dtype=np.uint64))
            for b in range(buckets):
                own = slice(cut[b], cut[b + 1])
                used, place = np.unique(at[own].astype(np.int64), return_inverse=True)
                if len(used):
                    row = (b, node[used].tobytes(), n[used].tobytes(), b"".join(held[k][2] for k in used.tolist()), (sig[own] | place.astype(np.uint64)).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["bucket", "nodes", "sizes", "marks", "sigs"])
            held.clear()
            del sig, at, order
            arrays.trim()

        total = 0
        for batch in batches:
            for node, n, mark, sigs in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "mark", "sigs")), strict=True):
                own = np.frombuffer(b"".join(sigs), np.uint64)
                held.append((node, n, mark, own))
                total += len(own)
                if total >= FLUSH or len(held) == 0xFFFF:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return run


def _plausible(threshold: Fraction):
    """A spanning forest (a, b: nodes) of the sets of a bucket that share a signature and whose sizes and sketches don't exclude a link."""

    def join(sig, at, n, sketches, comp, seen):
        """The components after all plausible links of sets that share one of some signatures."""
        order = np.lexsort((at, n[at], sig))
        sig, at = sig[order], at[order]
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (at[1:] != at[:-1])))[: len(sig)]
        sig, at = sig[fresh], at[fresh]
        # the partners of an entry: those behind it in its group, up to the size that can link
        end = np.append(np.flatnonzero(sig[1:] != sig[:-1]) + 1, len(sig))
        end = np.repeat(end, np.diff(np.concatenate(([0], end))))
        top = np.minimum(end, np.searchsorted(_in_group(sig, n[at]), _in_group(sig, n[at] * threshold.denominator // threshold.numerator), side="right"))
        count = np.maximum(top - np.arange(len(sig)) - 1, 0)
        total = np.cumsum(count)
        k = 0
        while k < len(sig):
            stop = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIRS, side="right")))
            p = np.repeat(at[k:stop], count[k:stop])
            q = at[arrays.ranges(np.arange(k, stop) + 1, count[k:stop])]
            k = stop
            apart = np.flatnonzero(comp[p] != comp[q])
            code = np.unique(np.minimum(p[apart], q[apart]) * len(n) + np.maximum(p[apart], q[apart]))
            code = code[~np.isin(code, seen, assume_unique=True)]
            if not len(code):
                continue
            if len(seen) < 1 << 20:
                seen = np.concatenate((seen, code))
            p, q = code // len(n), code % len(n)
            ok = (threshold.numerator + threshold.denominator) * sketches.differ(p, q) <= (threshold.denominator - threshold.numerator) * (n[p] + n[q])
            if ok.any():
                hi, lo = fold_edges(comp[p[ok]], comp[q[ok]])
                root = np.arange(len(n))
                root[hi] = lo
                comp = root[comp]
        return comp, seen

    def run(table: pa.Table) -> pa.Table:
        nodes, sizes = (_views(table.column(c), np.int64) for c in ("nodes", "sizes"))
        parts, marks = _views(table.column("sigs"), np.uint64), []
        for k, m in zip(sizes, _views(table.column("marks"), np.uint8), strict=True):
            marks += np.split(m, np.cumsum([sketch_cells(c) // 8 for c in k.tolist()])[:-1])
        names, first, back = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
        n, base = np.concatenate(sizes)[first], np.cumsum([0, *map(len, nodes)])
        sketches = Sketches([marks[k] for k in first.tolist()])
        del marks
        comp, seen = np.arange(len(names)), np.zeros(0, np.int64)
        low, high = min(int(s.min()) >> 16 for s in parts), max(int(s.max()) >> 16 for s in parts) + 1
        for i in range(STEPS):  # by ranges of signatures: equal ones meet in one step
            lo, hi = (np.uint64(low + (high - low) * j // STEPS) for j in (i, i + 1))
            sig, at = [], []
            for s, shift in zip(parts, base, strict=False):
                x = s >> np.uint64(16)
                own = np.flatnonzero((x >= lo) & (x < hi))
                sig.append(x[own])
                at.append(back[(s[own] & np.uint64(0xFFFF)).astype(np.int64) + shift])
            comp, seen = join(np.concatenate(sig), np.concatenate(at), n, sketches, comp, seen)
        joined = np.flatnonzero(comp != np.arange(len(names)))
        arrays.trim()
        return pa.table({"a": pa.array(names[joined], pa.int64()), "b": pa.array(names[comp[joined]], pa.int64())})

    return run


def _in_group(sig: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers that order entries by signature group, then by size."""
    if not len(sig):
        return np.zeros(0)
    group = np.cumsum(np.concatenate(([0], sig[1:] != sig[:-1])))
    return group.astype(np.float64) * 2.0**24 + np.minimum(n, 2**24 - 1)


def link_sets(flat: np.ndarray, off: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The components after all links between sets marked ``left`` and sets marked ``right`` are made.

    A set is compared exactly with all others of a linkable size, unless they are in its
    component already.
    """
    size = np.diff(off)
    order = np.lexsort((np.arange(len(size)), size))
    n = size[order]
    comp = component[order].copy()
    left, right = left[order], right[order]
    low, at = np.unique(flat, return_inverse=True)
    at = at[arrays.ranges(off[:-1][order], n)]
    cut = np.concatenate(([0], np.cumsum(n)))
    top = np.searchsorted(n, n * threshold.denominator // threshold.numerator, side="right")
    mark = np.zeros(len(low), bool)
    for x in range(len(n)):
        y = np.arange(x + 1, top[x])
        y = y[(comp[y] != comp[x]) & (right[y] if left[x] else False) | (comp[y] != comp[x]) & (left[y] if right[x] else False)]
        if not len(y):
            continue
        own = at[cut[x] : cut[x + 1]]
        mark[own] = True
        whole = 3 * len(y) > top[x] - x
        if whole:
            a, b = cut[y[0]], cut[y[-1] + 1]
            both = np.add.reduceat(mark[at[a:b]], cut[y[0] : y[-1] + 1] - a, dtype=np.int64)[y - y[0]]
        else:
            both = np.add.reduceat(mark[at[arrays.ranges(cut[y], n[y])]], np.cumsum(n[y]) - n[y], dtype=np.int64)
        mark[own] = False
        hit = y[threshold.denominator * both >= threshold.numerator * (n[x] + n[y] - both)]
        if len(hit):
            old = np.unique(np.append(comp[hit], comp[x]))
            comp[np.isin(comp, old)] = old[0]
    out = np.empty_like(comp)
    out[order] = comp
    return out


def _compare(threshold: Fraction, width: int, final: bool):
    """Rows of a task: texts of the sets of some units.  Each unit is linked for itself.

    ``final``: (ka, kb, and the first row of its component) of each set; else links (a, b)
    of a forest that joins what was found to be one component.
    """

    def run(table: pa.Table) -> pa.Table:
        made = [shingle_sets(*arrays.buffers(part.column(0)), width) for b in table.select(["text"]).to_batches() for part in arrays.slices(b, "text")]
        flat = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in made)])
        off = np.cumsum(np.concatenate([[0], *(np.diff(x[1]) for x in made)]))
        del made
        keys = set_keys(flat, off)
        given = np.stack([table.column(c).to_numpy() for c in ("ka", "kb")], axis=1)
        cols = {c: table.column(c).to_numpy() for c in ("unit", "node", "component", "doc_id", "h")}
        left, right = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("l", "r"))
        none = table.column("no_id").to_numpy(zero_copy_only=False).astype(bool)
        good = np.flatnonzero((keys == given).all(axis=1))  # a row_key of two texts would be told apart here
        order = good[np.lexsort((cols["node"][good], cols["unit"][good]))]
        unit, node = cols["unit"][order], cols["node"][order]
        new = np.concatenate(([True], unit[1:] != unit[:-1]))[: len(order)]
        fresh = new | np.concatenate(([True], node[1:] != node[:-1]))[: len(order)]
        l, r = (np.logical_or.reduceat(x[order], np.flatnonzero(fresh)) if len(order) else x[order] for x in (left, right))
        order, new = order[fresh], np.flatnonzero(new[fresh])
        out = []
        for a, b in zip(new.tolist(), np.append(new[1:], len(order)).tolist(), strict=False):
            own = order[a:b]
            size = off[own + 1] - off[own]
            start = cols["component"][own]
            comp = link_sets(flat[arrays.ranges(off[own], size)], np.concatenate(([0], np.cumsum(size))), start, l[a:b], r[a:b], threshold)
            by = np.lexsort((cols["h"][own], cols["doc_id"][own], none[own], comp))
            first = np.concatenate(([True], comp[by][1:] != comp[by][:-1]))
            lead = own[by][first][np.cumsum(first) - 1]  # of the sets in the order ``by``
            out.append((own[by], lead) if final else np.stack((start[by], start[by][first][np.cumsum(first) - 1])))
        arrays.trim()
        if final:
            own, lead = (np.concatenate([np.zeros(0, np.int64), *(x[j] for x in out)]).astype(np.int64) for j in (0, 1))
            return pa.table({"ka": pa.array(given[own, 0]), "kb": pa.array(given[own, 1]), "no_id": pa.array(none[lead]), "first_id": pa.array(cols["doc_id"][lead], pa.int64()), "first_h": pa.array(cols["h"][lead], pa.int64())})
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
        hi, lo = fold_edges(*pairs[:, pairs[0] != pairs[1]])
        return pa.table({"a": pa.array(hi, pa.int64()), "b": pa.array(lo, pa.int64())})

    return run


_FINAL = "ka long, kb long, no_id boolean, first_id long, first_h long"
_FIRST = ("no_id", "first_id", "first_h")


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``jaccard_rows``."""
    return jaccard_rows(docs, **options).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, *, threshold: Fraction = Fraction(4, 5), width: int = 5, unit_sets: int = UNIT, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row) for every row of ``docs`` (doc_id long, text).

    Two documents link when the Jaccard similarity of their sets of ``width``-word shingles
    is at least ``threshold``; a component is named by its smallest doc_id (null where none of
    its rows has one).  Null and empty texts, and texts without words, have no shingles and
    link with nothing, so they stand alone.  Links are between sets, so rows with equal
    doc_ids and different texts link each for itself, and rows with a null doc_id link like
    others.  Repeated rows each give a row.  ``row`` is ``row_name`` of the row; ``kept`` marks
    the rows of one doc_id and text of each component (the smallest doc_id, nulls last).
    Other columns are ignored, whatever their names.

    1. Equal sets fall together by a 128-bit key before anything is compared, so a group of
       copies counts once.  2. PartEnum: sizes fall into bands of ratio 1 / threshold; a set
       signs in its own band and the next.  Signatures travel packed, 8 bytes each; sets that
       share one are joined to candidate groups, in a task first, then by buckets, so what is
       sent and returned are forests, never lists of pairs.  They are sent in two turns, one
       for every other band, and what a step has dealt is deleted before the next.  3. Candidate groups of up to
       ``unit_sets`` sets and ``unit_shingles`` shingles, nearly all, are compared exactly by
       one task each, set by set, leaving out what is linked already.  4. A larger group is
       cut into parts of that size, by hash; two common sets go to all of them, so that parts
       of one cluster meet.  Sets that are not in the group's main component then are compared
       with all others of the group, part by part.
    """
    with small_batches(docs.sparkSession):
        return _rows(docs, threshold, width, unit_sets, unit_shingles)


def _rows(docs: DataFrame, threshold: Fraction, width: int, unit_sets: int, unit_shingles: int) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", row_key())
    named = base.select("doc_id", "text", "h", row_name().alias("row"))
    rows = saved(named.mapInArrow(_summaries(width), "doc_id long, h long, row binary, n long, ka long, kb long"), "sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h")).alias("first")
    classes = rows.where("n > 0").groupBy("ka", "kb").agg(first, F.first("n").alias("n")).select("ka", "kb", "n", "first.*")
    buckets = max(8, min(1 << 16, -(-total // (BUCKET * TURNS))))
    forests = []
    for turn in range(TURNS):
        packed = base.select("text").mapInArrow(_emit(threshold, width, buckets, turn), "bucket int, keys binary, sigs binary")
        forests.append(saved(packed.groupBy("bucket").applyInArrow(_candidates, "a long, b long"), "forest"))
        release(docs.sparkSession)
    group = components(reduce(DataFrame.union, forests), folded=True)
    for df in forests:
        drop_saved(df)
    member = saved(classes.join(group, F.col("ka") == F.col("id")).drop("id").withColumnRenamed("component", "c").withColumn("node", F.monotonically_increasing_id()), "members")
    units = Units(threshold, width, unit_sets, unit_shingles)
    texts = base.select("h", "text")
    if not rows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").isEmpty():  # repeated rows
        texts = texts.mapInArrow(_once, "h long, text string")
    found = units.settle(member, texts, "h", units.refine)
    label = reduce(DataFrame.union, found).select(F.col("ka").alias("ga"), F.col("kb").alias("gb"), *_FIRST)
    labelled = classes.join(label, (F.col("ka") == F.col("ga")) & (F.col("kb") == F.col("gb")), "left").select(
        "ka", "kb", *(F.when(F.col("ga").isNull(), classes[own]).otherwise(label[of]).alias(of) for own, of in zip(("no_id", "doc_id", "h"), _FIRST, strict=True))
    )
    out = rows.join(labelled, ["ka", "kb"], "left")
    alone = F.col("n") == 0
    out = saved(
        out.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(alone, F.col("doc_id")).when(~F.col("no_id"), F.col("first_id")).alias("component_id"),
            (alone | (F.col("h") == F.col("first_h")) & (F.col("no_id") | F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False)))).alias("kept"),
            "row",
        ),
        "jaccard",
    )
    for df in (rows, member, *units.held):
        drop_saved(df)
    release(docs.sparkSession)
    return out


class Units:
    """Exact comparison of candidate groups (column c of members), each on the texts of its sets."""

    COLS = ("node", "ka", "kb", "no_id", "doc_id", "h")

    def __init__(self, threshold: Fraction, width: int, unit_sets: int, unit_shingles: int):
        self.threshold, self.width, self.unit_sets, self.unit_shingles = threshold, width, unit_sets, unit_shingles
        self.held: list[DataFrame] = []

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(saved(df, name))
        return self.held[-1]

    def _dropped(self, df: DataFrame) -> None:
        self.held = [x for x in self.held if x is not df]
        drop_saved(df)

    def _compared(self, cells: DataFrame, shingles: int, final: bool) -> DataFrame:
        """Cells have unit, l, r, component, text and COLS."""
        tasks = max(8, -(-shingles // TASK))
        rows = cells.withColumn("task", F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(tasks)))
        out = self._saved(rows.groupBy("task").applyInArrow(_compare(self.threshold, self.width, final), _FINAL if final else "a long, b long"), "compared")
        release(rows.sparkSession)  # the texts that were dealt to the tasks
        return out

    def settle(self, member: DataFrame, texts: DataFrame, on: str, further) -> list[DataFrame]:
        """First rows of the components: groups of one unit are compared here, larger ones go ``further``.

        The texts of all members are picked once, with what is to be known of their groups.
        """
        sizes = member.groupBy("c").agg(F.count("*").alias("sets"), F.sum("n").alias("words"), F.min("node").alias("low"), F.max("node").alias("high"))
        parts = F.ceil(F.greatest(F.col("sets") / self.unit_sets, F.col("words") / self.unit_shingles)).cast("int")
        sizes = self._saved(sizes.withColumn("parts", parts).withColumnRenamed("c", "c2"), "sizes")
        total = sizes.agg(F.sum(F.when(F.col("parts") == 1, F.col("words"))).alias("small"), F.sum(F.when(F.col("parts") > 1, F.col("words"))).alias("large")).first()
        dealt = member.join(sizes.drop("sets", "words"), F.col("c") == F.col("c2")).drop("c2")
        rows = self._saved(texts.join(dealt, on), "grouped")
        release(rows.sparkSession)
        small = rows.where("parts = 1").select(F.col("c").alias("unit"), F.col("node").alias("component"), F.lit(True).alias("l"), F.lit(True).alias("r"), "text", *self.COLS)
        found = [self._compared(small, total.small or 0, True)]
        if total.large:
            found += further(rows.where("parts > 1"), total.large)
        self._dropped(rows)
        return found

    def refine(self, large: DataFrame, shingles: int) -> list[DataFrame]:
        """Large groups in finer ones: joined only where sizes and sketches of sets with a common signature allow a link.

        Signatures go to their buckets without sketches first; a set brings its sketch only to buckets in which another set shares a signature with it.
        """
        spark = large.sparkSession
        buckets = max(8, min(1 << 16, -(-shingles // (BUCKET * TURNS))))
        held = []
        for turn in range(TURNS):
            packed = large.select("text", "node", "ka", "kb").mapInArrow(_emit_large(self.threshold, self.width, buckets, turn), "bucket int, nodes binary, sizes binary, marks binary, sigs binary")
            held.append(self._saved(packed.groupBy("bucket").applyInArrow(_shared_signatures, "node long, n long, mark binary, sigs binary"), "shared"))
            release(spark)
        shared = reduce(DataFrame.union, held)
        entries = (shared.agg(F.sum(F.octet_length("sigs"))).first()[0] or 0) // 8
        buckets = max(8, min(1 << 16, -(-entries // SKETCHED)))
        sigs = shared.where("sigs is not null").groupBy("node").agg(F.collect_list("sigs").alias("sigs"))
        marks = held[0].where("mark is not null").select("node", "n", "mark").dropDuplicates(["node"])
        dealt = marks.join(sigs, "node").select("node", "n", "mark", "sigs").mapInArrow(_emit_sketched(buckets), "bucket int, nodes binary, sizes binary, marks binary, sigs binary")
        group = components(dealt.groupBy("bucket").applyInArrow(_plausible(self.threshold), "a long, b long"), folded=True)
        for df in held:
            self._dropped(df)
        release(spark)
        finer = large.drop("c", "parts", "low", "high", "text").join(group, F.col("node") == F.col("id")).drop("id").withColumnRenamed("component", "c")
        return self.settle(self._saved(finer, "finer"), large.select("node", "text"), "node", self.compare_parts)

    def compare_parts(self, large: DataFrame, shingles: int) -> list[DataFrame]:
        """Groups of several parts: each part for itself with two common sets, then what is not in a group's main component with all others."""
        cols = (*self.COLS, "text")
        big = large.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        common = (F.col("node") == F.col("low")) | (F.col("node") == F.col("high"))
        dealt = big.withColumn("part", F.explode(F.when(common, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
        links = self._compared(dealt.select(F.xxhash64("c", "part").alias("unit"), F.col("node").alias("component"), F.lit(True).alias("l"), F.lit(True).alias("r"), *cols), shingles, False)
        rows = big.drop("text").join(components(links), F.col("node") == F.col("id"), "left").drop("id").withColumn("component", F.coalesce("component", "node"))
        rows = self._saved(rows, "named")
        many = rows.groupBy("c", "component").agg(F.count("*").alias("k"))
        main = many.groupBy("c").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
        main = main.withColumn("pieces", F.ceil((F.col("all") - F.col("most")) / self.unit_sets).cast("int")).where("pieces > 0").select(F.col("c").alias("c2"), "main", "pieces")
        main = self._saved(main, "main")
        open_ = rows.join(main, F.col("c") == F.col("c2")).drop("c2")
        rest = open_.where("component <> main").withColumn("piece", F.pmod(F.xxhash64("node", F.lit(5)), F.col("pieces")).cast("int"))
        x = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("l", F.lit(True)).withColumn("r", F.lit(False))
        y = open_.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("l", F.lit(False)).withColumn("r", F.lit(True))
        cells = x.unionByName(y).select(F.xxhash64("c", "piece", "part").alias("unit"), "l", "r", "component", *self.COLS)
        cells = cells.join(large.select("node", "text"), "node")
        more = self._compared(cells, shingles * max(1, main.agg(F.max("pieces")).first()[0] or 1), False)
        done = rows.drop("component").join(components(links.union(more)), F.col("node") == F.col("id"), "left").withColumn("component", F.coalesce("component", "node"))
        least = done.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "h")).alias("first"))
        return [self._saved(done.select("ka", "kb", "component").join(least, "component").select("ka", "kb", "first.*").toDF("ka", "kb", *_FIRST), "large-found")]
