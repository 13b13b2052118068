"""Interpolated modified Kneser-Ney model of any order from 2 on: counted in Spark, kept as sorted hash arrays that workers map into memory."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import drop_saved, fresh, release, saved
from ..sources.files import map_file, put_file

END = int(arrays.mix64(np.array([0x656E64], np.uint64))[0])
#: Tokens that a task holds before it hands counts on, and those of a bucket.
FLUSH, BUCKET = 1 << 21, 1 << 21
#: Bytes of buckets that a worker keeps where the shared folder can't be mapped.
KEPT = 256 << 20


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' tokens (words with A-Z as a-z, then the end), and where each document's begin."""
    low = arrays.LOWER[data]
    starts, ends, at = arrays.words(low, off)
    n = len(off) - 1
    out = np.full(len(starts) + n, np.uint64(END))
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(at))] = arrays.word_hashes(low, starts, ends)
    return out, at + np.arange(n + 1)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class Keys:
    """Sorted 64-bit keys, kept as their low 32 bits and where each value of the high ones begins."""

    def __init__(self, high: np.ndarray, begin: np.ndarray, low: np.ndarray):
        self.high, self.begin, self.low = high, begin, low

    def __len__(self) -> int:
        return len(self.low)

    @staticmethod
    def split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        high = key >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1]))) if len(key) else np.zeros(0, np.int64)
        return high[begin], begin.astype(np.int64), key.astype(np.uint32)

    def all(self) -> np.ndarray:
        return (np.repeat(self.high, np.diff(np.append(self.begin, len(self.low)))) << np.uint64(32)) | self.low

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of ascending keys, -1 where there is none: binary search in the range of the high bits, all keys step by step."""
        high, low = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.high, high), max(0, len(self.high) - 1))
        out = np.full(len(key), -1, np.int64)
        if not len(self.low):
            return out
        hit = np.flatnonzero(self.high[at] == high)
        at, low = at[hit], low[hit]
        a, b = self.begin[at], np.append(self.begin[1:], len(self.low))[at]
        end = b.copy()
        for _ in range(int((b - a).max(initial=0)).bit_length()):
            mid = (a + b) >> 1
            less = (a < b) & (self.low[np.minimum(mid, len(self.low) - 1)] < low)
            b = np.where(less, b, mid)
            a = np.where(less, mid + 1, a)
        found = a < end
        found[found] = self.low[a[found]] == low[found]
        out[hit[found]] = a[found]
        return out

    def take(self, at: np.ndarray) -> np.ndarray:
        return (self.high[np.searchsorted(self.begin, at, side="right") - 1] << np.uint64(32)) | self.low[at]


class Small:
    """Counts of one or more columns in a byte each; rows with a larger one stand apart."""

    def __init__(self, low: np.ndarray, row: np.ndarray, value: np.ndarray):
        self.low, self.row, self.value = low, row, value

    @staticmethod
    def split(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = c.reshape(len(c), -1)
        row = np.flatnonzero((c > 254).any(axis=1))
        low = np.minimum(c, 254).astype(np.uint8)
        low[row] = 255
        return low, row.astype(np.int64), c[row].astype(np.int64)

    def take(self, at: np.ndarray) -> np.ndarray:
        out = self.low[at].astype(np.int64)
        large = np.flatnonzero(out[:, 0] == 255)
        if len(large):
            out[large] = self.value[np.searchsorted(self.row, at[large])]
        return out


def _put(path: str, *parts: np.ndarray) -> None:
    """Arrays with a line of their lengths in front (each begins at a multiple of 8 bytes)."""
    sizes = np.array([len(parts), *(p.nbytes for p in parts)], np.int64)
    put_file(path, sizes, *(np.ascontiguousarray(p).tobytes() + bytes(-p.nbytes % 8) for p in parts))


def _parts(path: str) -> tuple[list[np.ndarray], int]:
    """The arrays of ``_put`` as bytes, and how much memory they take (0: mapped)."""
    raw = map_file(path)
    n = int(raw[:8].view(np.int64)[0])
    sizes = raw[8 : 8 + 8 * n].view(np.int64).tolist()
    out, at = [], 8 + 8 * n
    for size in sizes:
        out.append(raw[at : at + size])
        at += size + -size % 8
    return out, 0 if isinstance(raw, np.memmap) else raw.nbytes


@dataclass
class Model:
    """Where the arrays lie, and the figures of the whole corpus.

    Ids of words and of grams of k words count through the buckets of level k.  A gram's key
    is its context's id (of level k - 1) before its last word's id; the context that has only
    marks of the beginning has the id after the last one.
    """

    folder: str
    buckets: int
    order: int
    total: int  # training tokens
    sizes: list[list[int]] = field(default_factory=list)  # grams of each bucket, by level
    hot: list[np.ndarray] = field(default_factory=list)  # by level, sorted ids of the contexts whose grams are dealt by the whole gram
    hot_stats: list[np.ndarray] = field(default_factory=list)
    followed: list[set[int]] = field(default_factory=list)  # by level, buckets that have contexts
    discounts: list[list[float]] = field(default_factory=list)  # by level
    continuations: int = 0
    rest: float = 1.0  # mass of the unigrams that goes to the uniform distribution

    @property
    def size(self) -> int:
        return sum(self.sizes[0])

    @property
    def shift(self) -> np.uint64:
        return np.uint64(self.size.bit_length())

    def __post_init__(self):
        self._held: dict[tuple, tuple] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._held = {}

    def part(self, kind: str, k: int, b: int):
        """A bucket of level k: words (hashes, counts), grams (Keys), counts (of the highest level, else continuations), contexts (total, ones, twos, more)."""
        at = (kind, k, b)
        if at in self._held:
            found, _ = self._held[at] = self._held.pop(at)  # now the last used
            return found
        n = self.sizes[k - 1][b]
        if not n or kind == "contexts" and b not in self.followed[k - 1]:
            none = np.zeros(0, np.int64)
            found, size = (np.zeros(0, np.uint64), none) if kind == "words" else Keys(none.astype(np.uint64), none, none.astype(np.uint32)) if kind == "grams" else Small(np.zeros((n, 4 if kind == "contexts" else 1), np.uint8), none, none), 0
        else:
            raw, size = _parts(f"{self.folder}/{kind}-{k}-{b}")
            if kind == "words":
                found = raw[0].view(np.uint64), raw[1].view(np.int64)
            elif kind == "grams":
                found = Keys(raw[0].view(np.uint64), raw[1].view(np.int64), raw[2].view(np.uint32))
            else:
                m = 4 if kind == "contexts" else 1
                found = Small(raw[0].reshape(n, m), raw[1].view(np.int64), raw[2].view(np.int64).reshape(-1, m))
        self._held[at] = found, size
        while sum(s for _, s in self._held.values()) > KEPT and len(self._held) > 1:
            self._held.pop(next(iter(self._held)))
        return found

    def first_id(self, k: int) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes[k - 1])))

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted hashes (-1: not in the training tokens), and training counts."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        first = self.first_id(1)
        cut = np.searchsorted(_bucket(h, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = h[cut[b] : cut[b + 1]]
            words, n = self.part("words", 1, b)
            if len(words):
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                hit = words[at] == own
                ids[cut[b] : cut[b + 1]][hit] = first[b] + at[hit]
                counts[cut[b] : cut[b + 1]][hit] = n[at[hit]]
        return ids, counts

    def keys(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (context.astype(np.uint64) << self.shift) | word.astype(np.uint64)

    def before(self, k: int, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The context of k words of every token, from the grams of k words that end at the tokens."""
        out = np.empty(len(ids), np.int64)
        out[1:] = ids[:-1]
        out[begin] = sum(self.sizes[k - 1])
        return out

    def deal(self, k: int, key: np.ndarray) -> np.ndarray:
        """Bucket of each gram of level k: its context's, or by the whole gram where the context is hot."""
        context = (key >> self.shift).astype(np.int64)
        out = np.searchsorted(self.first_id(k - 1), context, side="right") - 1
        hot = np.isin(context, self.hot[k - 2])
        out[hot] = _bucket(arrays.mix64(key[hot]), self.buckets)
        return out

    def find(self, k: int, key: np.ndarray) -> np.ndarray:
        """Ids of the grams of level k with different keys (-1: not in the training tokens)."""
        out = np.full(len(key), -1, np.int64)
        of, first = self.deal(k, key), self.first_id(k)
        rank = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[rank], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = rank[cut[b] : cut[b + 1]]
            at = self.part("grams", k, b).find(key[own])
            out[own] = np.where(at >= 0, first[b] + at, -1)
        return out

    def column(self, kind: str, k: int, ids: np.ndarray) -> np.ndarray:
        """Rows of grams, counts or contexts of ids; 0 for -1 and for the mark of the beginning."""
        out = np.zeros((len(ids), 4) if kind == "contexts" else len(ids), np.uint64 if kind == "grams" else np.int64)
        order, first = np.argsort(ids, kind="stable"), self.first_id(k)
        cut = np.searchsorted(ids[order], first)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[b] : cut[b + 1]]
            found = self.part(kind, k, b).take(ids[own] - first[b])
            out[own] = found[:, 0] if kind == "counts" else found
        return out

    def follow(self, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What follows contexts of level k: total (0: nothing), and the share that goes to the level below."""
        stats = self.column("contexts", k, ids)
        hot = np.isin(ids, self.hot[k - 1])
        stats[hot] = self.hot_stats[k - 1][np.searchsorted(self.hot[k - 1], ids[hot])]
        total = stats[:, 0]
        return total, np.where(total > 0, (stats[:, 1:] @ np.array(self.discounts[k])) / np.maximum(total, 1), 1.0)

    def suffix(self, k: int, key: np.ndarray) -> np.ndarray:
        """Ids (level k - 1) of grams of level k without their first words."""
        word = (key & ((np.uint64(1) << self.shift) - np.uint64(1))).astype(np.int64)
        if k == 2:
            return word
        context, back = np.unique((key >> self.shift).astype(np.int64), return_inverse=True)
        end = sum(self.sizes[k - 2])
        short = np.full(len(context), sum(self.sizes[k - 3]), np.int64)
        some = context < end
        short[some] = self.suffix(k - 1, self.column("grams", k - 1, context[some]))
        key, back = np.unique(self.keys(short[back], word), return_inverse=True)
        return self.find(k - 1, key)[back]

    def write_contexts(self, k: int, b: int, key: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Writes the contexts of a bucket from the grams of level k in it; what it has of hot contexts."""
        context = (key >> self.shift).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        stats = np.stack([np.add.reduceat(x, begin, dtype=np.int64) for x in (c, c == 1, c == 2, c > 2)], axis=1)
        context, hot = context[begin], self.hot[k - 2]
        is_hot = np.isin(context, hot)
        table = np.zeros((self.sizes[k - 2][b], 4), np.int64)
        table[context[~is_hot] - self.first_id(k - 1)[b]] = stats[~is_hot]
        if len(table):
            _put(f"{self.folder}/contexts-{k - 1}-{b}", *Small.split(table))
        rows = np.zeros((len(hot), 4), np.int64)
        rows[np.searchsorted(hot, context[is_hot])] = stats[is_hot]
        return rows

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: tokens, known tokens, base score, and log10 probability."""
        tok, at = tokens(data, off)
        begin = at[:-1]
        word, back = np.unique(tok, return_inverse=True)
        ids, counts = self.ids(word)
        base = np.log10((counts + 0.5) / (self.total + 0.5 * (self.size + 1)))
        low = self.rest / (self.size + 1) + _discounted(self.column("counts", 1, ids), self.discounts[0]) / max(1, self.continuations)
        p, own = low[back], ids[back]
        gram, gram_back = ids, back  # the different grams of the level below that end at tokens, and which ends where
        for k in range(2, self.order + 1):
            gram = np.append(gram, sum(self.sizes[k - 2]))
            total, share = self.follow(k - 1, gram)
            left = self.before(k - 1, gram_back, begin)
            left[begin] = len(gram) - 1
            p *= share[left]
            may = np.flatnonzero((gram[left] >= 0) & (own >= 0) & (total[left] > 0))
            key, key_back = np.unique(self.keys(gram[left[may]], own[may]), return_inverse=True)
            gram = self.find(k, key)
            p[may] += _discounted(self.column("counts", k, gram), self.discounts[k - 1])[key_back] / total[left[may]]
            gram_back = np.full(len(tok), len(gram), np.int64)
            gram_back[may] = key_back
            gram = np.append(gram, -1)
        return np.diff(at), np.add.reduceat((counts > 0)[back].astype(np.int64), begin), np.add.reduceat(base[back], begin), np.add.reduceat(np.log10(p), begin)


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def discounts(n: list[int]) -> list[float]:
    """The three discounts of modified Kneser-Ney from how many counts are 1, 2, 3 and 4; where one of these is none, half the count; never below 0.01, so that unseen words keep some mass."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k
        out.append(min(max(d, 0.01), k))
    return out


def _counts_of(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _packed(buckets_of, schema: list[str]):
    """Rows for each bucket: what was counted once, and what more often with its count."""

    def pack(values: np.ndarray, of: np.ndarray):
        rank = np.argsort(of, kind="stable")
        values, of = values[rank], of[rank]
        cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
        rows = []
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(of)).tolist(), strict=False):
            v, n = np.unique(values[a:b], return_counts=True)
            rows.append((int(of[a]), arrays.pack_sorted(v[n == 1]), arrays.pack_sorted(v[n > 1]), arrays.pack_counts(n[n > 1])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                got = buckets_of(*arrays.buffers(part.column("text")))
                held.append(got)
                size += len(got[0])
                if size >= FLUSH:
                    packed = pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
                    arrays.trim()
                    yield packed
        if size:
            packed = pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
            arrays.trim()
            yield packed

    return run


def _merge(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a bucket in ascending order, and how often each was counted."""
    v, c = [], []
    for once, more, n in zip(frame["once"], frame["more"], frame["n"], strict=True):
        v += [arrays.unpack_sorted(once), arrays.unpack_sorted(more)]
        c += [np.ones(len(v[-2]), np.int64), arrays.unpack_counts(n)]
    v, c = np.concatenate(v), np.concatenate(c)
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    del order
    begin = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    v, c = v[begin], np.add.reduceat(c, begin) if len(begin) else c
    arrays.trim()
    return v, c


_PACKED = "bucket int, once binary, more binary, n binary"
_NAMES = ["bucket", "once", "more", "n"]


def train(docs: DataFrame, order: int = 2) -> Model:
    """Counts the texts of ``docs`` (null: empty): all words and all grams of 2 to ``order`` words, nothing pruned.

    Grouped passes.  Words: counts by hash range; files of sorted hashes.  Grams of each
    length (before a text stand order - 1 marks of the beginning): counts by the context's
    range, grams of hot contexts by the whole gram; files of sorted keys.  After each of
    these the continuations of the level below: how many different words stand before a
    gram.  The highest level goes by its counts, the others by continuations.  Tasks combine
    counts before they send them, packed.  The driver sees a row for each bucket.  A gram's
    key takes 64 bits: more contexts and words than fit these, or more than 2^32 words, raise ValueError.
    """
    if order < 2:
        raise ValueError("order is at least 2")
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    folder = fresh(docs.sparkSession, "ngram")
    # about the number of tokens; it only sets how many buckets there are
    most = docs.agg(F.sum(F.octet_length("text") / 6 + 1)).first()[0] or 0
    buckets = max(4, -(-int(most) // BUCKET))

    def words(data, off):
        tok = tokens(data, off)[0]
        return tok, _bucket(tok, buckets)

    def often(c: np.ndarray) -> bytes:
        return np.flatnonzero(c * 8 * buckets > max(1, most)).tobytes()

    def put_words(frame: pd.DataFrame) -> pd.DataFrame:
        v, c = _merge(frame)
        b = int(frame["bucket"].iat[0])
        _put(f"{folder}/words-1-{b}", v, c)
        return pd.DataFrame({"bucket": [b], "size": [len(v)], "total": [int(c.sum())], "hot": [often(c)]})

    model = Model(folder, buckets, order, 0, discounts=[[]] * order)

    def add_level(heads) -> None:
        """Sizes and hot contexts of a level; the last id is the mark of the beginning, which is always hot."""
        sizes = [0] * buckets
        for r in heads:
            sizes[r.bucket] = r.size
        model.sizes.append(sizes)
        first = np.concatenate(([0], np.cumsum(sizes)))
        model.hot.append(np.unique(np.concatenate([*(np.frombuffer(r.hot, np.int64) + first[r.bucket] for r in heads), first[-1:]])))

    def add_contexts(k: int, heads) -> None:
        """What is to be known of the counts of level k on the driver."""
        model.hot_stats[k - 2] = sum((np.frombuffer(r.stats, np.int64).reshape(-1, 4) for r in heads), np.zeros((len(model.hot[k - 2]), 4), np.int64))
        model.followed[k - 2] = {r.bucket for r in heads}

    done = saved(docs.mapInArrow(_packed(words, _NAMES), _PACKED).groupBy("bucket").applyInPandas(put_words, "bucket int, size long, total long, hot binary"), "ngram-words").collect()
    add_level(done)
    model.total = sum(r.total for r in done)
    model.hot_stats, model.followed = [np.zeros((0, 4), np.int64)] * (order - 1), [set()] * (order - 1)
    release(docs.sparkSession)

    for k in range(2, order + 1):
        if sum(model.sizes[k - 2]).bit_length() + int(model.shift) > 64:
            raise ValueError("more contexts and words than 64-bit keys")

        def grams(data, off):
            tok, at = tokens(data, off)
            word, back = np.unique(tok, return_inverse=True)
            ids = model.ids(word)[0][back]
            context = model.before(1, ids, at[:-1])
            for j in range(2, k):
                key, back = np.unique(model.keys(context, ids), return_inverse=True)
                context = model.before(j, model.find(j, key)[back], at[:-1])
            key = model.keys(context, ids)
            return key, model.deal(k, key)

        def put_grams(frame: pd.DataFrame) -> pd.DataFrame:
            b = int(frame["bucket"].iat[0])
            key, c = _merge(frame)
            _put(f"{folder}/grams-{k}-{b}", *Keys.split(key))
            stats = b""
            if k == order:
                _put(f"{folder}/counts-{k}-{b}", *Small.split(c))
                stats = model.write_contexts(k, b, key, c).tobytes()
            rows = [(0, b, len(key), often(c) if k < order else b"", stats, np.array(_counts_of(c), np.int64).tobytes())]
            del c
            arrays.trim()
            short, n = np.unique(model.suffix(k, key), return_counts=True)
            first = model.first_id(k - 1)
            cut = np.searchsorted(short, first)
            for a in np.flatnonzero(np.diff(cut)).tolist():
                x, m = short[cut[a] : cut[a + 1]] - first[a], n[cut[a] : cut[a + 1]]
                rows.append((1, a, 0, arrays.pack_sorted(x[m == 1]), arrays.pack_sorted(x[m > 1]), arrays.pack_counts(m[m > 1])))
            return pd.DataFrame(rows, columns=["kind", "bucket", "size", "hot", "stats", "n"])

        got = saved(docs.mapInArrow(_packed(grams, _NAMES), _PACKED).groupBy("bucket").applyInPandas(put_grams, "kind int, bucket int, size long, hot binary, stats binary, n binary"), f"ngram-{k}")
        heads = got.where("kind = 0").collect()
        add_level(heads)
        if k == order:
            add_contexts(k, heads)
            model.discounts[k - 1] = discounts(sum((np.frombuffer(r.n, np.int64) for r in heads), np.zeros(4, np.int64)).tolist())
        release(docs.sparkSession)

        def put_continuations(frame: pd.DataFrame) -> pd.DataFrame:
            b = int(frame["bucket"].iat[0])
            out = np.zeros(model.sizes[k - 2][b], np.int64)
            for x, y, n in zip(frame["hot"], frame["stats"], frame["n"], strict=True):
                out[arrays.unpack_sorted(x).astype(np.int64)] += 1
                out[arrays.unpack_sorted(y).astype(np.int64)] += arrays.unpack_counts(n)
            _put(f"{folder}/counts-{k - 1}-{b}", *Small.split(out))
            stats = model.write_contexts(k - 1, b, model.part("grams", k - 1, b).all(), out).tobytes() if k > 2 else b""
            return pd.DataFrame({"bucket": [b], "total": [int(out.sum())], "n": [[*_counts_of(out), int((out > 2).sum())]], "stats": [stats]})

        cont = saved(got.where("kind = 1").groupBy("bucket").applyInPandas(put_continuations, "bucket int, total long, n array<long>, stats binary"), f"ngram-cont-{k - 1}").collect()
        drop_saved(got)
        n = np.array([r.n for r in cont], np.int64).sum(axis=0) if cont else np.zeros(5, np.int64)
        d = model.discounts[k - 2] = discounts(n[:4].tolist())
        if k > 2:
            add_contexts(k - 1, cont)
        elif cont:
            model.continuations = sum(r.total for r in cont)
            model.rest = float((d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / model.continuations)
        release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) to every row; a null text scores as an empty one, its end alone.

    A column named like an added one is replaced; an empty table gives no rows.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*set(added) - {text})

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, text, 2 * arrays.SLICE_BYTES):
                n, known, base, own = model.score(*arrays.buffers(part.column(text)))
                more = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.total), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *added])
        arrays.trim()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
