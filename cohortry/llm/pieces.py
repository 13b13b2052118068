"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and exact decoding."""

from __future__ import annotations

import hashlib
import math
import os
import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from . import arrays

MARK = "▁"  # stands for a space in pieces
#: As in the library: an unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Segments a worker remembers.
CACHE = 1 << 18

arrays.apart()  # in every worker of this operator


def default_model() -> str:
    """The public vocabulary of the installed package, in the place that every worker has it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 5:
            yield key >> 3, data[at : at + 4]
            at += 4
        elif kind == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        else:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    """Pieces, scores and types of a model file (types: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte)."""

    pieces: list[str]
    scores: list[float]
    types: list[int]

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Reads a model file.  Unigram scores are taken as they are.  A BPE file holds merge
        ranks, not log-probabilities; its normal pieces get Zipf's: -ln(rank * H), ranks in
        file order from 1, H the harmonic number of their count."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, types, kind = [], [], [], 1
        for n, v in _fields(data):
            if n == 1:
                piece, score, typ = "", 0.0, 1
                for m, x in _fields(v):
                    if m == 1:
                        piece = x.decode()
                    elif m == 2:
                        score = struct.unpack("<f", x)[0]
                    elif m == 3:
                        typ = x
                pieces.append(piece)
                scores.append(score)
                types.append(typ)
            elif n == 2:
                kind = dict(_fields(v)).get(3, 1)
            elif n == 3:
                spec = dict(_fields(v))
                if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
                    raise ValueError("only models that keep the text as it is (identity normaliser, space before it) can be decoded exactly")
        if sum(t == 6 for t in types) != 256:
            raise ValueError("the model has no byte pieces, so unknown characters could not be decoded")
        if kind == 2:
            normal = [i for i, t in enumerate(types) if t in (1, 4)]
            h = sum(1 / r for r in range(1, len(normal) + 1))
            for r, i in enumerate(normal, 1):
                scores[i] = -math.log(r * h)
        return cls(pieces, scores, types)

    @cached_property
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types, strict=True)):
            if t in (1, 4):
                a.add_word(p, (len(p), s, i))
        a.make_automaton()
        return a

    @cached_property
    def unknown(self) -> float:
        return min(s for s, t in zip(self.scores, self.types, strict=True) if t in (1, 4)) - UNKNOWN_PENALTY

    @cached_property
    def byte_id(self) -> list[int]:
        at = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == 6}
        return [at[f"<0x{b:02X}>"] for b in range(256)]

    @cached_property
    def characters(self) -> set[str]:
        return set("".join(self.pieces))

    def absent(self, text: str) -> str:
        """A character that neither the text nor a piece has."""
        return next(c for c in map(chr, range(0x10FFFF, 0xE000, -1)) if c not in text and c not in self.characters)

    @cached_property
    def splits_at_marks(self) -> bool:
        """Whether no piece has the mark after another character: then best paths of the runs ``MARK+ other*`` join to the best path."""
        return not any(MARK in p.lstrip(MARK) for p, t in zip(self.pieces, self.types, strict=True) if t in (1, 4))

    def viterbi(self, text: str, literal: str = "") -> list[int]:
        """Ids of the best path over ``text`` (marks for spaces).

        The automaton gives at each position every piece that ends there, longest first, along
        its output links; each relaxes the best score there, and of equal scores the longest
        piece stays.  A character that is no piece is spelt in byte pieces, as is
        ``literal`` (a stand-in for the mark itself in the text).
        """
        n = len(text)
        best, piece, size = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        at = 0  # ends below this are settled

        def settle(upto: int) -> None:
            nonlocal at
            while at < upto:
                at += 1
                if not single[at]:
                    s = best[at - 1] + self.unknown
                    if not size[at] or s > best[at]:
                        best[at], piece[at], size[at] = s, -1, 1

        single = bytearray(n + 1)
        for end, (k, score, i) in self.automaton.iter(text):
            end += 1
            if end > at + 1:
                settle(end - 1)
            s = best[end - k] + score
            if not size[end] or s > best[end]:
                best[end], piece[end], size[end] = s, i, k
            if k == 1:
                single[end] = 1
        settle(n)
        out, end = [], n
        while end:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                c = text[end - 1]
                out += [self.byte_id[b] for b in reversed((MARK if c == literal else c).encode("utf-8", "surrogatepass"))]
            end -= size[end]
        out.reverse()
        return out

    @cached_property
    def surface(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces, one after the other; where each begins; how many it has."""
        texts = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t in (2, 3, 5) else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        size = np.array([len(t) for t in texts], np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


class Codec:
    """Encodes and decodes whole Arrow columns; remembers the best paths of segments."""

    def __init__(self, model: PieceModel):
        self.model, self.cache = model, {}

    def _ids(self, raw: bytes, first: bool) -> bytes:
        """Ids of a segment, four bytes each."""
        key = raw + b"\xff" if first else raw  # a byte that no text has
        got = self.cache.get(key)
        if got is None:
            text = raw.decode("utf-8", "surrogatepass")
            stand_in = self.model.absent(text) if MARK in text else ""
            text = (MARK if first else "") + text.replace(MARK, stand_in or MARK).replace(" ", MARK)
            got = np.array(self.model.viterbi(text, stand_in), np.int32).tobytes()
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[key] = got
        return got

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and their offsets."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        full = off[:-1][np.diff(off) > 0]
        begin = np.zeros(n, bool)
        if self.model.splits_at_marks:
            space = data == 0x20
            begin[1:] = space[1:] & ~space[:-1]
        begin[full] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        first = np.zeros(n, bool)
        first[full] = True
        first = first[starts]
        code = arrays.word_hashes(data, starts, ends) ^ np.where(first, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        _, at, back = np.unique(code, return_index=True, return_inverse=True)
        raw = data.tobytes()
        own = [self._ids(raw[s:e], f) for s, e, f in zip(starts[at].tolist(), ends[at].tolist(), first[at].tolist(), strict=True)]
        size = np.array([len(x) // 4 for x in own], np.int64)
        flat = np.frombuffer(b"".join(own), np.int32)
        count = size[back]
        ids = flat[arrays.ranges((np.cumsum(size) - size)[back], count)]
        total = np.concatenate(([0], np.cumsum(count)))
        return ids, total[np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents, and their offsets; the space that stands before each text is gone."""
        flat, begin, size = self.model.surface
        count = size[ids]
        out = flat[arrays.ranges(begin[ids], count)]
        total = np.concatenate(([0], np.cumsum(count)))[off]
        full = total[:-1][np.diff(total) > 0]
        lead = full[out[full] == 0x20]
        keep = np.ones(len(out), bool)
        keep[lead] = False
        gone = np.concatenate(([0], np.cumsum(~keep)))
        return out[keep], total - gone[total]


_held: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _held:
        _held[path] = Codec(PieceModel.load(path if os.path.isabs(path) else SparkFiles.get(path)))
    return _held[path]


def encode(df: DataFrame, text: str, model: str | None = None, *, out: str = "pieces", verify: bool = False) -> DataFrame:
    """Adds ``out``: array<int>, the ids of the text's best path (null text: null; empty: none).

    ``model`` is a model file that every worker has under that path, or the name of one given
    to ``addFile``.  No row moves: documents are encoded where they are read, segment by
    segment, each different segment of a batch once.  With ``verify`` the ids are decoded
    again and ``decoded_sha256`` (of the decoded text) and ``exact`` (whether it is the text) are added.
    A column named like an added one is replaced; an empty table gives no rows; repeated rows
    and very long texts are encoded whole, each for itself.
    """
    path = model or default_model()
    extra = ", decoded_sha256 string, exact boolean" if verify else ""
    df = df.drop(*{out, *(("decoded_sha256", "exact") if verify else ())} - {text})

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            for part in arrays.slices(batch, text, arrays.SLICE_BYTES // 2):
                column = part.column(text)
                data, off = arrays.buffers(column)
                ids, at = codec.encode(data, off)
                null = column.is_null()
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=null)
                more = [lists]
                if verify:
                    back, b = codec.decode(ids, at)
                    raw = back.tobytes()
                    sha = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]
                    same = np.array_equal(back, data) and np.array_equal(b, off)
                    exact = [True] * len(sha) if same else [raw[s:e] == data[x:y].tobytes() for s, e, x, y in zip(b[:-1], b[1:], off[:-1], off[1:], strict=True)]
                    mask = null.to_numpy(zero_copy_only=False)
                    more += [pa.array(sha, pa.string(), mask=mask), pa.array(exact, pa.bool_(), mask=mask)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *([out, "decoded_sha256", "exact"][: len(more)])])
        arrays.trim()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{out}` array<int>{extra}")


def decode(df: DataFrame, pieces: str, model: str | None = None, *, out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text of the ids in column ``pieces`` (null: null); the exact inverse of ``encode``."""
    path = model or default_model()
    df = df.drop(*{out} - {pieces})

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            column = batch.column(pieces)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            raw, off = codec.decode(values, np.concatenate(([0], np.cumsum(size))).astype(np.int64))
            text = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())
            if column.null_count:
                text = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{out}` string")
