"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel works on a whole Arrow string column at once: the UTF-8 bytes as one
``uint8`` array plus document offsets.  Nothing here loops over characters in Python,
so a worker spends tens of nanoseconds a byte.  ``slices`` bounds the memory of a batch.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

#: Whitespace of every word contract here: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same as a Java and Python pattern.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: A word longer than this is hashed by BLAKE2 instead of byte by byte.
LONG_WORD = 64
#: Bytes of text that a kernel takes at once.
SLICE_BYTES = 2 << 20


def apart(least: int = 1 << 20) -> None:
    """From here on arrays of a megabyte or more get pages of their own and go back to the system as soon as they are freed; else freed ones up to 32 MB stay in a heap with holes."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, least)  # -3: M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def trim() -> None:
    """Gives memory that a batch no longer needs back to the system; a worker keeps it else until it ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


#: A random 64-bit code for every byte value.
BYTE_CODE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cuts a batch into runs of rows whose texts have about ``most`` bytes together (a longer text stands alone)."""
    text = batch.column(column)
    size = np.diff(buffers(text)[1]) if len(text) else np.zeros(0, np.int64)
    at, n = 0, len(size)
    total = np.concatenate(([0], np.cumsum(size)))
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all documents (U+FFFD for what is not valid), and their offsets."""
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) == lead[-1]:
        return cp, lead[off]
    # not valid UTF-8: each document for itself
    parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off[:-1], off[1:], strict=True)]
    return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document where its words begin (one more than documents)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    solid = ~SPACE[data]
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~solid[:-1]
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~solid[1:]
    first[off[:-1][off[:-1] < n]] = True
    last[off[1:][off[1:] > 0] - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    size = ends - starts
    out = size.astype(np.uint64)
    at = np.arange(len(starts))
    for j in range(int(min(size.max(initial=0), LONG_WORD))):
        at = at[size[at] > j] if j else at
        out[at] = out[at] * _BASE + BYTE_CODE[data[starts[at] + j]]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix64(out)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each position (``len(data) - width + 1`` of them)."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    code, have = BYTE_CODE[data], 1
    total, done = None, 0
    left = width
    # binary method: hashes of 1, 2, 4, ... bytes, joined for the bits of width
    while left:
        if left & 1:
            if total is None:
                total, done = code, have
            else:
                n = min(len(total), len(code) - done)
                total = total[:n] * _BASE + (code[done : done + n] ^ (code[done : done + n] >> np.uint64(29)))
                done += have
        left >>= 1
        if left:
            n = len(code) - have
            code = (code[:n] ^ (code[:n] >> np.uint64(31))) * _BASE + code[have : have + n]
            have *= 2
    return mix64(total[: len(data) - width + 1])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] ... starts[i] + counts[i] - 1 for every i, one after the other."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin - starts, counts)


def pack_sorted(v: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane: the higher planes are nearly all zero, so that block compression takes them away."""
    v = v.astype(np.uint64)
    step = np.diff(v, prepend=np.uint64(0))
    return step.astype("<u8").view(np.uint8).reshape(len(v), 8).T.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    """The numbers of ``pack_sorted``."""
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Numbers in 64 bits, plane by plane."""
    return n.astype("<u8").view(np.uint8).reshape(len(n), 8).T.tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)
