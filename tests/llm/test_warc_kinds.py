"""The salvage reader on plain, mixed and many-record archives with damage."""

import gzip
import hashlib
import random

from cohortry.llm import warc


def rec(i, body=None):
    body = body or random.Random(i).randbytes(3000).hex().encode()
    return warc.record(i, "u", body, hashlib.sha1(body).hexdigest(), None, "2000-01-01T00:00:00Z")


def ids(data):
    return [r[7] for r in warc.salvage("f", data) if r[3] == "record"]


def gaps(data):
    return [(r[1], r[2]) for r in warc.salvage("f", data) if r[3] == "gap"]


def test_plain_archive_with_gzip_body_and_damaged_first_line():
    first = bytearray(rec(0, gzip.compress(b"a page" * 50)))
    first[0] ^= 0xFF
    data = bytes(first) + rec(1) + rec(2)
    assert ids(data) == [1, 2] and gaps(data) == [(0, len(first))]


def test_mixed_archive():
    parts = [rec(0), gzip.compress(rec(1)), rec(2), b"junk", gzip.compress(rec(3)), rec(4)]
    data = b"".join(parts)
    assert ids(data) == [0, 1, 2, 3, 4] and gaps(data) == [(sum(map(len, parts[:3])), 4)]


def test_many_records_in_a_member():
    data = gzip.compress(b"".join(map(rec, range(4))))
    assert ids(data) == [0, 1, 2, 3] and gaps(data) == []
    bad = bytearray(rec(1))
    bad[-10] ^= 0xFF
    data = gzip.compress(rec(0) + bytes(bad) + rec(2))
    assert ids(data) == [0, 2] and gaps(data) == [(0, len(data))]


def test_inflated_part_of_a_damaged_member():
    whole = gzip.compress(b"".join(map(rec, range(6))))
    cut = whole[: len(whole) * 3 // 4]
    assert ids(cut + gzip.compress(rec(9))) == [0, 1, 2, 3, 9] and gaps(cut + gzip.compress(rec(9))) == [(0, len(cut))]
    assert ids(cut) == [0, 1, 2, 3] and gaps(cut) == [(0, len(cut))]


def test_stored_records_of_a_damaged_member_come_once():
    cut = gzip.compress(b"".join(map(rec, range(4))), 0)[:-3000]
    assert ids(cut) == [0, 1, 2]
