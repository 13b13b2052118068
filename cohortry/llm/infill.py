"""Fill-in-the-middle: texts cut at two unit borders and put together anew, prefix, suffix and middle marked."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a unit is: a code point; ``\X`` (grapheme), ``\w+\W*`` (word) or ``[^\n]*\n?`` (line) serve as well.
CODE_POINT = r"(?s:.)"
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
_end = methodcaller("end")


@dataclass(frozen=True)
class Markers:
    """What stands before prefix, suffix and middle.

    Each has a first character that none holds elsewhere, so that a marker can't be found
    across the border of a marker and a part that holds none: the parts are told apart for sure.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.all()
        if len(set(marks)) < 3 or not all(marks) or any(m[0] in x[1:] for m in marks for x in marks) or any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError(f"markers that can't be told apart: {marks}")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(key: str, seed: int, n: int = 4) -> list[int]:
    """The first ``n`` groups of eight hex digits of the digest of seed and key, as unsigned numbers."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(h[4 * i : 4 * i + 4], "big") for i in range(n)]


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """End offsets of all units, four bytes each."""
    return array("I", map(_end, unit.finditer(text)))


def cut(text: str, key: str, unit: regex.Pattern, marks: Markers, seed: int, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= plain_from or any(m in text for m in marks.all()):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (lo, hi))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"
    return n, "psm", a, b - a, f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"


def restore(output: str, form: str, marks: Markers = Markers()) -> str:
    """The text of an output, from output and form alone."""
    if form == "plain":
        return output
    first, second = (marks.prefix, marks.suffix) if form == "psm" else (marks.suffix, marks.prefix)
    head, _, middle = output.removeprefix(first).partition(marks.middle)
    left, _, right = head.partition(second)
    prefix, suffix = (left, right) if form == "psm" else (right, left)
    return prefix + middle + suffix


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogateescape")).hexdigest()


def fill_in_middle(text: Column, key: Column, *, unit: str = CODE_POINT, markers: Markers = Markers(), seed: int = 1, plain_from: int = 90, spm_below: int = 20, with_output: bool = True) -> Column:
    """A struct (``RESULT``) for each row of a text and a key (any type with a text form).

    The digest of seed and key draws two unit borders and the form.  n counts units;
    prefix_chars and middle_chars are code points, null for plain rows.  Plain stay empty
    texts, texts that hold a marker, and draws from ``plain_from`` of 100; below ``spm_below``
    of 100 the suffix stands first.  Whole texts of any length, four bytes a unit beside the
    text.  Null texts are empty ones, null keys the empty key; equal keys get equal draws, so
    repeated rows get equal results; where units leave gaps, what follows the last border is
    suffix.  A byte that is not UTF-8 counts as a code point of its own; as such bytes can't be
    shown, output is null then, the digests hold.  An empty table gives no rows.
    ``with_output`` False leaves output null, where the digests alone are asked for.
    """
    marks, pattern = markers, unit

    @F.pandas_udf(RESULT)
    def middle_filled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = regex.compile(pattern)
        for texts, keys in batches:
            rows = []
            for raw, k in zip(texts, keys, strict=True):
                t = b"" if raw is None else bytes(raw)
                t = t.decode("utf-8", "surrogateescape")
                n, form, a, m, out = cut(t, "" if k is None else k, units, marks, seed, plain_from, spm_below)
                sha = _digest(out)
                back = sha if form == "plain" else _digest(restore(out, form, marks))
                rows.append((n, form, a, m, out if with_output and out.isascii() | _shown(out) else None, sha, back))
            frame = pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")], dtype=object)
            for c in ("prefix_chars", "middle_chars"):
                frame[c] = frame[c].astype("Int64")
            yield frame.astype({"n": "int64"})

    return middle_filled(text.cast("binary"), key.cast("string"))


def _shown(text: str) -> bool:
    try:
        text.encode()
    except UnicodeEncodeError:  # bytes that were not UTF-8
        return False
    return True
