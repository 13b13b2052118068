"""Language ID by string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays

#: Symbols told apart; the first two stand for all others and for what is no letter.
SYMBOLS = 96
#: Documents in one matrix product.
BLOCK = 128
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x3000)], np.uint32)
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all documents, 0 for what is no letter, and their offsets."""
    cp, at = arrays.characters(data, off)
    low = cp.copy()
    small = cp < len(_LOWER)
    low[small] = np.where(_LETTER[cp[small]], _LOWER[cp[small]], 0)
    return low, at


@dataclass
class LanguageModel:
    """What scoring needs: symbol of each code point, column of each n-gram, and their folded kernel weights."""

    langs: list[str]
    points: np.ndarray  # sorted code points of the symbols from 2 on
    column: np.ndarray  # n-gram code -> column, -1 if no landmark has it
    weights: np.ndarray  # columns x languages
    bias: np.ndarray
    orders: int

    def grams(self, low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, column) of every n-gram that a landmark has."""
        i = np.searchsorted(self.points, low)
        i[i == len(self.points)] = 0
        sym = np.where(low == 0, 1, np.where(self.points[i] == low if len(self.points) else False, i + 2, 0)).astype(np.int64)
        return _grams(sym, at, self.orders, self.column)

    def decide(self, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One-versus-rest decisions: documents x languages."""
        n = len(at) - 1
        out = np.empty((n, len(self.langs)))
        for b in range(0, n, BLOCK):
            part = at[b : min(n, b + BLOCK) + 1]
            doc, col = self.grams(low[part[0] : part[-1]], part - part[0])
            x = np.zeros((len(part) - 1, self.weights.shape[0]), np.float32)
            x[doc, col] = 1
            size = x.sum(axis=1, keepdims=True)
            out[b : b + len(part) - 1] = x @ self.weights / np.sqrt(np.maximum(size, 1)) + self.bias
        return out


def _grams(sym: np.ndarray, at: np.ndarray, orders: int, column: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    docs, cols = [], []
    code, base = np.zeros(len(sym), np.int64), 0
    for n in range(1, orders + 1):
        if len(sym) < n:
            break
        code = sym if n == 1 else code[:-1] * SYMBOLS + sym[n - 1 :]
        ok = doc[: len(code)] == doc[n - 1 :]
        c = code + base
        if column is not None:
            c = column[c]
            ok &= c >= 0
        docs.append(doc[: len(code)][ok])
        cols.append(c[ok])
        base += SYMBOLS**n
    return (np.concatenate(docs), np.concatenate(cols)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit(texts: list[str], labels: list[str], *, landmarks: int = 40, ridge: float = 1e-2, orders: int = 3) -> LanguageModel | None:
    """Fits the model on the driver; the first ``landmarks`` texts of each language are the landmarks.  None if there is no text."""
    langs = sorted(set(labels))
    if not langs:
        return None
    y = np.array([langs.index(x) for x in labels])
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    low, at = code_points(data, np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    seen, count = np.unique(low[low > 0], return_counts=True)
    points = np.sort(seen[np.argsort(-count, kind="stable")[: SYMBOLS - 2]])
    column = np.full(sum(SYMBOLS**n for n in range(1, orders + 1)), -1, np.int32)
    model = LanguageModel(langs, points, np.arange(len(column), dtype=np.int32), np.zeros((0, 0)), np.zeros(len(langs)), orders)
    own: list[np.ndarray] = []  # n-grams of each text, once each
    for b in range(0, len(texts), BLOCK):
        part = at[b : b + BLOCK + 1]
        doc, code = model.grams(low[part[0] : part[-1]], part - part[0])
        pairs = np.unique(doc * len(column) + code)
        own += np.split((pairs % len(column)).astype(np.int32), np.searchsorted(pairs // len(column), np.arange(1, len(part) - 1)))
    marks = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(langs))])
    vocabulary = np.unique(np.concatenate([own[m] for m in marks]))
    column[vocabulary] = np.arange(len(vocabulary))

    def presence(rows) -> np.ndarray:
        out = np.zeros((len(rows), len(vocabulary)), np.float32)
        for r, i in enumerate(rows):
            c = column[own[i]]
            out[r, c[c >= 0]] = 1
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    x_marks = presence(marks)
    # normalised presence kernel against the landmarks
    k = np.concatenate([presence(range(b, min(b + BLOCK, len(texts)))) @ x_marks.T for b in range(0, len(texts), BLOCK)]).astype(np.float64)
    w, v = np.linalg.eigh(k[marks])
    good = w > 1e-8 * w.max(initial=1e-12)
    root = v[:, good] / np.sqrt(w[good])
    phi = k @ root
    mean = phi.mean(axis=0)
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    middle = target.mean(axis=0)
    z = phi - mean
    beta = np.linalg.solve(z.T @ z + ridge * len(texts) * np.eye(z.shape[1]), z.T @ (target - middle))
    return LanguageModel(langs, points, column, (x_marks.T @ (root @ beta)).astype(np.float32), middle - mean @ beta, orders)


def _below(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows whose hashes lie below their languages' shares; one row a language is broadcast."""
    few = rows.join(F.broadcast(counts), F.col("lang") == F.col("l"))
    return few.where(F.col("h").cast("double") / 2.0**64 + 0.5 < F.col("share")).select("lang", "text", "h")


def _lowest(rows: DataFrame, per_lang: int) -> list:
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_lang)
    return top.select("lang", "h", "text").collect()


def sample(docs: DataFrame, *, per_lang: int, most_chars: int, seed: int = 3) -> tuple[list[str], list[str]]:
    """At most ``per_lang`` labelled rows of each language, by a hash, of texts of up to ``most_chars`` code points."""
    rows = docs.where("lang is not null and text is not null").where(F.length("text").between(1, most_chars))
    rows = rows.select("lang", "text", F.xxhash64(F.lit(seed), "text", "lang").alias("h"))
    # a hash threshold near the wanted share comes first, so that the window below sees few rows of a language
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("l"), "n", F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("n") + F.lit(10.0) / F.col("n")).alias("share")).collect()
    if not counts:
        return [], []
    few = _below(rows, docs.sparkSession.createDataFrame(counts, "l string, n long, share double"))
    got = _lowest(few, per_lang)
    # copies share a hash, so that too little of a language can lie below its threshold
    have = Counter(r.lang for r in got)
    short = [r.l for r in counts if have[r.l] < min(per_lang, r.n)]
    if short:
        got = [r for r in got if r.lang not in short] + _lowest(rows.where(F.col("lang").isin(short)), per_lang)
    got.sort()
    return [r.text for r in got], [r.lang for r in got]


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row; ``und`` and 0 where the text is null or has no letter, or nothing was learned.

    The score is the best decision's share: decisions (-1 to 1) brought to 0 to 1 and
    divided by their sum.  Of equal decisions the first language by code point wins.  A column
    named like an added one is replaced; an empty table gives no rows.
    """
    docs = docs.drop(*{"lang_pred", "score"} - {text})
    letter = "_letter"
    while letter in docs.columns:
        letter += "_"
    kept = docs.schema.fields
    docs = docs.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, text):
                data, off = arrays.buffers(part.column(text))
                ok = part.column(letter).to_numpy(zero_copy_only=False)
                if model is None:
                    lang, score = np.full(len(ok), "und", object), np.zeros(len(ok))
                else:
                    p = np.clip((model.decide(*code_points(data, off)) + 1) / 2, 1e-6, 1)
                    best = p.argmax(axis=1)
                    lang = np.where(ok, np.array(model.langs, object)[best], "und")
                    score = np.where(ok, p.max(axis=1) / p.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*(f.name for f in kept), "lang_pred", "score"])
        arrays.trim()

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def train(docs: DataFrame, *, per_lang: int = 500, most_chars: int = 20000, **options) -> LanguageModel | None:
    """Fits on a bounded sample: ``per_lang`` rows of each language, texts of up to ``most_chars`` code points."""
    return fit(*sample(docs, per_lang=per_lang, most_chars=most_chars), **options)
