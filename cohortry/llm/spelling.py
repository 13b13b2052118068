"""Spelling variants: words one edit apart, found by rolling-hash deletion keys, each led to its far more frequent form."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mix64, ranges
from .common import drop_saved, saved

#: Maximal runs of letters.
RUN = r"[A-Za-zÀ-ÿ]"
#: Distinct words that a task holds before it hands their counts on, keys that a task of the search sorts, and keys made at once.
HELD, TASK, BLOCK = 1 << 18, 1 << 21, 1 << 19
_BASE, _ONE = np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(1)
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _read(texts: list, ids: list, least: int, every: int, into: Counter) -> None:
    find = re.compile(f"{RUN}{{{least},}}").findall  # a shorter run never gives a word: reading only ever takes a letter away
    for text, i in zip(texts, ids, strict=True):
        if not text:
            continue
        head = zlib.crc32(f"{'' if i is None else i}:".encode())
        for run, n in Counter(find(text.translate(_LOW))).items():
            h = zlib.crc32(run.encode(), head)
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            into[run] += n


def vocabulary(docs: DataFrame, *, least: int = 7, twice: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of at least ``least`` code points with at least ``twice`` occurrences in all whole texts.

    Runs are lower-cased (A-Z only); a run of a document loses a letter where ``every`` divides the
    checksum of doc_id and run, so a document reads equal runs alike.  Null texts have none; null
    doc_ids count as empty text.  Counts are gathered in each task first, so a frequent word is a row a
    task in the shuffle.
    """

    def count(batches):
        held = Counter()

        def out():
            words, n = pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, n], ["word", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                _read(part.column(0).to_pylist(), part.column(1).to_pylist(), least, every, held)
                if len(held) > HELD:
                    yield out()
        yield out()

    rows = docs.select("text", F.col("doc_id").cast("string").alias("id")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, place) of every deletion of every word, from prefix and suffix hashes, a few operations a letter.

    place 0: the whole word, by which it meets words that a deletion makes equal to it.
    place i + 1: the word without letter i, met by words of its length that differ at i only.
    place -i - 1: the same as a whole word; only the first letter of a run of equal ones, as
    the others give the same.  Equal keys of one word don't occur but by collision.
    """
    text = words.to_pylist()
    cp = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in text], np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    row, code = np.repeat(np.arange(len(text)), size), mix64(cp)
    at = np.arange(len(cp)) - off[:-1][row]
    power = np.full(int(size.max(initial=0)) + 1, _BASE)
    power[0] = _ONE
    power = np.cumprod(power)
    # sums of code x base^place run on over all words; differences give those of one: modulo 2^64 nothing is lost
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * power[at], dtype=np.uint64)))
    head = before[:-1] - before[off[:-1][row]]  # letters before, at their places
    tail = before[off[1:][row]] - before[1:]  # letters after, one place too high
    whole = before[off[1:]] - before[off[:-1]]
    rest = head + tail * _inverse(_BASE)
    n = size.astype(np.uint64)
    first = (at == 0) | (cp != np.concatenate((cp[:1], cp[:-1])))
    salt = mix64(at.astype(np.uint64) + np.uint64(1 << 32))
    keys = (_final(whole, n), _final(rest ^ salt, n[row]), _final(rest[first], n[row[first]] - _ONE))
    places = (np.zeros(len(text), np.int64), at + 1, -at[first] - 1)
    return np.concatenate(keys), np.concatenate((np.arange(len(text)), row, row[first])), np.concatenate(places)


def _final(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix64(x ^ mix64(size))


def _inverse(x: np.uint64) -> np.uint64:
    """Of an odd number, modulo 2^64."""
    return np.uint64(pow(int(x), -1, 1 << 64))


def _make_keys(batches):
    for batch in batches:
        # a word has 2 x length + 1 keys: in blocks of about BLOCK of them, a longer word by itself
        size = np.maximum(1, np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)) * 2
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // BLOCK, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            key, row, place = deletion_keys(part.column(0))
            ids = part.column(2).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(place.astype(np.int32))], ["key", "wid", "place"])


def _shared_keys(batches):
    """Rows of keys that at least two rows have: a task's keys are dealt by their leading bits, sorted, and neighbours compared."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not parts:
        return
    key, wid, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    digit = (key >> 52).astype(np.int16)
    order = np.argsort(digit, kind="stable")  # 16 bits: a radix sort
    ends = np.cumsum(np.bincount(digit.astype(np.int64) + 2048, minlength=4096))
    for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
        if b - a < 2:
            continue
        part = order[a:b]
        part = part[np.argsort(key[part], kind="stable")]
        k = key[part]
        begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        count = np.diff(np.append(begin, len(k)))
        hit = part[ranges(begin[count > 1], count[count > 1])]
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(wid[hit]), pa.array(place[hit])], ["wid", "place"])


def near_words(vocab: DataFrame) -> DataFrame:
    """(wid, n_near, form, form_n) of the words (wid, word, n, all different) that have near ones.

    Near: exactly one letter inserted, deleted or replaced.  form is the near word of largest n,
    ties by code points; n_near counts all, however many.  Keys (8 bytes, with the word's number and
    the place) are dealt by key; only rows whose key another row has go on and are given their
    strings, on which they are grouped: a collision of keys ends there, as no strings agree.  Words that
    differ at one letter alone are a group (no more than there are letters) and know its size and
    its best two; so no pairs are listed.
    """
    spark = vocab.sparkSession
    sized = vocab.select("word", F.length("word").alias("size"), "wid")
    total = sized.agg(F.sum(F.col("size") * 2 + 1)).first()[0] or 0
    keys = sized.mapInArrow(_make_keys, "key long, wid long, place int")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK))
    shared = saved(keys.repartition(tasks, "key").mapInArrow(_shared_keys, "wid long, place int"), "spelling-keys")

    at = F.abs("place")
    rest = F.when(at == 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), at - 1), F.substring("word", at + 1, F.length("word"))))
    rows = shared.join(vocab, "wid").withColumn("rest", rest)
    # words that differ at one place
    group = Window.partitionBy("place", "rest")
    ranked = group.orderBy(F.col("n").desc(), F.col("word"))
    best = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pair = F.struct(F.col("n").alias("n"), F.col("word").alias("w"))
    same = rows.where("place > 0").withColumn("m", F.count("*").over(group)).withColumn("one", F.first(pair).over(best)).withColumn("two", F.nth_value(pair, 2).over(best))
    same = same.where("m > 1").select("wid", (F.col("m") - 1).alias("m"), F.when(F.col("one.w") == F.col("word"), F.col("two")).otherwise(F.col("one")).alias("c"))
    # a word and those that a deletion makes equal to it
    by = Window.partitionBy("rest")
    child = F.col("place") < 0
    pick = F.struct((-F.col("n")).alias("n"), F.col("word").alias("w"))
    fit = rows.where("place <= 0").withColumn("base", F.max(F.when(~child, pair)).over(by)).withColumn("m", F.sum(child.cast("long")).over(by)).withColumn("low", F.min(F.when(child, pick)).over(by))
    fit = fit.where("base is not null and m > 0")
    top = F.struct((-F.col("low.n")).alias("n"), F.col("low.w").alias("w"))
    fit = fit.select("wid", F.when(child, F.lit(1)).otherwise(F.col("m")).cast("long").alias("m"), F.when(child, F.col("base")).otherwise(top).alias("c"))
    found = same.unionByName(fit).groupBy("wid").agg(F.sum("m").alias("n_near"), F.min(F.struct((-F.col("c.n")).alias("n"), F.col("c.w").alias("w"))).alias("c"))
    return found.select("wid", "n_near", F.col("c.w").alias("form"), (-F.col("c.n")).alias("form_n"))


def spelling_forms(docs: DataFrame, *, least: int = 7, twice: int = 2, every: int = 31, times: int = 10) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of ``vocabulary``.

    form: the near word of largest n if that is at least ``times`` the word's n, else null, and form_n its
    n; n_near: near words, 0 if none; root: where following forms ends, the word itself without one.  Only
    text and doc_id play a part, whatever else the table has; null and empty texts give no words, repeated
    rows count each, a run of a million letters is a word like others; an empty table gives no rows.

    A form occurs ``times`` as often as its word, so chains are short: doubling the steps followed
    needs a few joins of the words that have a form.
    """
    vocab = saved(vocabulary(docs, least=least, twice=twice, every=every).withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
    good = F.col("form_n") >= F.col("n") * times
    rows = vocab.join(near_words(vocab), "wid", "left").select("word", "n", F.when(good, F.col("form")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("form_n")).alias("form_n"))
    rows = saved(rows, "spelling-forms")
    depth = math.log(max(2, rows.agg(F.max("n")).first()[0] or 2) / twice, max(times, 2)) + 1
    step = saved(rows.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(max(2, depth)))):
        after = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(step.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        drop_saved(step)
        step = new
    return rows.join(step, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
