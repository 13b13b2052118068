"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Files are real ``.warc.gz`` archives (one gzip member a record) in a folder that driver and
executors share, reached through ``pyarrow.fs`` (local or NFS, HDFS, object stores).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved

RECORD_SCHEMA = (
    "path string, offset long, length long, kind string, reason string, record_type string, record_id string, page_id long,"
    " target_uri string, refers_to_id string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_PLACE = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_MARK = (0x6F70392D << 96) | (0x7761 << 80) | (8 << 76)  # fixed upper bits of the record ids made here


def record_id(page_id: int | None) -> str:
    """A UUID (version 8) that holds the page id; for null a random one."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    x = page_id & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=_MARK | (x >> 62) << 64 | 2 << 62 | x & (2**62 - 1))}>"


def page_of(rid: str | None) -> int | None:
    """The page id in a record id made by ``record_id``; null for any other."""
    try:
        x = uuid.UUID((rid or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if x >> 76 != _MARK >> 76:
        return None
    n = (x >> 64 & 3) << 62 | x & (2**62 - 1)
    return n - 2**64 if n >= 2**63 else n


def _place(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _clean(x: str) -> str:
    return re.sub(r"[\r\n]", "%0A", x)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, not compressed: a response, or a revisit (HTTP header only) if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str | None = None, *, revisit_bytes: int = 1000, archive_bytes: int = 32 << 20, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes one record for each row of ``pages`` (page_id long, url, html) and returns the manifest (path, records, bytes).

    Payloads are ``html`` in UTF-8 (null: empty).  Of rows with equal payloads of at least
    ``revisit_bytes`` bytes, those with the largest page_id are responses and the others
    revisit it; a null page_id counts as smallest, and where all are null all are responses.
    Null urls give no target URI.  Other columns are ignored; an empty table gives no files.

    Only (page_id, digest, size) are grouped: keepers come from a partial aggregate, and html
    is dealt once, by page and digest, so that a large group of copies is spread.  A task
    starts a new file after ``archive_bytes``; names depend on the partition alone and files
    are moved into place, so a task that runs again replaces its own files.
    """
    spark = pages.sparkSession
    folder = folder or fresh(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.octet_length("html") >= revisit_bytes).select("page_id", "digest")
    keeper = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    visits = large.join(keeper, "digest").where("page_id is null or page_id <> refers_to").where("refers_to is not null").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct()
    rows = rows.join(visits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def put(frames):
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, seq, out, n, size = context.partitionId(), 0, None, 0, 0
        done = []

        def close():
            nonlocal out, seq
            out.close()
            name = f"{part:06d}-{seq:04d}.warc.gz"
            fs.move(f"{base}/.{name}.{context.taskAttemptId()}", f"{base}/{name}")
            done.append((f"{folder}/{name}", n, size))
            out, seq = None, seq + 1

        for frame in frames:
            for page, url, html, digest, refers in zip(frame.page_id.astype(object), frame.url, frame.html, frame.digest, frame.refers_to.astype(object), strict=True):
                if out is None:
                    out, n, size = fs.open_output_stream(f"{base}/.{part:06d}-{seq:04d}.warc.gz.{context.taskAttemptId()}"), 0, 0
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers, date)
                packed = z.compress(raw) + z.flush()
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return saved(rows.mapInPandas(put, "path string, records long, bytes long"), "warc-manifest")


def _parse(raw: bytes, begin: int) -> tuple[dict, int] | str:
    """The record that begins there and its end, or why it is none."""
    if not _VERSION.match(raw, begin):
        return "no version line"
    split = raw.find(b"\r\n\r\n", begin)
    if split < 0:
        return "no end of header"
    head = {}
    for line in raw[begin:split].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            return "bad header line"
        head[k.strip().lower()] = v.strip()
    if not head.get("content-length", "").isdigit():
        return "no content length"
    start, n = split + 4, int(head["content-length"])
    block = raw[start : start + n]
    end = start + n + 4
    if len(block) < n or raw[start + n : end] != b"\r\n\r\n":
        return "length does not fit"
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", None)):
        algorithm, _, want = head.get(name, "").partition(":")
        if algorithm.lower() != "sha1":
            continue
        if data is None:
            if head.get("warc-type") == "revisit":
                continue
            data = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        if hashlib.sha1(data).hexdigest() != want.lower():
            return f"{name} does not fit"
    head["block"] = block
    return head, end


def _row(path: str, offset: int, length: int, head: dict, payloads: bool) -> tuple:
    block, kind = head["block"], head.get("warc-type")
    body, size = block, None
    if head.get("content-type", "").startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        if kind == "revisit" and (m := re.search(rb"(?im)^content-length:\s*(\d+)", top)):
            size = int(m[1])
    rid, refers = head.get("warc-record-id"), head.get("warc-refers-to")
    digest = head.get("warc-payload-digest", "").partition(":")[2].lower() or hashlib.sha1(body).hexdigest()
    return (path, offset, length, "record", None, kind, rid, page_of(rid), head.get("warc-target-uri"), refers, page_of(refers), len(body) if size is None else size, digest, body if payloads and kind != "revisit" else None)


def _gap(path: str, offset: int, end: int, reason: str) -> tuple:
    return (path, offset, end - offset, "gap", reason, *[None] * 9)


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member that begins there holds and where it ends; of a damaged one what inflates, how far that is, and why not more."""
    z, out, pos, step = zlib.decompressobj(31), [], at, 65536
    while pos < len(data) and not z.eof:
        before = z.copy() if step > 1 else None
        try:
            out.append(z.decompress(data[pos : pos + step]))
        except zlib.error:
            if before is None:
                return b"".join(out), pos, "member is damaged"
            z, step = before, 1  # up to the very byte
            continue
        pos += min(step, len(data) - pos)
    return b"".join(out), pos - len(z.unused_data), None if z.eof else "member is cut off"


def _inside(raw: bytes, whole: bool) -> tuple[list[dict], str | None]:
    """All records that a member holds, and why some of its bytes are none; of a damaged member only records with a digest."""
    at, found, why = 0, [], None if raw else "no version line"
    while at < len(raw):
        got = _parse(raw, at)
        if not isinstance(got, str) and (whole or _has_digest(got[0])):
            found.append(got[0])
            at = got[1]
            continue
        why = why or (got if isinstance(got, str) else "no digest in a damaged member")
        m = _VERSION.search(raw, at + 1)
        at = m.start() if m else len(raw)
    return found, why


def _has_digest(head: dict) -> bool:
    names = ["warc-block-digest"] + ["warc-payload-digest"] * (head.get("warc-type") != "revisit")
    return any(head.get(n, "").lower().startswith("sha1:") for n in names)


def salvage(path: str, data: bytes, payloads: bool = True):
    """Rows of RECORD_SCHEMA for all records of an archive, compressed, plain or mixed, and for every gap between them.

    Where a gzip member, a header, a length or a digest fails, the bytes up to the next place
    at which a member with a record or a plain record passes all checks are quarantined as one
    gap.  All records of a member have its offset and length; bytes between them make one gap
    with the same.  Records from the part of a damaged member that still inflates need a
    digest; they have its offset and the length of that part, which also belongs to the gap.
    """
    at, gap, why = 0, None, ""
    rescued, until = [], 0  # of the last damaged member, whose stored records can also be seen as plain ones
    while at < len(data):
        found, rest, end, bad = [], None, at, None
        if data.startswith(_MEMBER, at):
            raw, end, bad = _member(data, at)
            found, rest = _inside(raw, bad is None)
            bad = bad or (None if found else rest)
        else:
            got = _parse(data, at)
            if isinstance(got, str):
                bad = got
            elif at < until and got[0] in rescued:
                bad = "record of a damaged member"
            else:
                found, end = [got[0]], got[1]
        if bad is None and gap is not None:
            yield _gap(path, gap, at, why)
            gap = None
        for head in found:
            yield _row(path, at, end - at, head, payloads)
        if bad is None:
            if rest:
                yield _gap(path, at, end, f"inside the member: {rest}")
            at = end
            continue
        if gap is None:
            gap, why = at, bad
        if found:
            rescued, until = found, end
        m = _PLACE.search(data, at + 1)
        at = m.start() if m else len(data)
    if gap is not None:
        yield _gap(path, gap, len(data), why)


def read_warc(paths: DataFrame, *, payloads: bool = True, part_rows: int = 256) -> DataFrame:
    """Reads the archives named in column ``path``: a row for each record, and one of kind ``gap`` for each quarantined run of bytes.

    A file that can't be opened or is empty of records is one gap.  Each file is read by one
    task whole, so archives should be as small as ``write_warc`` makes them.  Columns:
    RECORD_SCHEMA; payload is null for revisits or without ``payloads``.
    """
    names = [x.split()[0] for x in RECORD_SCHEMA.split(",")]

    def get(frames):
        for frame in frames:
            for path in frame.path:
                try:
                    fs, base = _place(path)
                    with fs.open_input_file(base) as f:
                        data = f.read()
                except OSError as e:
                    yield pd.DataFrame([_gap(path, 0, 0, f"can't be read: {type(e).__name__}")], columns=names)
                    continue
                rows = []
                for row in salvage(path, data, payloads):
                    rows.append(row)
                    if len(rows) == part_rows:
                        yield _frame(rows, names)
                        rows = []
                yield _frame(rows, names)

    paths = paths.where("path is not null").select("path")
    spark: SparkSession = paths.sparkSession
    tasks = max(1, min(paths.count(), 4 * spark.sparkContext.defaultParallelism))
    return paths.repartition(tasks).mapInPandas(get, RECORD_SCHEMA)


def _frame(rows: list, names: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to", "payload_bytes", "offset", "length"):
        out[c] = pd.array([None if x is None else int(x) for x in (r[names.index(c)] for r in rows)], "Int64")
    return out
