"""Spreadsheets: tables of any size as workbooks written and read by tasks, and lookups and reports of one file.

A spreadsheet is a zip of XML parts.  ``write_workbooks`` and ``read_workbooks`` are for
tables; of ``read_sheet`` and ``write_report``, meant for lookups and reports, the rows pass
through the driver, by the file system of the path, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def each_row(data: bytes, sheet: str | int = 0, number: Callable[[str], object] = float) -> Iterator[tuple[int, list]]:
    """(place from 0, cells) of the rows of a sheet by name or place, one held at a time: texts, numbers, truth values, None where empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")]
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{MAIN}sheets").findall(f"{MAIN}sheet")
        found = sheets[sheet] if isinstance(sheet, int) else next((s for s in sheets if s.get("name") == sheet), None)
        if found is None:
            raise KeyError(sheet)
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == found.get(RELATION))
        at, body = -1, None
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for event, row in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    body = row if row.tag == f"{MAIN}sheetData" else body
                elif row.tag == f"{MAIN}row":
                    cells: dict[int, object] = {}
                    for i, c in enumerate(row.findall(f"{MAIN}c")):
                        kind, v = c.get("t"), c.find(f"{MAIN}v")
                        if kind == "inlineStr":
                            value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                        elif v is None or v.text is None:
                            continue
                        elif kind == "s":
                            value = shared[int(v.text)]
                        elif kind == "b":
                            value = v.text == "1"
                        elif kind in ("str", "e"):
                            value = v.text
                        else:
                            value = number(v.text)
                        cells[_column(c.get("r")) if c.get("r") else i] = value
                    at = int(row.get("r") or at + 2) - 1
                    yield at, [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                    body.clear()


def parse_sheet(data: bytes, sheet: str | int = 0) -> list[list]:
    """All rows of a sheet, empty ones where a row is left out."""
    rows: list[list] = []
    for at, cells in each_row(data, sheet):
        rows += [[] for _ in range(at - len(rows))]
        rows.append(cells)
    return rows


#: Rows of a workbook, and of a batch on the way back: what a task holds at once.
ROWS_A_BOOK, ROWS_A_BATCH = 100_000, 4096


def write_workbooks(df: DataFrame, folder: str, order: Sequence = (), sheet: str = "rows", most: int = ROWS_A_BOOK) -> DataFrame:
    """A table of any size as workbooks of at most ``most`` rows, made and written by tasks: (file, n), a row a workbook.

    With ``order`` the table is dealt by ranges, so file names and the rows within follow the
    order.  A workbook is written under a name of its own and then renamed, so a task that runs
    again replaces its files.  ``folder`` must be reachable by all tasks through a file system
    that Arrow knows (file, hdfs, s3, gs).  An empty table makes no workbook.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    names = df.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa_fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        task = TaskContext.get()
        book, held = 0, []

        def put(rows: list) -> pa.RecordBatch:
            name = f"part-{task.partitionId():06d}-{book:06d}.xlsx"
            with store.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}") as f:
                f.write(sheet_bytes({sheet: (names, rows)}))
            store.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "n": [len(rows)]})

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) >= most:
                yield put(held[:most])
                book, held = book + 1, held[most:]
        if held:
            yield put(held)

    made = rows.mapInArrow(make, "file string, n long").collect()  # a row a workbook
    return df.sparkSession.createDataFrame(made, "file string, n long")


def read_workbooks(spark: SparkSession, path: str, schema: str, sheet: str | int = 0) -> DataFrame:
    """Rows of a sheet of every workbook under ``path``, read by tasks, a row at a time: the columns of ``schema`` by the names in the first row.

    A column that a workbook lacks, an empty cell and a value that isn't of the column's kind
    are null; rows without any value are left out.  Numbers keep all their digits.
    """
    kinds = spark.createDataFrame([], schema).schema
    names = kinds.names
    texts = pa.schema([(n, pa.string()) for n in names])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = each_row(content.as_py(), sheet, str)
                head = {str(h): i for i, h in reversed([*enumerate(next(rows, (0, []))[1])]) if h is not None}
                place = [head.get(n) for n in names]
                while batch := list(islice(rows, ROWS_A_BATCH)):
                    full = [r for _, r in batch if any(v is not None for v in r)]
                    cells = [[None if i is None or i >= len(r) or r[i] is None else str(r[i]) for r in full] for i in place]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], schema=texts)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    rows = files.mapInArrow(parse, StructType([StructField(n, StringType()) for n in names]))
    return rows.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kinds))


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet with names in its first row; every column is a text (numbers without a fraction lose the point), empty cells are null."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    head, *rows = parse_sheet(data, sheet)
    say = lambda v: None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    names = [say(h) or f"column_{i}" for i, h in enumerate(head)]
    wide = [[say(r[i]) if i < len(r) else None for i in range(len(names))] for r in rows if any(v is not None for v in r)]
    return spark.createDataFrame(wide, ", ".join(f"`{n}` string" for n in names))


def sheet_bytes(sheets: Mapping[str, tuple[Sequence[str], Sequence[Sequence]]]) -> bytes:
    """A workbook of named sheets, each (names, rows)."""

    def cell(v, i: int, j: int) -> str:
        at = f"{_letters(j)}{i + 1}"
        if v is None or isinstance(v, float) and v != v:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    out = io.BytesIO()
    n = range(1, len(sheets) + 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{KIND}.worksheet+xml"/>' for k in n)
        z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r0" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        names = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, name in zip(n, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {SPACE} xmlns:r="{OFFICE}"><sheets>{names}</sheets></workbook>')
        for k, (head, rows) in zip(n, sheets.values(), strict=True):
            body = "".join(f'<row r="{i + 1}">{"".join(cell(v, i, j) for j, v in enumerate(r))}</row>' for i, r in enumerate([head, *rows]))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"{HEAD}<worksheet {SPACE}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def write_report(spark: SparkSession, path: str, sheets: Mapping[str, tuple[DataFrame, Sequence]], most: int = 1_000_000) -> str:
    """A report: each frame, sorted as asked, is a sheet.  A sheet holds about a million rows by its format; a longer frame is an error."""
    made = {}
    for name, (df, order) in sheets.items():
        rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more rows than a sheet")
        made[name] = (df.columns, [list(r) for r in rows])
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(sheet_bytes(made)))
    finally:
        stream.close()
    return path
