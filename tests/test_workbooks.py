import pytest

from cohortry.sources import sheets

SCHEMA = "k long, `a text` string, x double, yes boolean"


def test_round_trip(spark, tmp_path):
    rows = [(2**60 + i, f"<{i}>&  \u00e9\n" if i % 3 else None, i / 7 if i % 5 else None, i % 2 == 0) for i in range(230)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = sheets.write_workbooks(df, f"file://{tmp_path}/books", ["k"], most=50).orderBy("file").collect()
    assert sum(r.n for r in made) == 230 and max(r.n for r in made) <= 50
    got = sheets.read_workbooks(spark, f"file://{tmp_path}/books", SCHEMA).orderBy("k").collect()
    assert [tuple(r) for r in got] == rows
    firsts = [sheets.parse_sheet((tmp_path / "books" / r.file).read_bytes())[1][0] for r in made]
    assert firsts == sorted(firsts)  # names follow the order
    assert sorted(f.name for f in (tmp_path / "books").iterdir() if f.suffix == ".xlsx") == [r.file for r in made]


def test_other_columns_and_kinds(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheets.sheet_bytes({"s": (["k", "x"], [(1, "two"), (None, None), (3, 4.5)])}))
    (tmp_path / "b.xlsx").write_bytes(sheets.sheet_bytes({"s": (["x", "other"], [(7, 8)])}))
    (tmp_path / "c.xlsx").write_bytes(sheets.sheet_bytes({"s": ([], [])}))
    got = sheets.read_workbooks(spark, f"file://{tmp_path}", "x double, k int", "s").collect()
    assert sorted(map(str, got)) == ["Row(x=4.5, k=3)", "Row(x=7.0, k=None)", "Row(x=None, k=1)"]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert sheets.write_workbooks(df, f"file://{tmp_path}/none").count() == 0


def test_rows_left_out_keep_their_place():
    data = sheets.sheet_bytes({"s": (["a"], [(1,), (2,)])})
    assert sheets.parse_sheet(data) == [["a"], [1.0], [2.0]]
    with pytest.raises(KeyError):
        sheets.parse_sheet(data, "t")
