import os

from pyspark.sql import types as T

from rillet import operators as op
from rillet.session import scratch_path
from rillet.sources import convert_format, read_csv, read_json, save


def _write(path, text):
    p = path.replace("file:", "")
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_na_spellings_and_types(spark):
    p = _write(scratch_path(spark, "csv") + "/in.csv",
               "a,b,c,d,e\n007,1.5,true,2024-01-01,x\nNA,,False,n/a,\n3,2,TRUE,2024-02-01,NULL\n")
    df = read_csv(spark, p)
    assert [f.dataType for f in df.schema.fields] == [T.LongType(), T.DoubleType(), T.BooleanType(),
                                                      T.StringType(), T.StringType()]
    got = [tuple(r) for r in df.collect()]
    assert got[0] == (7, 1.5, True, "2024-01-01", "x")
    assert got[1] == (None, None, False, None, None)


def test_json_document_and_lines(spark):
    doc = _write(scratch_path(spark, "json") + "/doc.json", '[{"a": 1, "b": "x"}, {"a": 2}]')
    assert read_json(spark, doc).count() == 2
    lines = _write(scratch_path(spark, "json") + "/lines.json", '{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert read_json(spark, lines).count() == 3


def test_convert_format_keeps_schema(spark):
    df = spark.createDataFrame([(1, "x", 2.5), (2, None, None)], "a long, b string, c double")
    for fmt in ("csv", "json", "parquet"):
        back = convert_format(df, fmt)
        assert back.schema == df.schema
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_save_csv_header(spark):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    path = scratch_path(spark, "out") + ".csv"
    save(op.select_columns(df, "b, a"), path)
    assert read_csv(spark, path).columns == ["b", "a"]


def test_json_column_oriented_document(spark):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1, 2, 3], "b": ["x", None, "z"], "c": [1.5, 2.0, 2.5]})
    p = _write(scratch_path(spark, "json") + "/cols.json", pdf.to_json())  # pandas' default orient
    df = read_json(spark, p, orient="columns")
    assert df.columns == ["a", "b", "c"]
    assert [tuple(r) for r in df.collect()] == [(1, "x", 1.5), (2, None, 2.0), (3, "z", 2.5)]


def test_json_kinds_are_told_file_by_file(spark, tmp_path):
    from rillet.sources import read_json

    (tmp_path / "a.json").write_text('[{"n": 1},\n {"n": 2}]')
    (tmp_path / "b.json").write_text('{"n": 3}\n{"n": 4}\n\n{"n": 5}\n')
    (tmp_path / "c.json").write_text('{\n "n": {"0": 6, "1": 7}\n}')
    got = sorted(r.n for r in read_json(spark, f"file://{tmp_path}").collect())
    assert got == [1, 2, 3, 4, 5, 6, 7]


def test_csv_hard_cells(spark, tmp_path):
    from rillet.sources import convert_format, read_csv

    (tmp_path / "x.csv").write_text('a.b,c\n"say ""hi"", ok",12D\n"two\nlines",007\n')
    got = read_csv(spark, f"file://{tmp_path}/x.csv")
    assert got.columns == ["a.b", "c"]
    assert sorted(tuple(r) for r in got.collect()) == [('say "hi", ok', "12D"), ("two\nlines", "007")]
    cells = spark.createDataFrame([("  pad ",), ("x\ny",), ("",), (None,), ('q"q',)], "t string")
    back = convert_format(cells, "csv")
    assert sorted(r.t or repr(r.t) for r in back.collect()) == sorted(["  pad ", "x\ny", "''", "None", 'q"q'])


def test_nested_records_in_files_of_one_record(spark, tmp_path):
    from rillet.sources import read_json

    record = '{"user":{"id":%d},"event":{"k":%d}}\n'
    mixed, single = tmp_path / "mixed", tmp_path / "single"
    for folder in (mixed, single):
        folder.mkdir()
        (folder / "a.json").write_text(record % (1, 10))
        (folder / "b.json").write_text(record % (2, 20) + (record % (3, 30) if folder == mixed else ""))
    for folder, n in ((mixed, 3), (single, 2)):
        got = sorted((r.user.id, r.event.k) for r in read_json(spark, f"file://{folder}").collect())
        assert got == [(i, 10 * i) for i in range(1, n + 1)]
    (mixed / "c.json").write_text('{"user":{"0":4},"event":{"0":40}}\n')  # labels, but among JSON lines
    assert read_json(spark, f"file://{mixed}").count() == 4
    assert read_json(spark, f"file://{mixed}").where("user.id IS NOT NULL").count() == 3


def test_column_oriented_files_of_one_line(spark, tmp_path):
    from rillet.sources import read_json

    (tmp_path / "a.json").write_text('{"n":{"0":1,"1":2},"s":{"0":"x","1":null}}')
    (tmp_path / "b.json").write_text('{\n "n": {"0": 3},\n "s": {"0": "z"}\n}')
    assert sorted(map(tuple, read_json(spark, f"file://{tmp_path}").collect())) == [(1, "x"), (2, None), (3, "z")]
