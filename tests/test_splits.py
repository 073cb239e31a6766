"""CSV and JSON files cut at any byte give the rows that one task reads from the whole file."""

import json
import os
import random

import pytest

from rillet.session import scratch_path
from rillet.sources import files, read_csv, read_json, splits

CELLS = ['', 'a', 'two words', 'x,y', '"', '""', 'say "hi"', 'line\nfeed', '\n', 'a\n\n"b",\n', 'ends"', '},{', ' pad ', 'é日本', '\\', '7', '7.5']


@pytest.fixture(params=[23, 400])
def cut(spark, request):
    """Splits of a few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def folder(spark, texts):
    at = scratch_path(spark, "cut").removeprefix("file:")
    os.makedirs(at)
    for i, text in enumerate(texts):
        with open(f"{at}/f{i}", "w", newline="") as f:
            f.write(text)
    return at


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in '",\n') else cell


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv_cut_anywhere(spark, cut):
    rng = random.Random(cut)
    texts = ["a,b,c\n" + "".join(",".join(quoted(rng.choice(CELLS)) for _ in "abc") + "\n" for _ in range(25)) for _ in range(2)]
    texts += ["a,b,c\n\n1,2,3\n\n", "a,b,c\n", "a,b,c", 'a,b,c\n1,5" pipe,"x"y"\n2,"q" z,"l\n\nm",\n3,"open\n to the end',
              '"a",b,"c"\n' + "x" * 90 + ',"' + "y\n" * 60 + '",z']
    path = folder(spark, texts)
    whole = spark.read.options(**{**files.CSV_OPTIONS, "inferSchema": False}).csv(path)
    want = rows(files._normalise_na(whole, files.NA_VALUES))
    schema = "a string, b string, c string"
    assert rows(read_csv(spark, path, schema=schema)) == want
    if cut == 23:
        assert read_csv(spark, path, schema=schema).rdd.getNumPartitions() > 10


def test_json_arrays_cut_anywhere(spark, cut):
    rng = random.Random(cut)

    def value(depth=0):
        kind = rng.randrange(5 if depth < 2 else 3)
        if kind < 3:
            return rng.choice(CELLS + ["]", "[{", '"}', "\\\"}", "}" * 5])
        return {"x": value(depth + 1), "y": [value(2)]} if kind == 3 else value(depth + 1)

    docs = [[{"id": i + 100 * k, "v": json.dumps(value()), "o": {"t": rng.choice(CELLS), "l": [{"p": i}, {"p": k}]}} for i in range(8)]
            for k in range(4)]
    forms = [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": 1}]
    path = folder(spark, [json.dumps(d, **f) for d, f in zip(docs, forms, strict=True)] + ["[]", " [ \n ] \n"])
    schema = "id long, v string, o struct<t: string, l: array<struct<p: long>>>"
    want = rows(spark.read.schema(schema).option("multiLine", True).json(path))
    assert len(want) == 32 and rows(read_json(spark, path, schema=schema, lines=False)) == want
    if cut == 400:
        assert rows(read_json(spark, path, lines=False).select("id", "v", "o")) != []
        assert read_json(spark, path, schema=schema, lines=False).rdd.getNumPartitions() > 5


def test_documents_that_are_no_arrays_are_read_whole(spark):
    path = folder(spark, ['{"a": 1,\n "b": {"c": "}"}}'])
    assert read_json(spark, path, lines=False).select("a").collect()[0].a == 1


def test_broken_arrays_fail(spark):
    for text in ('[{"a": 1}, {"a": ', '[{"a": 1}, 5, {"a": 2}]'):
        path = folder(spark, [text])
        with pytest.raises(Exception):  # noqa: B017 - Spark's own error
            read_json(spark, path, schema="a long", lines=False).collect()


def test_scanners_agree_with_one_character_at_a_time():
    rng = random.Random(1)

    def slow(text, inside):
        depth, i = 0, 0
        while i < len(text):
            c = text[i]
            if inside:
                i += c == "\\"
                inside = c != '"'
            else:
                inside = c == '"'
                depth += (c in "{[") - (c in "}]")
            i += 1
        return depth, inside

    for _ in range(3000):
        text = "".join(rng.choice('ab{}[],:"\\') for _ in range(rng.randrange(12)))
        if not text.endswith("\\"):
            for inside in (False, True):
                if "\\" not in text or inside or '"' in text.split("\\")[0]:
                    assert splits.scan_json(text, inside) == slow(text, inside), (text, inside)
