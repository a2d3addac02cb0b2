"""Cells of JSON lines, with and without Python."""

import pytest
from pyspark.sql import functions as F

from rowloom.functions import json_exact
from rowloom.sources import jsonl

KEYS = ["a", "b", "c"]
VALUES = [
    "1.5", "1.50", "-0.0", "-0", "0.10", "100.0", "100", "12345678901234567890", "100000000000000000000", "0.0000001", "0.00000010", "1e5", "1.5E-3",
    "9" * 40, "1.05", "-12.25", r'"a\"b"', r'"\ud800"', r'"A\n"', r'"k\": 1.50"', '"1E+20"', "null", "true", "[1.50]", '{"a": 1.50}', '{"x":1,"x":2}', '"é"', "01",
]


@pytest.mark.parametrize("raw", [True, False])
@pytest.mark.parametrize("with_record", [True, False])
def test_cells_against_the_exact_reader(spark, raw, with_record):
    lines = [f'{{"a":{v}, "b" : {w} }}{end}' for v in VALUES for w in VALUES[::3] for end in ("", " x")]
    lines += ['{"a":1.5,"a":2}', '{"a":null,"b":1.50,"a":2}', '{"a":1.5,"b":', "[1]", "no"]
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    fields = ("kind", "text", "raw") if raw else ("kind", "text")
    for row in jsonl.with_cells(jsonl.records(frame) if with_record else frame, KEYS, raw=raw).collect():
        for i, cell in enumerate(json_exact.read_cells(row["line"], KEYS)):
            expected = {f: None if cell["kind"] == "null" and f != "kind" else cell[f] for f in fields}
            assert row[f"cell_{i}"].asDict() == expected, row["line"]


def test_plain_fractions_and_escaped_strings_need_no_python(spark, monkeypatch):
    """What the exact reader is given: nothing of lines whose spelling a variant keeps."""
    given = []

    def reader(line, keys):
        given.append(line)
        return F.array(*[F.lit(None).cast(json_exact.CELL)] * len(keys))

    monkeypatch.setattr(jsonl, "exact_cells", reader)
    lines = [r'{"a":29.27,"b":"{\"k\": 76}","c":-0.5}', r'{"a":12345678901234567890,"b":"\n","c":null}']
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    read = jsonl.with_cells(jsonl.records(frame), KEYS, raw=False)
    assert len(given) == 1
    assert [tuple(row[f"cell_{i}"]["text"] for i in range(3)) for row in read.collect()] == [("29.27", '{"k": 76}', "-0.5"), ("12345678901234567890", "\n", None)]


def test_cells_alone_take_one_python_step(spark):
    frame = spark.createDataFrame([('{"a":1}',)], "line string")
    read = jsonl.with_cells(jsonl.records(frame), KEYS, raw=False).select("cell_0.text")
    assert read._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
