
import pytest
from pyspark.sql import functions as F

from rowloom.functions.json_cells import kind, member, presence
from rowloom.functions.types import ColumnType
from rowloom.operators.drill import key_path
from rowloom.operators.profile import (
    ColumnInfo, csv_schema, csv_summary, describe, infer_csv, infer_csv_file, infer_json, json_schema, json_summary, merge_schemas, merge_summaries,
)
from rowloom.sources.csv import read_csv
from rowloom.sources.jsonl import read_lines, records
from rowloom.streaming.recipe import stream_drill, stream_recipe, stream_recipe_over_lines
from rowloom.streaming.schema import SchemaState, refine_schema
from rowloom.recipes import Rename, where

T = ColumnType


def kinds(schema):
    return [(c.name, c.column_type, c.nullable) for c in schema]


def test_csv_schema(spark, text_file):
    path = text_file("c.csv", "n,blank first,f,b,t,gap,mixed,u\n1,,1.5,true,2024-01-01,7,1,x\n2,3,2,FALSE,1/2/2024,,true,\nbad row\n3,4,3,true,2024-01-03, ,2,x\n")
    assert kinds(infer_csv(read_csv(spark, path, on_ragged="skip"))) == [
        ("n", T.WHOLE, False), ("blank first", T.TEXT, True), ("f", T.FLOAT, False), ("b", T.BOOLEAN, False), ("t", T.TIMESTAMP, False),
        ("gap", T.WHOLE, True), ("mixed", T.TEXT, False), ("u", T.TEXT, True),
    ]


def test_ragged_first_row_is_an_error(spark, text_file):
    with pytest.raises(ValueError, match="width"):
        infer_csv_file(spark, text_file("bad.csv", "a,b\n1\n2,3\n"))
    assert kinds(infer_csv_file(spark, text_file("ok.csv", 'a,b\n"1\n2",2\n2\n'))) == [("a", T.TEXT, False), ("b", T.WHOLE, False)]


def test_header_only_csv_is_nullable_text(spark, text_file):
    assert kinds(infer_csv(read_csv(spark, text_file("h.csv", "a,b\n")))) == [("a", T.TEXT, True), ("b", T.TEXT, True)]


def test_first_rows_and_refinement(spark, text_file):
    path = text_file("r.csv", "a\n" + "1\n" * 250 + "x\n")
    frame = read_csv(spark, path)
    assert infer_csv(frame, 200)[0].column_type is T.WHOLE
    assert infer_csv(frame)[0].column_type is T.TEXT
    first, rest = csv_summary(frame.where("a = '1'")), csv_summary(frame.where("a = 'x'"))
    assert csv_schema(merge_summaries(first, rest)).first()["type"] == "Text"


def test_wide_csv_compiles_once(spark):
    frame = spark.range(20).select(*(F.col("id").cast("string").alias(f"c{i}") for i in range(150)))
    assert {c.column_type for c in infer_csv(frame)} == {T.WHOLE}


LINES = [
    '{"a":1,"b":null,"c":1e10,"d":1.0,"e":"2024-01-01","g":9999999999999999999999,"i":1}',
    '{"a":1.5,"b":3,"c":1.5e10,"f":{},"i":null}', "zz", "[1]", "", '{"a":2,"e":null,"d":9223372036854775808,"f":{"x":1}}',
    '{"x":1,"x":"s","l":[1]}', '{"a":3} trailing',
]


def test_json_schema(spark, text_file):
    lines = read_lines(spark, text_file("j.jsonl", "\n".join(LINES)))
    assert kinds(infer_json(lines)) == [
        ("a", T.FLOAT, True), ("b", T.TEXT, True), ("c", T.TEXT, True), ("d", T.TEXT, True), ("e", T.TIMESTAMP, True), ("g", T.TEXT, True),
        ("i", T.WHOLE, True), ("f", T.OBJECT, True), ("x", T.TEXT, True), ("l", T.ARRAY, True),
    ]
    assert kinds(infer_json(lines, rows=1)) == [
        ("a", T.WHOLE, False), ("b", T.TEXT, True), ("c", T.TEXT, False), ("d", T.FLOAT, False), ("e", T.TIMESTAMP, False), ("g", T.TEXT, False), ("i", T.WHOLE, False),
    ]
    with pytest.raises(ValueError, match="None of the lines"):
        infer_json(read_lines(spark, text_file("bad.jsonl", "x\n[1]\n")))


@pytest.mark.parametrize(
    ("token", "expected"),
    [
        ("42", T.WHOLE), ("-9223372036854775808", T.WHOLE), ("9223372036854775807", T.WHOLE), ("3.14", T.FLOAT), ("1.5e10", T.FLOAT), ("1.0", T.FLOAT),
        ("9999999999999999999999", T.TEXT), ("9999999999999999999999.0", T.FLOAT), ("1e10", T.TEXT), ('"hello"', T.TEXT), ('""', T.TEXT), ('"   "', T.TEXT),
        ('"2024-01-01"', T.TIMESTAMP), ('"2024-01-01T12:00:00+09:00"', T.TIMESTAMP), ('"  2024-01-01  "', T.TIMESTAMP), ('"5"', T.TEXT),
        ("true", T.BOOLEAN), ("false", T.BOOLEAN), ("{}", T.OBJECT), ('{"a":1}', T.OBJECT), ("[]", T.ARRAY), ("[1,2,3]", T.ARRAY), ("null", T.TEXT),
    ],
)
def test_json_value_types(spark, token, expected):
    assert infer_json(spark.createDataFrame([(f'{{"v": {token}}}',)], "line string"))[0].column_type is expected


def test_merge_and_describe(spark):
    left = [ColumnInfo("a", T.WHOLE, False, 0), ColumnInfo("b", T.TEXT, False, 1)]
    right = [ColumnInfo("a", T.FLOAT, False, 0), ColumnInfo("c", T.BOOLEAN, False, 1)]
    assert kinds(merge_schemas(left, right)) == [("a", T.FLOAT, False), ("b", T.TEXT, True), ("c", T.BOOLEAN, True)]
    assert [tuple(r) for r in describe(left, spark).collect()] == [(0, "a", "WholeNumber", "a (number)", False), (1, "b", "Text", "b (text)", False)]


def test_presence_and_kind(spark):
    lines = ['{"a":1}', '{"a":null}', '{"b":1}', "bad", "[1]", '{"a":{}}', '{"a":[]}', '{"a":"x"}', '{"a":false}']
    frame = records(spark.createDataFrame([(line,) for line in lines], "line string").coalesce(1))
    got = frame.select(presence(F.col("line"), F.col("record"), "a"), kind(member(F.col("record"), "a"))).collect()
    assert [tuple(r) for r in got] == [
        ("value", "number"), ("null", "null"), ("missing", None), ("invalid", None), ("invalid", None), ("value", "object"), ("value", "array"), ("value", "string"), ("value", "boolean"),
    ]


# ------------------------------------------------------------------- streaming

def test_schema_refines_batch_by_batch_and_restarts(spark, tmp_path):
    source, folder, checkpoint = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    source.mkdir()
    batches = [['{"a":1,"late":null}', '{"a":2}'], ['{"a":2.5,"b":"2024-01-01"}'], ['{"a":3,"late":5,"b":null}', "bad"]]
    for number, batch in enumerate(batches):
        (source / f"{number}.jsonl").write_text("\n".join(batch) + "\n")
        stream = spark.readStream.text(str(source)).withColumnRenamed("value", "line")
        refine_schema(stream, SchemaState(spark, folder), checkpoint).awaitTermination()
    state = SchemaState(spark, folder)
    first = {r["name"]: (r["type"], r["nullable"]) for r in json_schema(state.summary(0)).collect()}
    assert first == {"a": ("WholeNumber", False), "late": ("Text", True)}
    last = {r["name"]: (r["type"], r["nullable"]) for r in json_schema(state.summary(2)).collect()}
    assert last == {"a": ("FloatingPoint", False), "late": ("Text", True), "b": ("Timestamp", True)}
    (tmp_path / "whole.jsonl").write_text("\n".join(line for batch in batches for line in batch))
    whole = json_summary(read_lines(spark, str(tmp_path / "whole.jsonl")))
    assert last == {r["name"]: (r["type"], r["nullable"]) for r in json_schema(whole).collect()}


def test_csv_schema_refines_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    state = SchemaState(spark, str(tmp_path / "state"))
    for number, row in enumerate(["1,,x", "2.5,3,", "7,4,5"]):
        (source / f"{number}.csv").write_text(row + "\n")
        stream = spark.readStream.schema("a string, b string, c string").csv(str(source))
        refine_schema(stream, state, str(tmp_path / "checkpoint"), "csv").awaitTermination()
    found = {r["name"]: (r["type"], r["nullable"]) for r in csv_schema(state.summary(2)).collect()}
    assert found == {"a": ("FloatingPoint", False), "b": ("Text", True), "c": ("Text", True)}


def run_stream(frame, name):
    query = frame.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in frame.sparkSession.table(name).collect())


def test_streaming_recipes_and_drill(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id":1,"v":[{"x":1.50},{"x":2}]}\n{"id":2}\nbad\n')
    lines = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    rows = stream_recipe_over_lines(lines, [where("id", "LessThan", "2", "Number"), Rename("v", "w")], ["id", "v"])
    assert run_stream(rows, "recipe_rows") == [("1", '[{"x":1.50},{"x":2}]')]
    text = stream_recipe_over_lines(lines, [Rename("v", "w")], ["id", "v"], to_json=True)
    assert run_stream(text, "recipe_json") == [('{"id":"","w":""}',), ('{"id":1,"w":[{"x":1.50},{"x":2}]}',), ('{"id":2}',)]
    numbered = lines.select("line", F.concat(F.lit("r"), F.get_json_object("line", "$.id")).alias("rid"))
    assert run_stream(stream_drill(numbered, key_path("v"), "rid", ["x"]), "drilled") == [("r1:0", "1.5"), ("r1:1", "2")]
    table = lines.select(F.get_json_object("line", "$.id").alias("id"))
    assert run_stream(stream_recipe(table, [where("id", "Equals", "2")]), "plain") == [("2",)]


