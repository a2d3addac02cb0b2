import json

import pytest
from pyspark.sql import functions as F

from rowloom.functions.types import ColumnType
from rowloom.operators.drill import (
    Segment, apply_to_drilled, drill, drill_single, infer_leaves, json_children, key, key_path, render_path, structure_profile,
)
from rowloom.operators.flatten import explode_array, flatten_object
from rowloom.recipes import Cast, Delete, Fill, FormatTimestamp, Rename, where
from rowloom.sources.json_documents import read_json_array
from rowloom.sources.jsonl import read_lines
from rowloom.sources.scan import with_position

NONE = "<null>"


@pytest.fixture(params=["lines", "array"])
def records(request, spark, text_file):
    """The same records as JSON Lines (numbered from 1) and as a JSON Array (from 0)."""
    def make(*texts):
        if request.param == "lines":
            return with_position(read_lines(spark, text_file("d.jsonl", "\n".join(texts) + "\n"))), 1
        return read_json_array(spark, text_file("d.json", "[" + ", ".join(texts) + "]")), 0

    return make


def rows_of(table):
    return sorted(tuple(row) for row in table.collect())


CASES = {
    "object": (["user"], ['{"user":{"name":"Alice","age":30}}', '{"user":{"name":"Bob","age":25}}'], ["#", "name", "age"],
               [("0", "Alice", "30"), ("1", "Bob", "25")]),
    "array of objects": (["orders"], ['{"orders":[{"id":"A1","qty":2},{"id":"A2","qty":5}]}', '{"orders":[{"id":"B1","qty":1}]}'], ["#", "id", "qty"],
                         [("0:0", "A1", "2"), ("0:1", "A2", "5"), ("1:0", "B1", "1")]),
    "array of values": (["tags"], ['{"tags":["dev","ops"]}', '{"tags":["dev"]}'], ["#", "value"], [("0:0", "dev"), ("0:1", "ops"), ("1:0", "dev")]),
    "value": (["score"], ['{"score":88}', '{"score":72.50}'], ["#", "score"], [("0", "88"), ("1", "72.5")]),
    "nested arrays": (["orders", 0, "tags"], ['{"orders":[{"tags":["urgent","gift"]},{"tags":["normal"]}]}'], ["#", "value"],
                      [("0:0:0", "urgent"), ("0:0:1", "gift"), ("0:1:0", "normal")]),
    "any index opens all": (["orders", 7, "id"], ['{"orders":[{"id":1},{"id":2},{"no":3}]}'], ["#", "id"], [("0:0", "1"), ("0:1", "2")]),
    "missing key": (["user"], ['{"user":{"name":"Alice"}}', '{"other":"x"}'], ["#", "name"], [("0", "Alice")]),
    "wrong kind": (["user", "name"], ['{"user":"just a string"}', '{"user":{"name":"Bob"}}'], ["#", "name"], [("1", "Bob")]),
    "last index": (["tags", 0], ['{"tags":"not an array"}', '{"tags":["x","y"]}'], ["#", "value"], [("1:0", "x"), ("1:1", "y")]),
    "null leaf": (["a"], ['{"a":null}', '{"a":5}'], ["#", "a"], [("0", NONE), ("1", "5")]),
    "empty array": (["a"], ['{"a":[]}', '{"a":[1]}'], ["#", "value"], [("1:0", "1")]),
    "mixed array": (["a"], ['{"a":[{"k":1},5,null,[1,2],"t"]}'], ["#", "k", "value"],
                    [("0:0", "1", NONE), ("0:1", NONE, "5"), ("0:2", NONE, NONE), ("0:3", NONE, "[Array: 2 items]"), ("0:4", NONE, "t")]),
    "kinds differ": (["a"], ['{"a":{"k":true}}', '{"a":[{"k":false}]}', '{"a":"x"}'], ["#", "k", "a"], [("0", "True", NONE), ("1:0", "False", NONE), ("2", NONE, "x")]),
    "whole record": ([], ['{"z":1,"a":{"q":1}}', '{"m":[1,2,3]}'], ["#", "z", "a", "m"],
                     [("0", "1", "{Object: 1 properties}", NONE), ("1", NONE, NONE, "[Array: 3 items]")]),
    "odd keys": (["a.b", "it's", "[0]"], ['{"a.b":{"it\'s":{"[0]":1}}}'], ["#", "[0]"], [("0", "1")]),
    "quotes in keys": (['"\'\\'], [json.dumps({"\"'\\": {"x\"y": 1}})], ["#", 'x"y'], [("0", "1")]),
    "union of keys": (["u"], ['{"u":{"b":1,"a":2}}', '{"u":{"c":3,"a":4}}', '{"u":{}}'], ["#", "b", "a", "c"],
                      [("0", "1", "2", NONE), ("1", NONE, "4", "3"), ("2", NONE, NONE, NONE)]),
}


@pytest.mark.parametrize("case", CASES)
def test_drill(records, case):
    path, texts, columns, expected = CASES[case]
    frame, start = records(*texts)

    def from_start(lineage):
        first, *rest = lineage.split(":")
        return ":".join([str(int(first) + start), *rest])

    table = drill(frame, key_path(*path))
    assert table.columns == columns
    assert rows_of(table) == sorted((from_start(lineage), *cells) for lineage, *cells in expected)


def test_blank_lines_count_and_broken_ones_are_skipped(spark, text_file):
    frame = with_position(read_lines(spark, text_file("b.jsonl", '﻿{"a":1}\r\n\r\n{"a":\n{"a":3}\n{"a":4}')))
    assert rows_of(drill(frame, key_path("a"))) == [("1", "1"), ("4", "3"), ("5", "4")]
    with pytest.raises(Exception, match="Not JSON"):
        drill(frame, key_path("a"), schema=["a"], on_error="fail").collect()


def test_nothing_reached(spark, text_file):
    frame = with_position(read_lines(spark, text_file("n.jsonl", '{"a":{}}\n')))
    with pytest.raises(ValueError, match="reaches nothing"):
        drill(frame, key_path("b"))
    with pytest.raises(ValueError, match="no members"):
        drill(frame, key_path("a"))


def test_leaf_schema(spark, text_file):
    lines = [
        '{"u":{"z":1,"t":"2024-01-01","n":null,"f":1.5,"o":{},"big":1e5,"one":1.0}}',
        '{"u":{"z":2,"t":"2024-01-02T10:00:00","n":null,"f":2,"l":[1],"big":1.5e5,"one":2.0}}',
        '{"u":{"z":3,"t":"2024-01-03","f":"x","o":{"a":1},"b":true,"big":2,"one":3}}',
    ]
    schema = infer_leaves(read_lines(spark, text_file("s.jsonl", "\n".join(lines))), key_path("u"))
    kinds = {c.name: (c.column_type, c.nullable) for c in schema}
    T = ColumnType
    assert [c.name for c in schema] == ["z", "t", "n", "f", "o", "big", "one", "l", "b"]
    assert kinds == {
        "z": (T.WHOLE, False), "t": (T.TIMESTAMP, False), "n": (T.TEXT, True), "f": (T.TEXT, False), "o": (T.OBJECT, True),
        "big": (T.TEXT, False), "one": (T.FLOAT, False), "l": (T.ARRAY, True), "b": (T.BOOLEAN, True),
    }


def test_scalar_leaves_stay_text(spark, text_file):
    schema = infer_leaves(read_lines(spark, text_file("s.jsonl", '{"a":1}\n{"a":[1,2]}\n')), key_path("a"))
    assert [(c.name, c.column_type, c.nullable) for c in schema] == [("a", ColumnType.TEXT, True), ("value", ColumnType.TEXT, True)]


def test_other_cell_forms(spark, text_file):
    frame = with_position(read_lines(spark, text_file("c.jsonl", '{"a":{"x":1.5,"y":{"b":[1]},"z":null}}\n')))
    assert rows_of(drill(frame, key_path("a"), cells="text")) == [("1", "1.5", '{"b":[1]}', None)]
    variants = drill(frame, key_path("a"), cells="variant")
    assert variants.schema["x"].dataType.simpleString() == "variant"
    assert variants.select(F.try_variant_get("y", "$.b[0]", "int")).first()[0] == 1


def test_actions_on_a_drilled_table(spark, text_file):
    texts = ['{"u":[{"n":"Al","age":30,"d":"2024-01-05"},{"n":"Bo","age":null,"d":"x"}]}', '{"u":[{"n":"Cy","age":41,"d":"1/2/2024"}]}']
    frame = with_position(read_lines(spark, text_file("a.jsonl", "\n".join(texts))))
    schema = infer_leaves(frame, key_path("u"))
    table = drill(frame, key_path("u"), schema=schema)

    def apply(*actions, **options):
        return apply_to_drilled(table, actions, schema, **options)

    assert rows_of(apply(where("age", "GreaterThan", "30", "Number"))) == [("2:0", "Cy", "41", "1/2/2024")]
    # A null shows as text in a view, so NotEquals keeps it.
    assert [r["#"] for r in apply(where("age", "NotEquals", "30")).orderBy("#").collect()] == ["1:1", "2:0"]
    got = apply(Rename("n", "name"), Delete("#"), Fill("age", "?"), Cast("d", ColumnType.TIMESTAMP), FormatTimestamp("d", "yyyy"))
    assert rows_of(got) == [("1:0", "Al", "?", "2024"), ("1:1", "Bo", "?", "<invalid>"), ("2:0", "Cy", "?", "2024")]
    assert apply(labels=True).columns == ["#", "n (text)", "age (number)", "d (text)"]


@pytest.mark.parametrize(
    ("text", "error"),
    [("5", "no array"), ("[1,{}]", "else than objects"), ("[]", "no elements"), ("[{},{}]", "no members"), ("[{", "not JSON")],
)
def test_single_node_errors(spark, text, error):
    with pytest.raises(ValueError, match=error):
        drill_single(spark.createDataFrame([(text,)], "line string"))


def test_single_node(spark):
    table = drill_single(spark.createDataFrame([('[{"b":1,"a":"x"},{"c":null}]',)], "line string"))
    assert table.columns == ["#", "b", "a", "c"]
    assert rows_of(table) == [("[0]", "1", "x", NONE), ("[1]", NONE, NONE, NONE)]


def test_paths():
    assert key_path("a", 0, "b") == (Segment("a"), Segment("[0]", "index"), Segment("b"))
    assert render_path(key_path("a", 3, "b", 1)) == "a[*] > b[*]" and render_path(key_path("a", 3), collapse=False) == "a[3]"
    assert render_path(()) == "root" and key("[0]") != key_path(0)[0]


def test_children(spark, text_file):
    lines = ['{"z":1,"a":{"q":[1,2]},"s":"x\\ny \\"q\\"","n":null,"t":true,"e":[]}', '[1,{"a":1}]', "5", "bad"]
    frame = with_position(read_lines(spark, text_file("c.jsonl", "\n".join(lines))))
    assert rows_of(json_children(frame, ())) == [
        (1, "a", "object", "a: {Object: 1 properties}"), (1, "e", "array", "e: [Array: 0 items]"), (1, "n", "null", "n: <null>"),
        (1, "s", "string", 's: "x\\ny \\"q\\""'), (1, "t", "boolean", "t: true"), (1, "z", "number", "z: 1"),
        (2, "[0]", "number", "[0]: 1"), (2, "[1]", "object", "[1]: {Object: 1 properties}"),
    ]
    assert rows_of(json_children(frame, key_path("a", "q"))) == [(1, "[0]", "number", "[0]: 1"), (1, "[1]", "number", "[1]: 2")]
    assert rows_of(structure_profile(frame, key_path(1))) == [("a", "number", 1)]


def test_flatten_and_explode(spark):
    frame = spark.createDataFrame([(1, '{"id":5,"n":{"x":1}}', [1, 2])], "k int, j string, l array<int>").withColumn("j", F.parse_json("j"))
    flat = flatten_object(frame, "j", ["id", "n", "no"])
    assert flat.columns == ["k", "j.id", "j.n", "j.no", "l"]
    assert [r.l for r in explode_array(frame, "l").collect()] == [1, 2]
    nested = frame.select(F.struct("k", "l").alias("s"))
    assert flatten_object(nested, "s").columns == ["s.k", "s.l"]
    assert explode_array(frame.select(F.parse_json(F.lit("[1,2,3]")).alias("v"), "k"), "v").count() == 3
