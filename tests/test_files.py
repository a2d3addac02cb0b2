import json

import pytest
from conftest import parts_text
from pyspark.sql import functions as F

from rowloom.plans.run import run_recipe
from rowloom.recipes import Delete, Fill, FormatTimestamp, Rename, where
from rowloom.sinks.files import json_lines, write_csv, write_json_array, write_json_object
from rowloom.sources.csv import header_names, read_csv, resolve_names
from rowloom.sources.detect import detect_formats, format_of_path
from rowloom.sources.json_documents import read_json_array
from rowloom.sources.jsonl import key_names, read_lines
from rowloom.sources.mixed import read_mixed
from rowloom.sources.scan import page, range_size, read_page, row_ranges, with_position
from rowloom.suite import QUERIES

PEOPLE = "name,age,email,joined\nAlice,30,,2026-01-15T10:30:00\nBob,42,,2026-03-02T08:05:00\nCharlie,35,charlie@example.com,2026-05-20T18:45:00\nDiana,25,diana@example.com,2026-07-10T12:00:00\n"
CHAIN = [where("age", "GreaterThan", "30", "Number"), Fill("email", "***"), FormatTimestamp("joined", "yyyy-MM-dd")]


@pytest.fixture
def run(spark, text_file, tmp_path):
    def go(name, content, recipe, out, **options):
        target = str(tmp_path / f"{name}.out.{out}")
        run_recipe(spark, text_file(name, content), recipe, target, **options)
        return parts_text(target)

    return go


def test_chained_actions(run):
    assert run("c1.csv", PEOPLE, CHAIN, "csv") == "name,age,email,joined\nBob,42,***,2026-03-02\nCharlie,35,***,2026-05-20\n"


@pytest.mark.parametrize("out", ["csv", "jsonl"])
@pytest.mark.parametrize("source", ["csv", "jsonl"])
def test_four_conversions(run, source, out):
    rows = [("Alice", 30), ("Bob", 25), ("Charlie", 35)]
    content = "name,age\n" + "".join(f"{n},{a}\n" for n, a in rows) if source == "csv" else "".join(json.dumps({"name": n, "age": a}) + "\n" for n, a in rows)
    got = run(f"p.{source}", content, [where("age", "GreaterThan", "30", "Number")], out)
    assert got == ("name,age\nCharlie,35\n" if out == "csv" else '{"name":"Charlie","age":35}\n')


def test_text_cells_become_json_values(run):
    content = 'id,code\n1,007\n2,TRUE\n3,"1,234.50"\n4,1e3\n5,"x ""y"""\n6,\n7,(5)\n8,2024-01-01\n9, false\n'
    values = [json.loads(line)["code"] for line in run("c3.csv", content, [], "jsonl").splitlines()]
    assert values == [7, True, 1234.5, 1000, 'x "y"', "", -5, "2024-01-01", False]


def test_transformed_columns_are_sniffed_too(run):
    assert run("c4.csv", "name,status\nAlice,active\n", [Fill("status", "0")], "jsonl") == '{"name":"Alice","status":0}\n'
    assert run("c5.csv", "date\n2024-03-15\n", [FormatTimestamp("date", "yyyyMMdd")], "jsonl") == '{"date":20240315}\n'
    assert run("l5.jsonl", '{"a":"5","b":null}\n{"c":1}\n', [Fill("a", "7"), Fill("b", "x")], "jsonl") == '{"a":7,"b":"x"}\n{"a":7,"b":"x","c":1}\n'


def test_not_a_number_cannot_be_written_as_json(run):
    with pytest.raises(Exception, match="Not a JSON number"):
        run("nan.csv", "a\nNaN\n", [], "jsonl")


def test_header_only_and_empty_inputs(run):
    assert run("c6.csv", "name,age\n", [], "csv") == "name,age\n"
    assert run("l7.jsonl", "\n", [], "csv") == "\n"
    assert run("l8.jsonl", "", [], "csv") == "\n"
    assert run("l9.jsonl", "\n", [], "jsonl") == ""


def test_all_columns_deleted(run):
    assert run("d.csv", "a,b\n1,2\n3,4\n", [Delete("a"), Delete("b")], "csv") == "\n\n\n"
    assert run("d2.csv", "a,b\n1,2\n3,4\n", [Delete("a"), Delete("b")], "jsonl") == "{}\n{}\n"


def test_json_members_keep_their_text(run):
    lines = [
        '{"id":1,"data":{"city":"café","nested":{"count":2}},"tags":["a","café","b"]}', '{"value":1.50}', '{"value":1e10}',
        '{"value":9223372036854775808}', '{"value":"5"}', '{"value":"true"}', '{"value":"<null>"}', '{"value":"<error>"}', '{"value":-0}',
        '{"data":{ "z" : 1.0, "a":[ ] }}', '{"a":1,"b":2}', '{"a":3}', '{"a":4,"b":null}', '{"a":"line\\nbreak \\"q\\" \\\\"}', '{"a":true}',
    ]
    assert run("l3.jsonl", "\n".join(lines), [], "jsonl").splitlines() == [line for line in lines]


def test_bad_and_blank_json_lines(run):
    content = '{"a":1,"b":2}\n\n   \nnot json\n[1]\n{"a":7,"a":8}\n{"a":1} trailing\n{"a":5,"b":\n'
    got = [json.loads(line) for line in run("bad.jsonl", content, [], "jsonl").splitlines()]
    assert got == [{"a": 1, "b": 2}, {"a": "", "b": ""}, {"a": "", "b": ""}, {"a": 7}, {"a": 1}, {"a": 5, "b": ""}]


def test_json_to_csv_tells_empty_from_nothing(run):
    content = '{"a":1,"b":2}\n{"a":3}\n{"a":4,"b":null}\n{"a":"x,y","b":""}\n{"a":"q\\"q","b":1.50}\nbroken\n'
    assert run("l4.jsonl", content, [], "csv") == 'a,b\n1,2\n3,\n4,\n"x,y",""\n"q""q",1.50\n,\n'


def test_json_filters_drop_null_missing_and_broken(run):
    content = '{"a":1.50}\n{"a":"1.5"}\n{"a":null}\n{"c":1}\n{"a":{"x":1}}\nbad\n{"a":"A"}\n{"a":true}\n{"a":"<null>"}\n{"a":"x\\ty"}\n'

    def kept(operator, value, comparison="Text"):
        return run(f"f{abs(hash((operator, value)))}.jsonl", content, [where("a", operator, value, comparison), Delete("c")], "jsonl").splitlines()

    assert kept("NotEquals", "1.5") == ['{"a":{"x":1}}', '{"a":"A"}', '{"a":true}', '{"a":"x\\ty"}']
    assert kept("Equals", "1.5") == ['{"a":1.50}', '{"a":"1.5"}']
    assert kept("Equals", "TRUE") == ['{"a":true}']
    assert kept("Contains", "object: 1 prop") == ['{"a":{"x":1}}']
    assert kept("Contains", "\\t") == ['{"a":"x\\ty"}']
    assert kept("GreaterThan", "1", "Number") == ['{"a":1.50}', '{"a":"1.5"}']


def test_late_keys_and_key_order(run, spark, text_file):
    content = '{"name":"x"}\n' * 200 + '{"name":"x","extra":"late"}\n'
    assert run("l2.jsonl", content, [], "csv").splitlines()[0] == "name,extra"
    lines = read_lines(spark, text_file("k.jsonl", '{"z":1,"a":{"q":1}}\n{"b":1} {"no":2}\n{"m":1,"z":2,"c":3}\n{"x":1,"x":2,"w":0}\nbroken {"no":1}\n{"no":\n'))
    assert key_names(lines) == ["z", "a", "m", "c", "x", "w"]


def test_native_mode_normalises(run):
    assert run("n.jsonl", '{"a":1.50,"b":{"z":1,"a":2.0}}\n', [], "jsonl", exact=False) == '{"a":1.5,"b":{"a":2,"z":1}}\n'


def test_header_names(spark, text_file):
    assert resolve_names(["name", None, " ", "age"]) == ["name", "Column2", "Column3", "age"]
    for bad in (["a", "a"], ["Column2", ""], ["Column2", None]):
        with pytest.raises(ValueError, match="Two columns are called"):
            resolve_names(bad)
    assert header_names(spark, text_file("h.csv", '﻿"a ""b""",,c\n1,2,3\n')) == ['a "b"', "Column2", "c"]
    assert resolve_names(["a", "A"]) == ["a", "A"]


def test_ragged_rows(spark, text_file):
    path = text_file("r.csv", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n,,\n")
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [("1", "2", "3"), ("4", "5", ""), ("6", "7", "8"), ("", "", "")]
    assert [tuple(r) for r in read_csv(spark, path, on_ragged="skip").collect()] == [("1", "2", "3"), ("", "", "")]
    with pytest.raises(Exception, match="Row width"):
        read_csv(spark, path, on_ragged="fail").collect()


def test_shift_jis(spark, tmp_path):
    path = tmp_path / "j.csv"
    path.write_bytes("名前,年\n太郎,30\n".encode("shift_jis"))
    frame = read_csv(spark, str(path), encoding="Shift_JIS", quoted_breaks=False)
    assert frame.columns == ["名前", "年"] and tuple(frame.first()) == ("太郎", "30")


def test_formats(spark, text_file, tmp_path):
    expected = {
        "a.csv": "csv", "b.JSONL": "jsonl", "c.json": "json_array", "d.json": "json_object", "e.json": None, "f.json": None, "g.txt": None,
    }
    contents = {"a.csv": "x\n", "b.JSONL": "{}\n", "c.json": "﻿ \n\n [1]", "d.json": '{"a":1}', "e.json": "5", "f.json": "  \n", "g.txt": "x"}
    for name, content in contents.items():
        text_file(name, content)
    found = {row["path"].rsplit("/", 1)[1]: row for row in detect_formats(spark, str(tmp_path)).collect()}
    assert {name: row["format"] for name, row in found.items()} == expected
    assert found["e.json"]["error"] == "The JSON begins with '5'."
    assert found["f.json"]["error"] == "The file holds no JSON." and found["g.txt"]["error"] == "Files of this kind are not read: .txt"
    assert format_of_path("x/Y.CSV") == "csv"
    for path in ("x.json", "x.txt", "x"):
        with pytest.raises(ValueError):
            format_of_path(path, allow_json=False)
    with pytest.raises(ValueError, match="begins with|holds no JSON|not read"):
        read_mixed(spark, str(tmp_path), ["a"])


def test_positions_pages_and_ranges(spark, text_file, tiny_splits):
    content = "".join(f"row {i}\n" if i % 3 else "\n" for i in range(3000))
    lines = with_position(read_lines(spark, text_file("p.jsonl", content)))
    assert lines.rdd.getNumPartitions() > 5
    got = {row.position: row.line for row in lines.collect()}
    assert got == {i + 1: (f"row {i}" if i % 3 else "") for i in range(3000)}
    assert [r.line for r in page(lines, "position", 2, 3).orderBy("position").collect()] == ["row 1", "row 2", ""]
    buckets = row_ranges(lines, "position", 1000, start=1).orderBy("bucket").collect()
    assert [tuple(b) for b in buckets] == [(0, 1, 1000, 1000), (1, 1001, 2000, 1000), (2, 2001, 3000, 1000)]


def test_positions_over_files(spark, text_file, tmp_path):
    for name in ("b", "a", "c"):
        text_file(f"m-{name}.jsonl", f"{name}1\n{name}2\n")
    lines = read_lines(spark, str(tmp_path / "m-*"))
    assert [r.line for r in with_position(lines).orderBy("position").collect()] == ["a1", "a2", "b1", "b2", "c1", "c2"]
    assert sorted(r.position for r in with_position(lines, start=0, per_file=True).collect()) == [0, 0, 0, 1, 1, 1]


def test_range_size_grows_with_the_file():
    assert [range_size(b) for b in (0, 100_000_000, 100_000_100, 200_000_100, 10**12)] == [1000, 1000, 2000, 3000, 10_000_000]


def test_ranges_over_large_files_are_no_wider(spark, tmp_path):
    # Lines of 105 MB in all: beyond 100 MB `range_size` would make ranges of 2000 rows.
    orders = spark.range(2100).select(F.col("id").alias("o_orderkey"), F.repeat(F.lit("x"), 50_000).alias("o_orderpriority"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    ranges = QUERIES["row_ranges_of_file"](spark, str(tmp_path)).select("bucket", "first_row", "last_row", "rows").orderBy("bucket")
    assert [tuple(r) for r in ranges.collect()] == [(0, 1, 1000, 1000), (1, 1001, 2000, 1000), (2, 2001, 2100, 100)]


def test_json_document_writers(spark, tmp_path):
    frame = spark.range(10).select("id", F.concat(F.lit('t"'), "id").alias("t"))
    path = str(tmp_path / "arr")
    write_json_array(json_lines(frame.repartition(3)), path)
    texts = [p.read_text() for p in sorted((tmp_path / "arr").glob("part-*"))]
    assert sorted(row["id"] for text in texts for row in json.loads(text)) == list(range(10))
    assert read_json_array(spark, path).count() == 10
    write_json_object(frame.select(F.col("id").cast("string").alias("key"), F.lit("[1]").alias("value")).coalesce(1), str(tmp_path / "obj"))
    assert json.loads(next((tmp_path / "obj").glob("part-*")).read_text()) == {str(i): [1] for i in range(10)}


def test_csv_writer_quotes_only_where_needed(spark, tmp_path):
    frame = spark.createDataFrame([("a b", " lead", None), ("", 'q"', "x,y"), ("l\nm", "r\rs", "'")], "a string, b string, c string").coalesce(1)
    write_csv(frame, str(tmp_path / "w"))
    assert parts_text(str(tmp_path / "w")) == 'a,b,c\na b, lead,\n"","q""","x,y"\n"l\nm","r\rs",\'\n'


def test_one_recipe_over_many_files(spark, text_file, tmp_path):
    for i in range(3):
        text_file(f"in-{i}.csv", f"id,v\n{i},x\n")
    run_recipe(spark, str(tmp_path / "in-*.csv"), [Rename("id", "key"), Delete("v")], str(tmp_path / "all.csv"))
    assert sorted(r.key for r in read_csv(spark, str(tmp_path / "all.csv")).collect()) == ["0", "1", "2"]


@pytest.mark.parametrize("blanks", [" " * 5000, "\n" * 1001, "﻿" + "\r\n\t " * 800])
def test_formats_behind_many_blanks(spark, tmp_path, blanks):
    for name, text in (("a.json", "[1, 2]"), ("o.json", '{"k": 1, "l": 2}')):
        (tmp_path / name).write_bytes((blanks + text).encode())
    found = {r["path"].rsplit("/", 1)[1]: (r["format"], r["error"]) for r in detect_formats(spark, str(tmp_path)).collect()}
    assert found == {"a.json": ("json_array", None), "o.json": ("json_object", None)}


def test_a_page_reads_the_files_that_hold_it(spark, tmp_path, tiny_splits):
    folder = tmp_path / "many"
    folder.mkdir()
    texts = [[f"{number}-{line}" for line in range(count)] for number, count in enumerate((300, 0, 700, 5, 900))]
    for number, lines in enumerate(texts):
        (folder / f"f{number}.txt").write_text("".join(f"{line}\n" for line in lines))
    rows, whole = read_lines(spark, str(folder)), sum(texts, [])
    numbered = {r["position"]: r["line"] for r in with_position(rows).collect()}
    assert [numbered[k + 1] for k in range(len(whole))] == whole
    for first, size in ((1, 10), (295, 10), (301, 700), (999, 8), (1000, 400), (1900, 50), (1, 5000)):
        got = {r["position"]: r["line"] for r in read_page(rows, first, size).collect()}
        assert got == {k: v for k, v in numbered.items() if first <= k < first + size}
    assert read_page(rows, 2000, 10).collect() == [] == read_page(rows.where("false"), 1, 10).collect()
    # What names the files prunes the scan while it is planned.
    one = rows.where(F.col("_metadata.file_path").endswith("f2.txt"))
    assert one.rdd.getNumPartitions() < rows.rdd.getNumPartitions()
