"""Distributed cutting of JSON documents and CSV rows against Python's own readers."""

import csv
import io
import json
import random

import pytest

from rowloom.sources.csv import has_quoted_breaks, read_csv
from rowloom.sources.json_documents import read_json_array, read_json_object
from rowloom.sources import scan, splitting

PIECES = ["x,]}\"\\", '{["é', "", "\\", "\\\\\"", "a\nb", "日本語", "]", '",', "}}}"]


def random_value(rnd, depth=0):
    pick = rnd.random()
    if depth < 4 and pick < 0.2:
        return {rnd.choice(PIECES) + str(i): random_value(rnd, depth + 1) for i in range(rnd.randint(0, 4))}
    if depth < 4 and pick < 0.4:
        return [random_value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return rnd.choice([1, 2.5, None, True, "long " * rnd.randint(1, 200), *PIECES])


@pytest.mark.parametrize("separator", ["}", ","])
@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_json_arrays(spark, text_file, tiny_splits, separator, indent, seed):
    rnd = random.Random(seed)
    data = [random_value(rnd) for _ in range(200)]
    path = text_file("a.json", json.dumps(data, indent=indent, ensure_ascii=seed == 1) + "\n")
    rows = read_json_array(spark, path, separator)
    got = {row.position: json.loads(row.line) for row in rows.select("position", "line").collect()}
    assert got == dict(enumerate(data))


def test_one_element_over_many_splits(spark, text_file, tiny_splits):
    data = [1, {"k": ["x,}" * 4000]}, "y" * 9000, [], {}]
    rows = read_json_array(spark, text_file("big.json", json.dumps(data)))
    assert [json.loads(r.line) for r in rows.orderBy("position").collect()] == data


@pytest.mark.parametrize("text", ["[]", " [ ] ", "[\n]\n"])
def test_empty_arrays(spark, text_file, text):
    assert read_json_array(spark, text_file("e.json", text)).count() == 0


def test_many_array_files_number_their_own_elements(spark, text_file, tmp_path, tiny_splits):
    for name in "ab":
        text_file(f"{name}.json", json.dumps([name * 600] * 9))
    got = sorted((r.position, json.loads(r.line)[0]) for r in read_json_array(spark, str(tmp_path / "*.json")).collect())
    assert got == sorted((i, name) for name in "ab" for i in range(9))


@pytest.mark.parametrize("seed", [3, 4])
def test_json_objects(spark, text_file, tiny_splits, seed):
    rnd = random.Random(seed)
    data = {f"k{i}" + rnd.choice(PIECES): random_value(rnd) for i in range(150)}
    text = json.dumps(data, ensure_ascii=False)
    text = text[:-1] + ', "k\\u0031": 1, "twice": {"first": 1}, "end": [2], "twice": "last" }\n'
    rows = read_json_object(spark, text_file("o.json", text)).select("position", "key", "line").orderBy("position").collect()
    expected = json.loads(text)
    assert [r.key for r in rows] == list(expected)
    assert {r.key: json.loads(r.line) for r in rows} == expected


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_with_quoted_breaks(spark, text_file, tiny_splits, ending):
    rnd = random.Random(5)
    cells = ["plain", "a,b", 'q"q', "line\nbreak", "x\r\ny", "", " sp ", "é" * 50, '"', "\n\n", "z" * 3000]
    rows = [[str(i), rnd.choice(cells), rnd.choice(cells)] for i in range(600)]
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=ending)
    writer.writerows([["id", "", "name"], *rows])
    path = text_file("t.csv", out.getvalue())
    assert has_quoted_breaks(spark, path)
    frame = read_csv(spark, path)
    assert frame.columns == ["id", "Column2", "name"]
    assert sorted((list(r) for r in frame.collect()), key=lambda r: int(r[0])) == rows


def test_plain_csv_needs_no_cutting(spark, text_file):
    assert not has_quoted_breaks(spark, text_file("p.csv", 'a,b\n"x,y",2\n"say ""hi""",3\n'))


def test_broken_rows_follow_the_ragged_rule(spark, text_file):
    path = text_file("r.csv", 'a,b\n"1\n2",3\n4\n"5\n6",7,8\n')
    assert sorted(tuple(r) for r in read_csv(spark, path).collect()) == [("1\n2", "3"), ("4", ""), ("5\n6", "7")]
    assert [tuple(r) for r in read_csv(spark, path, on_ragged="skip").collect()] == [("1\n2", "3")]


def test_without_broadcast(spark, text_file, tiny_splits, monkeypatch):
    """So many splits that their states are joined by a shuffle instead."""
    monkeypatch.setattr(scan, "MAX_BROADCAST_BYTES", 0)
    rnd = random.Random(6)
    data = [random_value(rnd) for _ in range(150)]
    rows = read_json_array(spark, text_file("s.json", json.dumps(data)))
    assert {r.position: json.loads(r.line) for r in rows.collect()} == dict(enumerate(data))


def test_backslash_runs():
    import numpy as np

    text = b'a\\"b\\\\"c"\\\\\\"\\x""'
    raw = np.frombuffer(text, np.uint8)
    quotes, slashes = np.flatnonzero(raw == 34), np.flatnonzero(raw == 92)
    expected = [len(text[:q]) - len(text[:q].rstrip(b"\\")) for q in quotes]
    assert splitting._run_before(quotes, slashes).tolist() == expected


@pytest.mark.parametrize("text", ['[{"a":1},{"a":2},{"a":3}', "[1,2", '[{"a":"x', '[{"a":1},'])
def test_array_cut_short(spark, text_file, text):
    path = text_file("cut.json", text)
    with pytest.raises(Exception, match="ends inside"):
        read_json_array(spark, path).collect()
    assert read_json_array(spark, path, on_damage="row").count() == text.count("{") or text == "[1,2"


def test_object_cut_short(spark, text_file):
    with pytest.raises(Exception, match="ends inside"):
        read_json_object(spark, text_file("cut.json", '{"a":1,"b":2,"c":{"d":')).collect()
    assert read_json_object(spark, text_file("long.json", '{"' + "k" * 50_000 + '":1}')).count() == 1


@pytest.mark.parametrize("separator", ["}", ","])
@pytest.mark.parametrize("text", ['[{"a":1},{"b":[2]}]', "[1,2]\n", "[]", '[{"a":{"b":1}}] \n'])
def test_whole_arrays(spark, text_file, separator, text):
    rows = read_json_array(spark, text_file("w.json", text), separator).collect()
    assert [json.loads(r.line) for r in sorted(rows, key=lambda r: r.position)] == json.loads(text)


def test_stray_and_unclosed_quotes(spark, text_file, tiny_splits):
    path = text_file("stray.csv", 'a,b\nk,0\n5" pipe,1\nx,2\ny,3\n"q""",""\n')
    expected = [("5\" pipe", "1"), ("k", "0"), ("q\"", ""), ("x", "2"), ("y", "3")]
    for breaks in (None, True, False):
        assert sorted(tuple(r) for r in read_csv(spark, path, quoted_breaks=breaks).collect()) == expected
    path = text_file("open.csv", 'a,b\n1,"x\ny\n2,z\n')
    with pytest.raises(Exception, match="ends inside"):
        read_csv(spark, path).collect()
    assert [r.a for r in read_csv(spark, path, on_damage="row").collect()] == ["1"]


def test_header_of_every_file(spark, tmp_path):
    for name, text in (("1.csv", "x,y\n1,2\n"), ("2.csv", "y,x\n9,8\n")):
        (tmp_path / name).write_text(text)
    for breaks in (True, False):
        with pytest.raises(Exception, match="header"):
            read_csv(spark, str(tmp_path), quoted_breaks=breaks).collect()


def test_quote_states_against_one_pass():
    import numpy as np

    rnd = random.Random(8)
    for _ in range(300):
        text = "".join(rnd.choice('a",\n') for _ in range(rnd.randrange(14)))
        raw = np.frombuffer(text.encode(), np.uint8)
        at, _, states, final = splitting._marks(raw, splitting.CSV_ROWS, splitting.CSV_ROWS.moves())
        for start in (0, 1):
            inside, k, seen = start, 0, []
            while k < len(text):
                if text[k] == '"':
                    if inside and text[k + 1 : k + 2] == '"':
                        k += 1
                    elif inside:
                        inside = 0
                    elif k == 0 or text[k - 1] in ",\n":
                        inside = 1
                elif text[k] == "\n":
                    seen.append(inside)
                k += 1
            # Inside a string at the start of a text that begins with quotes is the one
            # case a text cannot show; runs of quotes never reach over a line break.
            if not (start and text[:1] == '"'):
                assert states[start].tolist() == seen and final[start] == inside, text


def test_csv_rows_longer_than_what_the_first_pass_hands_on(spark, text_file, tiny_splits):
    rows = [["a", "b"], ["x", "long \n" * 30_000], ['"', "short,\n"], ["y " * 50_000, "z"]] + [[str(i), "q\n" * (i % 3)] for i in range(3000)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    found = read_csv(spark, text_file("long.csv", out.getvalue()))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows[1:]))


def test_csv_with_bytes_that_are_no_text(spark, tmp_path, tiny_splits):
    path = tmp_path / "raw.csv"
    path.write_bytes(b"a,b\n" + b"".join(b'"\xff%d\n",\xfe\n' % i for i in range(2000)))
    found = read_csv(spark, str(path)).selectExpr("cast(a as binary) a", "cast(b as binary) b").collect()
    assert len(found) == 2000 and all(b"\n" in bytes(r["a"]) for r in found)


def test_ends_of_splits_take_no_pass_of_their_own(spark, text_file):
    path = text_file("p.csv", 'a,b\n1,"x\ny"\n2,z\n')
    plan = splitting.split_records(spark, path, splitting.CSV_ROWS, "\n", with_file=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_damage_is_told_in_both_modes(spark, text_file):
    path = text_file("d.csv", 'a,b\n"x"" y,1\n2,z\n')
    for quoted_breaks in (None, True, False):
        with pytest.raises(Exception, match="inside"):
            read_csv(spark, path, quoted_breaks=quoted_breaks).collect()
    assert read_csv(spark, path, quoted_breaks=False, on_damage="row").count() == 2
    fine = text_file("f.csv", 'a,b\n5" pipe,1\n"a ""b""","c"\n"",x"y\n"""",1\n')
    found = sorted(map(tuple, read_csv(spark, fine, quoted_breaks=False).collect()))
    assert found == sorted([('5" pipe', "1"), ('a "b"', "c"), ("", 'x"y'), ('"', "1")])
