import json
from pathlib import Path

import pytest

from rowloom.functions.types import ColumnType, check_cast_target
from rowloom.plans.plan import build_plan
from rowloom.plans.run import run_recipe
from rowloom.recipes import Cast, Comparison, Delete, Fill, Filter, FormatTimestamp, Operator, Recipe, Rename, dumps, load, loads, save, where

ORDERING = ("GreaterThan", "LessThan", "GreaterThanOrEqual", "LessThanOrEqual")
TEXT_ONLY = ("Contains", "NotContains", "StartsWith", "EndsWith")
ALL = (Rename("a", "b"), Delete("c"), Cast("d", ColumnType.WHOLE), where("e", "GreaterThan", "5", "Number"),
       Fill("f", 'x "quoted" \\ y'), FormatTimestamp("g", "yyyy/MM/dd"))


def test_filter_validity_matrix():
    value = {"Text": "x", "Number": "1.5", "Timestamp": "2024-01-01"}
    for comparison in Comparison:
        for operator in Operator:
            good = operator.value in ("Equals", "NotEquals") or (operator.value in TEXT_ONLY) == (comparison is Comparison.TEXT)
            if good:
                Filter("c", operator, comparison, value[comparison.value])
            else:
                with pytest.raises(ValueError, match="cannot be tested"):
                    Filter("c", operator, comparison, value[comparison.value])


@pytest.mark.parametrize(("comparison", "value"), [("Number", "abc"), ("Number", "NaN"), ("Number", "Infinity"), ("Number", ""), ("Timestamp", "soon"), ("Timestamp", "2024-13-01")])
def test_filter_values_must_be_readable(comparison, value):
    with pytest.raises(ValueError, match="cannot read"):
        where("c", "Equals", value, comparison)


def test_number_thresholds_may_be_grouped():
    assert where("c", "GreaterThan", "1,234.5", "Number").value == "1,234.5"


def test_recipe_file_round_trip(tmp_path):
    recipe = Recipe("monthly", ALL, "a description")
    path = str(tmp_path / "recipe.yaml")
    save(recipe, path)
    assert load(path) == recipe
    assert loads(dumps(Recipe("empty"))) == Recipe("empty")
    assert "actions: []" in dumps(Recipe("empty"))
    assert "    operator: GreaterThan\n" in dumps(recipe) and '    targetFormat: "yyyy/MM/dd"\n' in dumps(recipe)


def test_recipe_file_reading():
    text = """# a comment
name: Clean up
lastModified: 2026-01-15T10:30:00.1234567+00:00

actions:
  - type: Filter
    columnName: age
    operator: GreaterThan
    comparisonType: Number
    value: "30"
  - type: FormatTimestamp
    columnName: date
    targetFormat: yyyyMMdd
"""
    recipe = loads(text)
    assert recipe.name == "Clean up" and recipe.last_modified.year == 2026
    assert recipe.actions == (where("age", "GreaterThan", "30", "Number"), FormatTimestamp("date", "yyyyMMdd"))


@pytest.mark.parametrize(
    "text",
    [
        "actions: []", "name: a\nname: b", "name: a\nother: b", "name: a\njunk", "name: a\nlastModified: never",
        "name: a\nactions:\n    oldName: x", "name: a\nactions:\n  - type: Sort\n    columnName: x",
        "name: a\nactions:\n  - type: Rename\n    oldName: x", "name: a\nactions:\n  - type: Delete\n    junk",
        "name: a\nactions:\n  - type: Cast\n    columnName: x\n    targetType: wholenumber",
        "name: a\nactions:\n  - type: Filter\n    columnName: x\n    operator: Contains\n    comparisonType: Number\n    value: 5",
        'name: a\nactions:\n  - type: FormatTimestamp\n    columnName: x\n    targetFormat: " "',
    ],
)
def test_bad_recipe_files(text):
    with pytest.raises(ValueError):
        loads(text)


def test_editing_makes_new_recipes():
    first = Recipe("r")
    second = first.append(Delete("a")).append(Delete("b"))
    assert first.actions == () and len(second.actions) == 2 and second.clear().actions == ()


def names(plan):
    return [(c.source, c.name) for c in plan.columns]


def test_plan_follows_current_names_and_source_order():
    plan = build_plan(["A", "B", "C"], [Rename("A", "X"), Rename("X", "Y"), Delete("B"), Delete("A"), Rename("gone", "z")])
    assert names(plan) == [("A", "Y"), ("C", "C")]


def test_renaming_onto_a_column_hides_it():
    assert names(build_plan(["A", "B", "C"], [Rename("C", "A")])) == [("B", "B"), ("C", "A")]


def test_batch_keeps_the_last_transform_and_view_keeps_both():
    actions = [Fill("A", "x"), FormatTimestamp("A", "yyyy"), FormatTimestamp("B", "yyyy"), Fill("B", "y")]
    a, b = build_plan(["A", "B"], actions).columns
    assert (a.fill, a.target_format, b.fill, b.target_format) == (None, "yyyy", "y", None)
    a, b = build_plan(["A", "B"], actions, "view").columns
    assert (a.fill, a.target_format, b.fill, b.target_format) == ("x", "yyyy", "y", "yyyy")


def test_filters_keep_source_and_type_at_their_place():
    actions = [Rename("A", "X"), where("X", "Equals", "1"), Cast("X", ColumnType.FLOAT), where("X", "Equals", "2"), Delete("X"), where("X", "Equals", "3")]
    plan = build_plan(["A"], actions, "view", {"A": ColumnType.WHOLE})
    assert [(t.source, t.column_type, t.value) for t in plan.tests] == [("A", ColumnType.WHOLE, "1"), ("A", ColumnType.FLOAT, "2")]
    assert plan.columns == []


def test_cast_targets():
    check_cast_target("jsonl", ColumnType.OBJECT)
    with pytest.raises(ValueError):
        check_cast_target("csv", ColumnType.ARRAY)


def test_object_input_and_array_output(spark, text_file, tmp_path):
    source = text_file("o.json", '{"x":{"a":1,"b":"u"},"y":{"a":2},"z":{"a":3,"b":null}}')
    out = str(tmp_path / "out")
    run_recipe(spark, source, [where("a", "GreaterThan", "1", "Number"), Rename("b", "c")], out, "json_object", "json_array", names=["a", "b"])
    found = [row for part in sorted(Path(out).glob("part-*")) for row in json.loads(part.read_text())]
    assert sorted(found, key=lambda r: r["a"]) == [{"a": 2}, {"a": 3, "c": None}]
