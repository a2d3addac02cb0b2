import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.types import ColumnType
from rowloom.operators.predicates import batch_test, typed_test, view_test
from rowloom.plans.apply import apply_recipe, matched_rows
from rowloom.recipes import Cast, Comparison, Fill, FormatTimestamp, Operator, Rename, where


def passing(spark, texts, test):
    frame = spark.createDataFrame([(t,) for t in texts], "c string")
    kept = {row[0] for row in frame.where(test(F.col("c"))).collect()}
    return [t for t in texts if t in kept]


@pytest.mark.parametrize(
    ("operator", "low", "at", "high"),
    [("GreaterThan", False, False, True), ("LessThan", True, False, False), ("GreaterThanOrEqual", False, True, True), ("LessThanOrEqual", True, True, False)],
)
@pytest.mark.parametrize(
    ("kind", "comparison", "values", "limit"),
    [
        (ColumnType.WHOLE, "Number", ["19", "20", "21"], "20"),
        (ColumnType.FLOAT, "Number", ["1.9", "2.0", "2.1"], "2.0"),
        (ColumnType.TIMESTAMP, "Timestamp", ["2024-06-14", "2024-06-15", "2024-06-16"], "2024-06-15"),
    ],
)
def test_ordering_below_at_above(spark, operator, low, at, high, kind, comparison, values, limit):
    expected = [v for v, keep in zip(values, (low, at, high), strict=True) if keep]
    op = Operator(operator)
    assert passing(spark, values, lambda c: batch_test(c, op, Comparison(comparison), limit)) == expected
    assert passing(spark, values, lambda c: view_test(c, op, kind, limit)) == expected


def test_batch_numbers_per_row(spark):
    def above(limit):
        return lambda c: batch_test(c, Operator.GREATER_THAN, Comparison.NUMBER, limit)

    assert passing(spark, ["42", "40.5", "30", "x", "", "NaN", "1,000", "Infinity", "9223372036854775808"], above("40")) == ["42", "40.5", "1,000", "Infinity", "9223372036854775808"]
    assert passing(spark, ["40", "41", "40.6"], above("40.5")) == ["41", "40.6"]
    # Beyond 2**53 integers are still told apart.
    assert passing(spark, ["9007199254740992", "9007199254740993"], above("9007199254740992")) == ["9007199254740993"]


def test_view_types_decide(spark):
    above = Operator.GREATER_THAN
    assert passing(spark, ["5", "5.5", "x"], lambda c: view_test(c, above, ColumnType.WHOLE, "4")) == ["5"]
    assert passing(spark, ["5", "5.5", "x"], lambda c: view_test(c, above, ColumnType.WHOLE, "4.5")) == []
    assert passing(spark, ["5", "5.5", "x"], lambda c: view_test(c, above, ColumnType.FLOAT, "4.5")) == ["5", "5.5"]
    for kind in (ColumnType.TEXT, ColumnType.BOOLEAN, ColumnType.OBJECT, ColumnType.ARRAY):
        assert passing(spark, ["5"], lambda c, kind=kind: view_test(c, above, kind, "4")) == []


def test_text_operators_ignore_case_without_locale_rules(spark):
    texts = ["Alice", "ALICE", "malice", "Bob", "Straße", "ÉCOLE", "", "50%", "a_b"]

    def by(operator, value):
        return passing(spark, texts, lambda c: batch_test(c, Operator(operator), Comparison.TEXT, value))

    assert by("Equals", "alice") == ["Alice", "ALICE"]
    assert by("NotEquals", "alice") == [t for t in texts if t.lower() != "alice"]
    assert by("Contains", "LIC") == ["Alice", "ALICE", "malice"]
    assert by("NotContains", "lic") == ["Bob", "Straße", "ÉCOLE", "", "50%", "a_b"]
    assert by("StartsWith", "al") == ["Alice", "ALICE"]
    assert by("EndsWith", "ICE") == ["Alice", "ALICE", "malice"]
    assert by("Contains", "strasse") == [] and by("StartsWith", "école") == ["ÉCOLE"]
    assert by("Contains", "%") == ["50%"] and by("Contains", "_") == ["a_b"] and by("Contains", "") == texts
    assert by("Equals", "") == [""]


def test_numbers_are_equal_as_text(spark):
    assert passing(spark, ["42", "42.0", "042"], lambda c: batch_test(c, Operator.EQUALS, Comparison.NUMBER, "42")) == ["42"]


TYPED = [
    (T.IntegerType(), [1, 20, 21, None], "Number", ["20", "20.5", "-1", "1e2"]),
    (T.LongType(), [2**60, -5, 0, None], "Number", ["0", "0.5", "-4.5", "1152921504606846975"]),
    (T.DoubleType(), [1.5, 20.0, float("nan"), None, float("inf")], "Number", ["1.5", "20", "0"]),
    (T.TimestampType(), [datetime.datetime(2024, 1, 15), datetime.datetime(2024, 1, 15, 12), None], "Timestamp", ["2024-01-15", "1/15/2024 6:00"]),
    (T.TimestampNTZType(), [datetime.datetime(2024, 1, 15), datetime.datetime(2024, 1, 15, 12), None], "Timestamp", ["2024-01-15", "1/15/2024 6:00"]),
    (T.DateType(), [datetime.date(2024, 1, 15), datetime.date(2024, 1, 16), None], "Timestamp", ["2024-01-15", "2024-01-15 12:00"]),
    (T.BooleanType(), [True, False, None], "Text", ["TRUE"]),
    (T.StringType(), ["A", "b", None], "Text", ["a"]),
]


@pytest.mark.parametrize(("data_type", "values", "comparison", "limits"), TYPED)
def test_typed_columns_pass_the_same_rows_as_their_text(spark, data_type, values, comparison, limits):
    from rowloom.functions.text import cell_text

    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.LongType()), T.StructField("c", data_type)]))
    for limit in limits:
        for operator in Operator:
            ordering = operator.is_ordering
            if ordering == (comparison == "Text") and not operator.is_equality:
                continue
            kind = Comparison(comparison)
            native = {r[0] for r in frame.where(typed_test(F.col("c"), data_type, operator, kind, limit)).select("i").collect()}
            text = {r[0] for r in frame.where(batch_test(cell_text(F.col("c"), data_type), operator, kind, limit)).select("i").collect()}
            assert native == text, (operator, limit)


def people(spark):
    rows = [("Alice", "30", "2026-01-15T10:30:00"), ("Bob", "42", "2026-03-02T08:05:00"), ("Charlie", "35", "2026-05-20T18:45:00")]
    return spark.createDataFrame(rows, "name string, age string, joined string")


def test_filters_read_the_source_cell(spark):
    actions = [Fill("age", "0"), Rename("age", "years"), where("years", "GreaterThan", "30", "Number"), where("age", "Equals", "nobody")]
    got = apply_recipe(people(spark), actions)
    assert got.columns == ["name", "years", "joined"]
    assert [(r.name, r.years) for r in got.collect()] == [("Bob", "0"), ("Charlie", "0")]


def test_unreadable_timestamp_fails_the_batch_run_and_marks_the_view(spark):
    frame = spark.createDataFrame([("2024-03-15",), ("soon",)], "d string")
    with pytest.raises(Exception, match="Not a readable timestamp: 'soon'"):
        apply_recipe(frame, [FormatTimestamp("d", "yyyyMMdd")]).collect()
    view = apply_recipe(frame, [FormatTimestamp("d", "yyyyMMdd")], "view", {"d": ColumnType.TIMESTAMP})
    assert [r[0] for r in view.collect()] == ["20240315", "<invalid>"]
    # In a view only timestamp columns are reformatted.
    assert [r[0] for r in apply_recipe(frame, [FormatTimestamp("d", "yyyy")], "view").collect()] == ["2024-03-15", "soon"]


@pytest.mark.parametrize(
    ("text", "target", "shown"),
    [
        ("42", "WHOLE", "42"), ("007", "WHOLE", "7"), ("3.14", "FLOAT", "3.14"), ("3.10", "FLOAT", "3.1"), ("true", "BOOLEAN", "true"), ("TRUE", "BOOLEAN", "true"),
        ("not-a-number", "WHOLE", "<invalid>"), ("3.14", "WHOLE", "<invalid>"), ("yes", "BOOLEAN", "<invalid>"),
        ("not-a-date", "TIMESTAMP", "<invalid>"), ("1/5/2024", "TIMESTAMP", "2024-01-05 00:00:00"), ("x", "OBJECT", "x"), (" x ", "TEXT", " x "),
    ],
)
def test_view_casts(spark, text, target, shown):
    frame = spark.createDataFrame([(text,)], "c string")
    assert apply_recipe(frame, [Cast("c", ColumnType[target])], "view").first()[0] == shown
    assert apply_recipe(frame, [Cast("c", ColumnType[target])]).first()[0] == text


@pytest.mark.parametrize(("value", "label"), [("42", "number"), ("3.14", "float"), ("true", "bool"), ("hello", "text"), ("", "text")])
def test_view_fill_sets_the_type_and_is_shown_as_it_is(spark, value, label):
    got = apply_recipe(people(spark), [Fill("age", value), Cast("name", ColumnType.WHOLE)], "view", labels=True)
    assert got.columns == ["name (number)", f"age ({label})", "joined (text)"]
    assert {r[1] for r in got.collect()} == {value}
    kept = apply_recipe(people(spark), [Fill("age", "hello"), Cast("age", ColumnType.WHOLE)], "view")
    assert {r.age for r in kept.collect()} == {"hello"}


def test_view_types_start_from_the_schema(spark):
    types = {"age": ColumnType.WHOLE}
    kept = apply_recipe(people(spark), [where("age", "GreaterThan", "30", "Number")], "view", types)
    assert [r.name for r in kept.collect()] == ["Bob", "Charlie"]
    assert apply_recipe(people(spark), [where("age", "GreaterThan", "30", "Number")], "view").count() == 0


def test_matched_rows(spark):
    frame = people(spark).withColumn("position", F.col("age").cast("long"))
    assert [r[0] for r in matched_rows(frame, [where("name", "Contains", "B")], "position").collect()] == [42]
