import datetime
import math

import pytest
from pyspark.sql import functions as F

from rowloom.functions import parsing as P
from rowloom.functions.text import double_text
from rowloom.functions.timestamp_format import format_timestamp
from rowloom.functions.types import ColumnType, merge_types, merged_type_name, type_bit


def values(spark, texts, column):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    return [row[0] for row in frame.orderBy("i").select(column(F.col("c"))).collect()]


def test_booleans_are_two_words_only(spark):
    good = ["true", "TRUE", "True", "  true  ", "false", "FALSE", "  false  "]
    bad = ["truee", "tru", "fals", "yes", "no", "1", "0", "t", "", "   "]
    assert values(spark, good, P.parse_bool) == [True, True, True, True, False, False, False]
    assert values(spark, bad, P.parse_bool) == [None] * len(bad)


def test_whole_numbers(spark):
    good = {"123": 123, "-456789": -456789, "-0": 0, "  789  ": 789, "+5": 5, "007": 7, "9223372036854775807": 2**63 - 1, "-9223372036854775808": -(2**63)}
    assert values(spark, good, P.parse_whole) == list(good.values())
    bad = ["12.34", "12abc", "abc123", "1.5e10", "", "   ", "9223372036854775808", "1,000"]
    assert values(spark, bad, P.parse_whole) == [None] * len(bad)
    for text in [*good, *bad]:
        assert P.literal_is_whole(text) == (text in good)


def test_floats(spark):
    good = {
        "12.34": 12.34, "1,002.34": 1002.34, "-0.5": -0.5, "123": 123.0, "1.5e10": 1.5e10, "-2.3E-5": -2.3e-5,
        "  3.14  ": 3.14, "1.": 1.0, ".5": 0.5, "1,,2": 12.0, "Infinity": math.inf, "-Infinity": -math.inf,
    }
    assert values(spark, good, lambda c: P.parse_float(c, lenient=False)) == list(good.values())
    assert math.isnan(values(spark, ["NaN"], P.parse_float)[0])
    bad = ["12.34abc", "abc", "", "   ", "10d", "10f", "0x1p3", "inf", ".", "1e", ",1", "12.34.56", "(1", "+1-"]
    assert values(spark, bad, P.parse_float) == [None] * len(bad)
    dressed = {"(5)": -5.0, "5-": -5.0, "¤7": 7.0, "7+": 7.0, "(1,000.5)": -1000.5}
    assert values(spark, dressed, P.parse_float) == list(dressed.values())
    assert values(spark, dressed, lambda c: P.parse_float(c, lenient=False)) == [None] * len(dressed)
    for text in [*good, *dressed]:
        assert P.literal_float(text) == {**good, **dressed}[text]
    for text in bad:
        assert P.literal_float(text) is None


MOMENTS = {
    "2024-01-15": (2024, 1, 15), "2024-01-15T10:30:00": (2024, 1, 15, 10, 30), "2024-01-15T10:30:00Z": (2024, 1, 15, 10, 30),
    "2024-01-01T12:00:00+09:00": (2024, 1, 1, 3), "2024-01-15T10:30+09:00": (2024, 1, 15, 1, 30), "  2024-01-15  ": (2024, 1, 15),
    "\t2024-01-01\n": (2024, 1, 1), "2024-01-01T12:00:00.123456Z": (2024, 1, 1, 12, 0, 0, 123456), "1/15/2024": (2024, 1, 15),
    "1/15/24": (2024, 1, 15), "1/15/51 3:04 PM": (1951, 1, 15, 15, 4), "12/31/2023 12:05 am": (2023, 12, 31, 0, 5),
    "Jan 15, 2024": (2024, 1, 15), "15 January 2024 10:00": (2024, 1, 15, 10), "Mon, 15 Jan 2024 10:30:00 GMT": (2024, 1, 15, 10, 30),
    "2024/02/03 4:05:06.789": (2024, 2, 3, 4, 5, 6, 789000), "2024-01": (2024, 1, 1), "March 2024": (2024, 3, 1),
    "15-Mar-2024": (2024, 3, 15), "2/29/2024": (2024, 2, 29),
}
NO_MOMENTS = ["invalid-date", "2024-13-45", "2024-13-01", "not-a-date", "", "   ", "hello", "13/45/2024", "2023-02-29", "2/30/2024",
              "may I ask", "1.5", "2024", "12345", "monday morning", "2024-01-15 25:00:00", "0000-01-01"]


def test_timestamps(spark):
    assert values(spark, MOMENTS, P.parse_timestamp) == [datetime.datetime(*parts) for parts in MOMENTS.values()]
    assert values(spark, NO_MOMENTS, P.parse_timestamp) == [None] * len(NO_MOMENTS)


@pytest.mark.parametrize("text", [*MOMENTS, *NO_MOMENTS, "10:30"])
def test_literal_timestamps_agree_with_columns(text):
    assert P.literal_is_timestamp(text) == (text in MOMENTS or text == "10:30")


def test_cell_types(spark):
    expected = {
        "true": "BOOLEAN", "TRUE": "BOOLEAN", "123": "WHOLE", "-456": "WHOLE", "0": "WHOLE", "12.34": "FLOAT", "1,002.34": "FLOAT",
        "1.5e10": "FLOAT", "NaN": "FLOAT", "2024-01-15": "TIMESTAMP", "1/15/2024": "TIMESTAMP", "hello world": "TEXT",
        "abc123def": "TEXT", "12.34.56": "TEXT", "not-a-date-or-number": "TEXT", "": "TEXT", "   ": "TEXT",
    }
    assert values(spark, expected, P.text_type_code) == [ColumnType[name].code for name in expected.values()]
    for text, name in expected.items():
        assert P.literal_type(text) is ColumnType[name]


def test_type_merge_is_the_same_for_pairs_and_masks(spark):
    pairs = [(a, b) for a in ColumnType for b in ColumnType]
    frame = spark.createDataFrame([(a.code, b.code) for a, b in pairs], "a int, b int")
    mask = type_bit(F.col("a")).bitwiseOR(type_bit(F.col("b")))
    merged = [row[0] for row in frame.coalesce(1).select(merged_type_name(mask)).collect()]
    assert merged == [merge_types(a, b).value for a, b in pairs]
    assert merge_types(ColumnType.WHOLE, ColumnType.FLOAT) is ColumnType.FLOAT
    assert merge_types(ColumnType.OBJECT, ColumnType.ARRAY) is ColumnType.TEXT
    assert merge_types(ColumnType.BOOLEAN, ColumnType.WHOLE) is ColumnType.TEXT


def test_double_text(spark):
    expected = {1.0: "1", 0.1: "0.1", 1e7: "10000000", 1.5e10: "15000000000", 1e14: "100000000000000", 1e15: "1E+15", 1e-4: "0.0001",
                1e-5: "1E-05", 1.25e-7: "1.25E-07", 0.0: "0", -2.5e-3: "-0.0025", 99999999.99: "99999999.99", 1.5e300: "1.5E+300",
                math.inf: "Infinity", -1e20: "-1E+20"}
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(expected)], "i int, d double").orderBy("i")
    assert [row[0] for row in frame.select(double_text(F.col("d"))).collect()] == list(expected.values())


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        ("yyyy-MM-dd", "2024-01-05"), ("yyyy/MM/dd", "2024/01/05"), ("MM/dd/yyyy", "01/05/2024"), ("dd-MM-yyyy", "05-01-2024"),
        ("yyyyMMdd", "20240105"), ("d", "01/05/2024"), ("o", "2024-01-05T15:04:09.1200000"), ("R", "Fri, 05 Jan 2024 15:04:09 GMT"),
        ("ddd d MMM yy", "Fri 5 Jan 24"), ("dddd MMMM", "Friday January"), ("h:mm tt", "3:04 PM"), ("H'h'm", "15h4"),
        ("yyyy-MM-ddTHH:mm:ss", "2024-01-05T15:04:09"), ("ss.fff", "09.120"), ("ss.FFFF", "09.12"), ("'day' dd", "day 05"),
        ("y", "2024 January"), ("%y", "24"), ("t", "15:04"), ("h t", "3 P"), ("s", "2024-01-05T15:04:09"), ("zzz", "+00:00"),
        ("\\yyy", "y24"), ("yyyy\"Y\"", "2024Y"), ("g", "01/05/2024 15:04"),
    ],
)
def test_timestamp_formats(spark, pattern, expected):
    moment = F.lit("2024-01-05 15:04:09.120").cast("timestamp")
    assert spark.range(1).select(format_timestamp(moment, pattern)).first()[0] == expected


def test_unknown_one_letter_format_fails_at_once():
    with pytest.raises(ValueError):
        format_timestamp(F.lit("2024-01-05").cast("timestamp"), "j")


def test_layouts_read_what_the_shapes_read(spark):
    """Every layout, with good and bad names, days, years and clocks."""
    texts = []
    for skeleton in P._LAYOUTS:
        for month, day, year, day_name, zone in (("Jan", "05", "2024", "Fri", "GMT"), ("anf", "05", "2024", "Fri", "GMT"), ("Feb", "31", "2024", "Mon", "UTC"), ("dec", "31", "0000", "sun", "gmt"), ("may", "01", "1999", "xyz", "utc"), ("Oct", "09", "0099", "thu", "est")):
            head = day_name if skeleton.startswith(("aaa, ", "aaa 99-", "aaa aaa")) or skeleton[4:].count("aaa") > skeleton[4:].count(":99 aaa") and skeleton.startswith("aaa ") else ""
            body = skeleton[len("aaa") :] if head else skeleton
            text = head + body.replace("aaa", month, 1).replace("9999", year, 1).replace("99:99:99", "23:59:08").replace("99:99", "07:30").replace("99", day, 1).replace("aaa", zone)
            texts += [text, f"  {text.upper()} "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", P._by_layout(F.col("t")).alias("fast"), P._other_timestamp(F.col("t")).alias("slow"), P.parse_timestamp(F.col("t")).alias("whole")).collect()
    assert all(r["fast"] in (None, r["slow"]) and r["whole"] == r["slow"] for r in rows)
    assert sum(r["fast"] is not None for r in rows) > 150
