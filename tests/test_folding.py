import pytest
from pyspark.sql import functions as F

from rowloom.functions.folding import fold, replacements, upper_of
from rowloom.operators.predicates import text_test
from rowloom.recipes import Operator


def same(a: str, b: str) -> bool:
    return [upper_of(c) for c in a] == [upper_of(c) for c in b]


def test_folding_is_the_uppercase_relation():
    by_upper, by_fold = {}, {}
    for code in (*range(0xD800), *range(0xF900, 0x10000)):
        by_upper.setdefault(upper_of(chr(code)), []).append(code)
        by_fold.setdefault(fold(chr(code)), []).append(code)
    assert sorted(by_upper.values()) == sorted(by_fold.values())
    assert all(not c.isascii() for c in replacements())


TEXTS = ["Kelvin K", "Kelvin", "kelvin", "İstanbul", "istanbul", "ISTANBUL", "ıstanbul", "miſs", "MISS", "ΟΔΟΣ", "οδος",
         "οδοσ", "straße", "STRASSE", "STRAẞE", "Ångström", "ÅNGSTRÖM", "µm", "μm", "ǅa", "ǆA", "", "x" * 50 + "Kelvin"]


@pytest.mark.parametrize("value", ["kelvin", "K", "i", "ISTANBUL", "miss", "οδοσ", "ΟΔΟΣ", "straße", "ångström", "μM", "Ǆa", "İ"])
def test_text_tests_agree_with_the_relation(spark, value):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "c string")
    n = len(value)
    expected = {
        Operator.EQUALS: lambda t: same(t, value),
        Operator.CONTAINS: lambda t: any(same(t[i : i + n], value) for i in range(len(t))),
        Operator.STARTS_WITH: lambda t: same(t[:n], value),
        Operator.ENDS_WITH: lambda t: same(t[-n:], value),
    }
    for operator, test in expected.items():
        got = {r[0] for r in frame.where(text_test(F.col("c"), operator, value)).collect()}
        assert got == {t for t in TEXTS if test(t)}, operator
