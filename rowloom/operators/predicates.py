"""Row tests: ten operators over text, numbers and timestamps.

Every test is a bare boolean expression used inside ``where``. A NULL operand
makes it NULL, which ``where`` drops, so no test is wrapped in ``coalesce`` and
plain comparisons stay visible to the file readers for pushdown.
"""

from __future__ import annotations

import math
import operator as op

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folding import fold, folded
from ..functions.parsing import literal_float, literal_is_whole, parse_float, parse_timestamp, parse_whole
from ..functions.text import cell_text
from ..functions.types import ColumnType
from ..recipes.actions import Comparison, Operator

_COMPARE = {
    Operator.GREATER_THAN: op.gt,
    Operator.LESS_THAN: op.lt,
    Operator.GREATER_OR_EQUAL: op.ge,
    Operator.LESS_OR_EQUAL: op.le,
}
_PLAIN = {
    Operator.EQUALS: op.eq,
    Operator.NOT_EQUALS: op.eq,
    Operator.CONTAINS: F.contains,
    Operator.NOT_CONTAINS: F.contains,
    Operator.STARTS_WITH: F.startswith,
    Operator.ENDS_WITH: F.endswith,
}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONS = (T.FloatType, T.DoubleType)


def text_test(text: Column, operator: Operator, value: str) -> Column:
    """Case-insensitive, character by character, no locale rules. Only as much
    of a text as the value can match is looked at; a value without letters is
    compared as it is, which the file readers understand."""
    negated = operator in (Operator.NOT_EQUALS, Operator.NOT_CONTAINS)
    if value.lower() == value.upper():
        found = _PLAIN[operator](text, F.lit(value))
    else:
        size = len(value)
        part = {
            Operator.EQUALS: F.left(text, F.lit(size + 1)),
            Operator.NOT_EQUALS: F.left(text, F.lit(size + 1)),
            Operator.STARTS_WITH: F.left(text, F.lit(size)),
            Operator.ENDS_WITH: F.right(text, F.lit(size)),
        }.get(operator, text)
        compare = F.contains if operator in (Operator.CONTAINS, Operator.NOT_CONTAINS) else op.eq
        found = compare(folded(part, value), F.lit(fold(value)))
    return ~found if negated else found


def whole_test(text: Column, operator: Operator, value: str) -> Column:
    """Both sides must be 64-bit integers."""
    if not literal_is_whole(value):
        return F.lit(False)
    return _COMPARE[operator](parse_whole(text), F.lit(int(value)).cast("bigint"))


def float_test(text: Column, operator: Operator, value: str) -> Column:
    limit = literal_float(value)
    if limit is None or math.isnan(limit):
        return F.lit(False)
    number = F.nanvl(parse_float(text), F.lit(None).cast("double"))
    return _COMPARE[operator](number, F.lit(limit))


def number_test(text: Column, operator: Operator, value: str) -> Column:
    """Integers are compared as integers only if both sides are; else as doubles."""
    as_double = float_test(text, operator, value)
    if not literal_is_whole(value):
        return as_double
    return F.coalesce(whole_test(text, operator, value), as_double)


def timestamp_test(text: Column, operator: Operator, value: str) -> Column:
    return _COMPARE[operator](parse_timestamp(text), parse_timestamp(F.lit(value)))


def batch_test(text: Column, operator: Operator, comparison: Comparison, value: str) -> Column:
    """Test on cell text; how to compare is chosen by the recipe."""
    if not operator.is_ordering:
        return text_test(text, operator, value)
    return (number_test if comparison is Comparison.NUMBER else timestamp_test)(text, operator, value)


def view_test(text: Column, operator: Operator, column_type: ColumnType, value: str) -> Column:
    """Test on cell text; how to compare follows from the column's current type."""
    if not operator.is_ordering:
        return text_test(text, operator, value)
    by_type = {ColumnType.WHOLE: whole_test, ColumnType.FLOAT: float_test, ColumnType.TIMESTAMP: timestamp_test}
    if column_type not in by_type:
        return F.lit(False)
    return by_type[column_type](text, operator, value)


def typed_test(column: Column, data_type: T.DataType, operator: Operator, comparison: Comparison, value: str) -> Column:
    """Test on a column that already has a Spark type: compared natively where the
    result is the same as on its text, so that it reaches the file scan."""
    if isinstance(data_type, _INTEGERS):
        native = _integer_test(column, operator, comparison, value)
    elif isinstance(data_type, _FRACTIONS) and comparison is Comparison.NUMBER and operator.is_ordering:
        native = _COMPARE[operator](column, F.lit(literal_float(value))) & ~F.isnan(column)
    elif isinstance(data_type, T.DecimalType) and comparison is Comparison.NUMBER and operator.is_ordering:
        native = _COMPARE[operator](column, F.lit(value).try_cast(data_type) if _fits(value, data_type) else F.lit(literal_float(value)))
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)) and comparison is Comparison.TIMESTAMP and operator.is_ordering:
        native = _COMPARE[operator](column, parse_timestamp(F.lit(value)).cast(data_type))
    elif isinstance(data_type, T.DateType) and comparison is Comparison.TIMESTAMP and operator.is_ordering:
        native = _COMPARE[operator](column.cast("timestamp"), parse_timestamp(F.lit(value)))
    else:
        native = None
    if native is not None:
        return native
    return batch_test(cell_text(column, data_type), operator, comparison, value)


def _integer_test(column: Column, operator: Operator, comparison: Comparison, value: str) -> Column | None:
    if operator.is_equality and value == value.strip() and literal_is_whole(value) and str(int(value)) == value:
        limit = F.lit(int(value))
        return column == limit if operator is Operator.EQUALS else column != limit
    if not operator.is_ordering or comparison is not Comparison.NUMBER:
        return None
    if literal_is_whole(value):
        return _COMPARE[operator](column, F.lit(int(value)))
    limit = literal_float(value)
    if not -(2.0**53) < limit < 2.0**53:
        return None
    # A fractional limit is moved to the integer that splits the column alike.
    down = operator in (Operator.GREATER_THAN, Operator.LESS_OR_EQUAL)
    return _COMPARE[operator](column, F.lit(math.floor(limit) if down else math.ceil(limit)))


def _fits(value: str, data_type: T.DecimalType) -> bool:
    whole, _, fraction = value.strip().lstrip("+-").partition(".")
    return (whole + fraction).isdigit() and len(fraction) <= data_type.scale and len(whole) <= data_type.precision - data_type.scale
