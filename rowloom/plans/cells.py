"""Handles on source cells: what a test reads, what a table or JSON row gets.

A handle holds column expressions only; nothing is evaluated here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import is_bool, parse_float, parse_timestamp, parse_whole, trimmed
from ..functions.text import INVALID_TEXT, NULL_TEXT, cell_text, double_text
from ..functions.timestamp_format import DEFAULT_FORMAT, format_timestamp
from ..functions.types import ColumnType
from ..operators.predicates import batch_test, typed_test, view_test
from .plan import OutputColumn, RowTest


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quote_name(name))


def json_string(text: Column) -> Column:
    """Text as a quoted JSON string."""
    return F.to_json(text.cast("variant"))


class Stages:
    """Values used more than once by the final columns: computed one ``select``
    earlier, so that their code is generated and run once per row."""

    def __init__(self) -> None:
        self._steps: list[list[Column]] = []

    def keep(self, value: Column, step: int = 0) -> Column:
        while len(self._steps) <= step:
            self._steps.append([])
        name = f"__stage_{step}_{len(self._steps[step])}"
        self._steps[step].append(value.alias(name))
        return F.col(name)

    def before(self, df: DataFrame) -> DataFrame:
        for columns in self._steps:
            df = df.select("*", *columns) if columns else df
        return df


def sniffed_json(text: Column, stages: Stages, step: int = 0) -> Column:
    """JSON value of untyped text: boolean, then integer, then double, then string."""
    whole, number = stages.keep(parse_whole(text), step), stages.keep(parse_float(text), step)
    return (
        F.when(is_bool(text), F.lower(trimmed(text)))
        .when(whole.isNotNull(), whole.cast("string"))
        .when(number.isNotNull(), json_number(number, text))
        .otherwise(json_string(text))
    )


def json_number(number: Column, text: Column) -> Column:
    """JSON has no NaN or infinity: writing one fails the run."""
    not_finite = F.isnan(number) | (F.abs(number) == float("inf"))
    failure = F.raise_error(F.concat(F.lit("Not a JSON number: "), text)).cast("string")
    return F.when(not_finite, failure).otherwise(double_text(number))


class Cell:
    """One source column: ``text`` is NULL where there is no value."""

    text: Column
    table_value: Column

    def test(self, row_test: RowTest) -> Column:
        return batch_test(self.text, row_test.operator, row_test.comparison, row_test.value)

    def json(self, stages: Stages) -> Column:
        """JSON text of the member value; NULL leaves the member out."""
        raise NotImplementedError

    def timestamp(self) -> Column:
        return parse_timestamp(self.text)

    def view_text(self) -> Column:
        """What a view shows and tests."""
        return self.text


@dataclass
class CsvCell(Cell):
    """A CSV cell: always text, empty when nothing stands between the commas."""

    text: Column

    @property
    def table_value(self) -> Column:
        return self.text

    def json(self, stages: Stages) -> Column:
        return sniffed_json(self.text, stages)


@dataclass
class TypedCell(Cell):
    """A column of any Spark type, e.g. from parquet. NULL fails every test."""

    value: Column
    data_type: T.DataType

    @property
    def text(self) -> Column:
        return cell_text(self.value, self.data_type)

    @property
    def table_value(self) -> Column:
        return self.value

    def test(self, row_test: RowTest) -> Column:
        return typed_test(self.value, self.data_type, row_test.operator, row_test.comparison, row_test.value)

    def json(self, stages: Stages) -> Column:
        kind = self.data_type
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            plain = json_number(stages.keep(self.value.cast("double")), self.text)
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            plain = self.value.cast("string")
        elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
            plain = F.to_json(self.value)
        else:
            plain = json_string(self.text)
        return F.when(self.value.isNull(), "null").otherwise(plain)

    def timestamp(self) -> Column:
        if isinstance(self.data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return self.value.cast("timestamp")
        return super().timestamp()

    def view_text(self) -> Column:
        return F.coalesce(self.text, F.lit(NULL_TEXT))


@dataclass
class DisplayCell(Cell):
    """A cell given as the text a view shows, sentinels included."""

    text: Column

    @property
    def table_value(self) -> Column:
        return self.text

    def json(self, stages: Stages) -> Column:
        return json_string(self.text)


# ------------------------------------------------------------------ batch mode

def batch_text(cell: Cell, out: OutputColumn) -> Column | None:
    """Text of a transformed column, or None where the source cell passes through."""
    if out.fill is not None:
        return F.lit(out.fill)
    if out.target_format is not None:
        failure = F.raise_error(
            F.concat(F.lit("Not a readable timestamp: '"), F.coalesce(cell.text, F.lit("")), F.lit("'"))
        ).cast("string")
        return F.coalesce(format_timestamp(cell.timestamp(), out.target_format), failure)
    return None


def batch_value(cell: Cell, out: OutputColumn, stages: Stages) -> Column:
    text = batch_text(cell, out)
    return cell.table_value if text is None else text


def batch_json(cell: Cell, out: OutputColumn, stages: Stages) -> Column:
    text = batch_text(cell, out)
    return cell.json(stages) if text is None else sniffed_json(stages.keep(text), stages, step=1)


# ------------------------------------------------------------------- view mode

def view_condition(cell: Cell, row_test: RowTest) -> Column:
    return view_test(cell.view_text(), row_test.operator, row_test.column_type, row_test.value)


def view_value(cell: Cell, out: OutputColumn, stages: Stages) -> Column:
    """Cell text by the column's final type; unreadable text shows a marker."""
    if out.fill is not None:
        return F.lit(out.fill)
    text, kind = cell.view_text(), out.column_type
    if kind is ColumnType.WHOLE:
        shown = parse_whole(text).cast("string")
    elif kind is ColumnType.FLOAT:
        shown = double_text(stages.keep(parse_float(text)))
    elif kind is ColumnType.BOOLEAN:
        shown = F.when(is_bool(text), F.lower(trimmed(text)))
    elif kind is ColumnType.TIMESTAMP:
        shown = format_timestamp(cell.timestamp(), out.target_format or DEFAULT_FORMAT)
    else:
        return text
    return F.coalesce(shown, F.lit(INVALID_TEXT))


def typed_view_value(cell: Cell, out: OutputColumn, stages: Stages) -> Column:
    """As ``view_value`` with a Spark type instead of text; NULL where unreadable."""
    text, kind = (F.lit(out.fill) if out.fill is not None else cell.text), out.column_type
    if kind is ColumnType.WHOLE:
        return parse_whole(text)
    if kind is ColumnType.FLOAT:
        return parse_float(text)
    if kind is ColumnType.BOOLEAN:
        return F.lower(trimmed(F.when(is_bool(text), text))) == "true"
    if kind is ColumnType.TIMESTAMP and out.fill is None:
        return cell.timestamp()
    return parse_timestamp(text) if kind is ColumnType.TIMESTAMP else text
