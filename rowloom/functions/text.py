"""Rendering values as cell text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXT = "<null>"
ERROR_TEXT = "<error>"
INVALID_TEXT = "<invalid>"


def double_text(value: Column) -> Column:
    """Shortest round-trip text of a double: positional from 1E-4 up to 1E+15,
    otherwise with a signed exponent of at least two digits."""
    short = value.cast("double").cast("string")
    size = F.abs(value)
    positional = F.regexp_replace(short.try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    digits = F.regexp_replace(F.regexp_extract(short, r"^(-?[\d.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(short, r"E(-?)(\d+)$", 2)
    sign = F.when(F.contains(short, F.lit("E-")), "-").otherwise("+")
    scientific = F.concat(digits, F.lit("E"), sign, F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    # Java writes plain digits between 1E-3 and 1E+7, where only a final ".0" differs.
    return (
        F.when((size >= 1e-3) & (size < 1e7), F.regexp_replace(short, r"\.0$", ""))
        .when(F.isnan(value) | (size == float("inf")), short)
        .when(value == 0, F.when(F.startswith(short, F.lit("-")), "-0").otherwise("0"))
        .when((size >= 1e-4) & (size < 1e15), positional)
        .otherwise(scientific)
    )


def grouped_count(count: Column) -> Column:
    return F.format_number(count, 0)


def timestamp_text(value: Column, keep_fraction: bool = True) -> Column:
    return value.cast("string") if keep_fraction else F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def cell_text(column: Column, data_type: T.DataType) -> Column:
    """Text of a table cell, whatever Spark type the column has."""
    if isinstance(data_type, T.StringType):
        return column
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return double_text(column)
    if isinstance(data_type, (T.StructType, T.MapType)):
        if isinstance(data_type, T.StructType):
            return F.when(column.isNotNull(), object_preview(F.lit(len(data_type.fields))))
        return F.when(column.isNotNull(), object_preview(F.size(column)))
    if isinstance(data_type, T.ArrayType):
        return F.when(column.isNotNull(), array_preview(F.size(column)))
    return column.cast("string")


def object_preview(count: Column) -> Column:
    return F.concat(F.lit("{Object: "), grouped_count(count), F.lit(" properties}"))


def array_preview(count: Column) -> Column:
    return F.concat(F.lit("[Array: "), grouped_count(count), F.lit(" items]"))
