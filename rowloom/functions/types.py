"""Logical column types, their labels, codes and merge rule."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ColumnType(Enum):
    TEXT = "Text"
    WHOLE = "WholeNumber"
    FLOAT = "FloatingPoint"
    BOOLEAN = "Boolean"
    TIMESTAMP = "Timestamp"
    OBJECT = "JsonObject"
    ARRAY = "JsonArray"

    @property
    def code(self) -> int:
        return _CODES[self]

    @property
    def label(self) -> str:
        return _LABELS[self]

    @classmethod
    def named(cls, name: str) -> ColumnType:
        """Case-sensitive lookup by the name used in recipe files."""
        for member in cls:
            if member.value == name:
                return member
        raise ValueError(f"There is no column type '{name}'.")


_CODES = {member: bit for bit, member in enumerate(ColumnType)}

# Header labels.
_LABELS = {
    ColumnType.TEXT: "text",
    ColumnType.WHOLE: "number",
    ColumnType.FLOAT: "float",
    ColumnType.BOOLEAN: "bool",
    ColumnType.TIMESTAMP: "datetime",
    ColumnType.OBJECT: "object",
    ColumnType.ARRAY: "array",
}

NUMERIC_MASK = (1 << ColumnType.WHOLE.code) | (1 << ColumnType.FLOAT.code)


def type_bit(code: Column) -> Column:
    """One bit per logical type, so that types merge with ``bit_or``."""
    return F.when(code.isNotNull(), F.call_function("shiftleft", F.lit(1), code)).otherwise(F.lit(0))


def merged_type_name(mask: Column) -> Column:
    """Logical type of everything seen in a mask: alone it stays, whole and
    float widen to float, any other mix (or nothing at all) is text."""
    out = F.when(mask == NUMERIC_MASK, ColumnType.FLOAT.value)
    for member in ColumnType:
        out = out.when(mask == (1 << member.code), member.value)
    return out.otherwise(ColumnType.TEXT.value)


def merge_types(left: ColumnType, right: ColumnType) -> ColumnType:
    if left is right:
        return left
    if {left, right} == {ColumnType.WHOLE, ColumnType.FLOAT}:
        return ColumnType.FLOAT
    return ColumnType.TEXT


def label_of(type_name: Column) -> Column:
    out = None
    for member in ColumnType:
        test = type_name == member.value
        out = F.when(test, member.label) if out is None else out.when(test, member.label)
    return out


def logical_type(data_type: T.DataType) -> ColumnType:
    """Logical type of a column that already has a Spark type."""
    if isinstance(data_type, T.BooleanType):
        return ColumnType.BOOLEAN
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return ColumnType.WHOLE
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return ColumnType.FLOAT
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ColumnType.TIMESTAMP
    if isinstance(data_type, (T.StructType, T.MapType)):
        return ColumnType.OBJECT
    if isinstance(data_type, T.ArrayType):
        return ColumnType.ARRAY
    return ColumnType.TEXT


# Cast targets allowed per file format.
_SCALARS = (ColumnType.TEXT, ColumnType.WHOLE, ColumnType.FLOAT, ColumnType.BOOLEAN, ColumnType.TIMESTAMP)
CAST_TARGETS = {
    "csv": _SCALARS,
    "jsonl": tuple(ColumnType),
    "json_array": tuple(ColumnType),
    "json_object": tuple(ColumnType),
}


def check_cast_target(data_format: str, target: ColumnType) -> None:
    if target not in CAST_TARGETS[data_format]:
        raise ValueError(f"A {data_format} column cannot be cast to {target.value}.")
