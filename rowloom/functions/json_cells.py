"""JSON members as columns, on Spark variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ERROR_TEXT, NULL_TEXT, array_preview, double_text, object_preview
from .types import ColumnType

# What schema_of_variant starts with, and the JSON kind it means.
KINDS = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "BIGINT": "number",
    "DECIMAL": "number",
    "DOUBLE": "number",
}


def member_path(key: str) -> str | None:
    """Path of a top-level member; None if no quoting can express the key."""
    if "'" not in key:
        return f"$['{key}']"
    return f'$["{key}"]' if '"' not in key else None


def member(record: Column, key: str, data_type: str = "variant") -> Column:
    """Member of an object record. SQL NULL means absent, JSON null stays a
    variant; any other kind of record has no members."""
    path = member_path(key)
    if path is not None:
        return F.try_variant_get(record, path, data_type)
    entry = F.element_at(F.try_variant_get(record, "$", "map<string,variant>"), key)
    return entry if data_type == "variant" else F.try_variant_get(entry, "$", data_type)


def elements(value: Column) -> Column:
    """array<variant> of a JSON array, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def variant_type(value: Column) -> Column:
    """First word of the variant's schema: OBJECT, ARRAY, STRING, BIGINT, ..."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def kind(value: Column) -> Column:
    """object, array, string, boolean, null or number; NULL for an absent value."""
    name, out = variant_type(value), None
    for spark_name, json_name in KINDS.items():
        out = F.when(name == spark_name, json_name) if out is None else out.when(name == spark_name, json_name)
    return out


def display(value: Column, type_name: Column, number: Column | None = None) -> Column:
    """Cell text of a value in a view: numbers normalised, booleans capitalised,
    nested values as a preview, absent and null alike.

    ``type_name`` is ``variant_type(value)`` and ``number`` its double reading,
    both best given as already computed columns.
    """
    if number is None:
        number = as_double(value)
    return (
        F.when(value.isNull() | (type_name == "VOID"), NULL_TEXT)
        .when(type_name.isin("STRING", "BIGINT"), F.try_variant_get(value, "$", "string"))
        .when(type_name == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .when(type_name == "OBJECT", object_preview(property_count(value)))
        .when(type_name == "ARRAY", array_preview(element_count(value)))
        .when(number.isNotNull(), double_text(number))
        .otherwise(ERROR_TEXT)
    )


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def property_count(value: Column) -> Column:
    return F.size(F.try_variant_get(value, "$", "map<string,variant>"))


def element_count(value: Column) -> Column:
    return F.size(elements(value))


def preview(value: Column) -> Column:
    """``{Object: N properties}`` or ``[Array: N items]``; NULL for other kinds."""
    name = variant_type(value)
    return F.when(name == "OBJECT", object_preview(property_count(value))).when(
        name == "ARRAY", array_preview(element_count(value))
    )


def presence(line: Column, record: Column, key: str) -> Column:
    """value, null, missing or invalid: the state of one cell."""
    found = member(record, key)
    return (
        F.when(record.isNull() | ~is_object_line(line), "invalid")
        .when(found.isNull(), "missing")
        .when(F.is_variant_null(found), "null")
        .otherwise("value")
    )


def is_object_line(line: Column) -> Column:
    return line.rlike(r"^\s*\{")


def json_type_code(type_name: Column, text_is_timestamp: Column) -> Column:
    """Logical type code of a JSON value from its kind."""
    return (
        F.when(type_name == "OBJECT", ColumnType.OBJECT.code)
        .when(type_name == "ARRAY", ColumnType.ARRAY.code)
        .when(type_name == "BOOLEAN", ColumnType.BOOLEAN.code)
        .when(type_name == "BIGINT", ColumnType.WHOLE.code)
        .when(type_name.isin("DECIMAL", "DOUBLE"), ColumnType.FLOAT.code)
        .when((type_name == "STRING") & text_is_timestamp, ColumnType.TIMESTAMP.code)
        .when(type_name != "VOID", ColumnType.TEXT.code)
    )
