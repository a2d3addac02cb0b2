"""Flatten objects to dotted columns, explode arrays next to their parent fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_cells as J
from ..plans.cells import column


def flatten_object(df: DataFrame, name: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Replace an object column by one column ``<name>.<key>`` per key.

    A struct column brings its own keys; for a variant column they are given.
    """
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.StructType):
        keys = data_type.fieldNames() if keys is None else keys
        parts = [column(name).getField(key).alias(f"{name}.{key}") for key in keys]
    elif keys is None:
        raise ValueError("Keys of a variant column must be given.")
    else:
        parts = [J.member(column(name), key).alias(f"{name}.{key}") for key in keys]
    return df.select(*(part for c in df.columns for part in (parts if c == name else [column(c)])))


def explode_array(df: DataFrame, name: str) -> DataFrame:
    """One row per element of an array column (or variant array), the other
    fields repeated. Rows without elements vanish."""
    values = column(name)
    if not isinstance(df.schema[name].dataType, T.ArrayType):
        values = J.elements(values)
    return df.select(*(F.explode(values).alias(name) if c == name else column(c) for c in df.columns))
