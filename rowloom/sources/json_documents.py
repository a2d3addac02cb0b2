"""JSON Array and JSON Object files: one document per file, cut into its records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import LINE, with_record
from .splitting import JSON_ROOT, split_records

def read_json_array(spark: SparkSession, path: str | list[str], separator: str = "}", on_damage: str = "fail") -> DataFrame:
    """One row per element: file, position (0-based), ``line`` (its exact text)
    and ``record`` (its variant). Elements may be of any kind.

    ``separator`` tunes how the file is read: "}" for arrays of objects, "," for
    arrays of plain values. Results are the same. ``on_damage``: a file cut short
    fails the run ("fail"), or its last element is given as far as it goes ("row").
    """
    parts = split_records(spark, path, JSON_ROOT, separator, on_damage=on_damage, root="]")
    elements = parts.where((F.col("number") > 0) & ~F.col("text").rlike(r"^\s*$"))
    placed = elements.select(
        "file", (F.col("number") - 1).alias("position"), F.trim(F.col("text"), F.lit(" \t\r\n")).alias(LINE)
    )
    return with_record(placed)


_ENTRY_KEY = r'^\s*"(?:[^"\\]++|\\.)*+"\s*:\s*'


def read_json_object(spark: SparkSession, path: str | list[str], separator: str = ",", on_damage: str = "fail") -> DataFrame:
    """One row per root entry: file, position, key, ``line`` (the value's exact
    text) and ``record``. A repeated key keeps its first place and last value.
    ``on_damage`` as for arrays."""
    parts = split_records(spark, path, JSON_ROOT, separator, on_damage=on_damage, root="}")
    text = F.col("text")
    entries = parts.where((F.col("number") > 0) & text.rlike(_ENTRY_KEY)).select(
        "file",
        (F.col("number") - 1).alias("position"),
        F.json_object_keys(F.concat(F.lit("{"), text, F.lit("}")))[0].alias("key"),
        F.trim(F.regexp_replace(text, _ENTRY_KEY, ""), F.lit(" \t\r\n")).alias(LINE),
    )
    last = F.max_by(LINE, "position").alias(LINE)
    entries = entries.groupBy("file", "key").agg(F.min("position").alias("position"), last)
    return with_record(entries.select("file", "position", "key", LINE))
