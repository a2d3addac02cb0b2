"""Which format a file has."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_FORMATS = ("csv", "jsonl")


def format_of_path(path: str, allow_json: bool = True) -> str:
    """Format by extension, in any letter case: csv, jsonl, or json (array or object)."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension in (".csv", ".jsonl"):
        return extension[1:]
    if extension == ".json" and allow_json:
        return "json"
    raise ValueError(f"Files of this kind are not read: {extension or path}")


# A folder named like a file, as Spark writes them, gives its parts its extension.
_EXTENSION = re.compile(r"(\.(?:csv|jsonl|json))/[^/]+$|(\.[^./]*)$", re.I)


def _extension(path: str) -> str:
    match = _EXTENSION.search(path)
    return (match[1] or match[2]).lower() if match else ""


def detect_formats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, format, error) per file.

    The extension decides; for ``.json`` the first non-blank character after a
    byte order mark. Of other files only the names are read. Empty files hold no
    records and are not listed, as in any file scan.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    folder = F.lower(F.regexp_extract("path", r"(?i)(\.(?:csv|jsonl|json))/[^/]+$", 1))
    named = files.withColumn("extension", F.when(folder != "", folder).otherwise(extension))
    documents = [name for name in files.inputFiles() if _extension(name) == ".json"]
    marked = named.join(_first_marks(spark, documents), "path", "left")
    return marked.select("path", _format().alias("format"), _error().alias("error"))


def _first_marks(spark: SparkSession, names: list[str]) -> DataFrame:
    """(path, mark): the first character of each file that is not blank, in one job.

    Files are read in pieces up to a comma, so a document on one line is no long row, and
    a task stops at the first mark where its split is too large for a second file."""
    if not names:
        return spark.createDataFrame([], "path string, mark string")
    full = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    pieces = spark.read.option("lineSep", ",").text(names).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("length"), F.left(F.ltrim("value", F.lit("\ufeff \t\r\n")), F.lit(1)).alias("first"), F.rlike("value", F.lit(r"[^\s\ufeff]")).alias("filled"),
    )
    marks = pieces.mapInArrow(lambda batches: _marks(batches, full), "path string, block bigint, mark string")
    return marks.groupBy("path").agg(F.min_by("mark", "block").alias("mark"))


def _marks(batches: Iterator[pa.RecordBatch], full: int) -> Iterator[pa.RecordBatch]:
    done, blank = None, None
    for batch in batches:
        found = []
        for path, block, length, first, filled in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            split = (path, block)
            if split == done:
                continue
            if not filled and blank != split:
                blank = split
                continue
            # What follows a blank piece is the comma that ended it.
            mark = "," if blank == split else first
            found.append((path, block, mark))
            done = split
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "block", "mark"])
        if done == split and length >= full:
            return


def _format() -> Column:
    extension, mark = F.col("extension"), F.col("mark")
    return (
        F.when(extension == ".csv", "csv")
        .when(extension == ".jsonl", "jsonl")
        .when((extension == ".json") & (mark == "["), "json_array")
        .when((extension == ".json") & (mark == "{"), "json_object")
    )


def _error() -> Column:
    extension, mark = F.col("extension"), F.col("mark")
    return (
        F.when(extension.isin(".csv", ".jsonl") | mark.isin("[", "{"), F.lit(None).cast("string"))
        .when(extension != ".json", F.concat(F.lit("Files of this kind are not read: "), extension))
        .when(mark.isNull(), "The file holds no JSON.")
        .otherwise(F.concat(F.lit("The JSON begins with '"), mark, F.lit("'.")))
    )
