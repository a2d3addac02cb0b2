"""Files of several formats, read together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cells import column
from .csv import read_csv
from .detect import detect_formats
from .json_documents import read_json_array, read_json_object
from .jsonl import JsonLinesCell, read_jsonl, with_cells


def read_mixed(spark: SparkSession, path: str | list[str], names: Sequence[str], quoted_breaks: bool | None = None) -> DataFrame:
    """The named columns of all files as text, with the ``format`` of their file.

    What the driver holds are the file names, as for any file scan. A file of no
    known format is an error.
    """
    groups: dict[str, list[str]] = {}
    for row in detect_formats(spark, path).collect():
        if row["error"]:
            raise ValueError(f"{row['path']}: {row['error']}")
        groups.setdefault(row["format"], []).append(row["path"])
    readers = {"jsonl": read_jsonl, "json_array": read_json_array, "json_object": read_json_object}
    frames = []
    for data_format, files in sorted(groups.items()):
        if data_format == "csv":
            rows = read_csv(spark, files, quoted_breaks=quoted_breaks).select(*(column(n) for n in names))
        else:
            cells = with_cells(readers[data_format](spark, files), names, raw=False)
            rows = cells.select(*(JsonLinesCell(F.col(f"cell_{i}")).table_value.alias(n) for i, n in enumerate(names)))
        frames.append(rows.select(F.lit(data_format).alias("format"), *(column(n) for n in names)))
    return reduce(lambda a, b: a.unionByName(b), frames)
