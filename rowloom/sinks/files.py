"""CSV and JSON writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cell_text
from ..plans.apply import table_cells
from ..plans.cells import Cell, Stages, batch_json, column, json_string
from ..plans.plan import Plan, build_plan

# NULL is written as nothing, the empty string as "". Quotes stand around cells
# with a quote, comma or line break, and inner quotes are doubled.
CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def text_columns(df: DataFrame) -> DataFrame:
    """Every column as text; nested ones as JSON."""
    nested = (T.StructType, T.MapType, T.ArrayType, T.VariantType)
    shown = [
        F.to_json(column(f.name)) if isinstance(f.dataType, nested) else cell_text(column(f.name), f.dataType)
        for f in df.schema.fields
    ]
    return df.select(*(text.alias(name) for text, name in zip(shown, df.columns, strict=True)))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", encoding: str = "UTF-8") -> None:
    """Write a table as CSV files, each with a header. A table without columns
    becomes blank lines: one for the header, one per row."""
    if df.columns:
        text_columns(df).write.mode(mode).options(**CSV_OPTIONS, encoding=encoding).csv(path)
    else:
        header = df.sparkSession.range(1).select(F.lit("").alias("value"))
        header.unionByName(df.select(F.lit("").alias("value"))).write.mode(mode).text(path)


def json_line(names: list[str], values: list[Column]) -> Column:
    """One JSON object from member values given as JSON text; NULL leaves a member out."""
    parts = [F.concat(json_string(F.lit(name)), F.lit(":"), value) for name, value in zip(names, values, strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))


def json_lines(df: DataFrame, plan: Plan | None = None, cells: dict[str, Cell] | None = None) -> DataFrame:
    """Rows as JSON text (column ``value``), by default all columns as they are."""
    plan = plan or build_plan(df.columns, ())
    cells = cells or table_cells(df, df.columns)
    stages = Stages()
    values = [batch_json(cells[c.source], c, stages) for c in plan.columns]
    return stages.before(df).select(json_line([c.name for c in plan.columns], values).alias("value"))


def write_jsonl(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write JSON text rows (see ``json_lines``), one object per line."""
    lines.select("value").write.mode(mode).text(path)


def _framed(opening: str, closing: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = opening
        for batch in batches:
            if batch.num_rows:
                before = pa.concat_arrays([pa.array([lead]), pa.repeat(",", batch.num_rows - 1)])
                texts = pc.binary_join_element_wise(before, batch.column(0), "")
                yield pa.RecordBatch.from_arrays([texts], ["value"])
                lead = ","
        yield pa.RecordBatch.from_pydict({"value": [closing if lead == "," else opening + closing]})

    return run


def write_json_array(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write JSON text rows so that every output file is one JSON array. Each
    task streams its rows; nothing is gathered."""
    lines.select("value").mapInArrow(_framed("[", "]"), "value string").write.mode(mode).text(path)


def write_json_object(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (key, value as JSON text) rows so that every file is one JSON object."""
    members = entries.select(F.concat(json_string(F.col("key")), F.lit(":"), F.col("value")).alias("value"))
    members.mapInArrow(_framed("{", "}"), "value string").write.mode(mode).text(path)
