"""Schema inference as distributed aggregates.

A *summary* has one row per column: a bit mask of the types seen, how many rows
had a value, and the places of the first row and the first empty row. Summaries
of parts of the data merge into the summary of the whole, so the same code serves
whole files, first rows, and streams.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import json_cells as J
from ..functions.json_exact import exact_members, point_bits
from ..functions.parsing import is_blank, parse_timestamp, text_type_code
from ..functions.types import ColumnType, label_of, merge_types, merged_type_name, type_bit
from ..plans.cells import column
from ..sources.csv import check_first_row, header_names, read_csv
from ..sources.jsonl import LINE, drop_blank, in_first_seen_order

INITIAL_ROWS = 200

SUMMARY = "name string, mask int, filled bigint, rows bigint, first bigint, first_empty bigint"


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    column_type: ColumnType
    nullable: bool
    index: int

    @property
    def label(self) -> str:
        return f"{self.name} ({self.column_type.label})"


def types_of(schema: Iterable[ColumnInfo]) -> dict[str, ColumnType]:
    return {info.name: info.column_type for info in schema}


def merge_schemas(left: Sequence[ColumnInfo], right: Sequence[ColumnInfo]) -> list[ColumnInfo]:
    """Join two schemas: types merge, a column missing on one side is nullable."""
    mine, theirs = ({info.name: info for info in side} for side in (left, right))
    names = list(dict.fromkeys([*mine, *theirs]))
    out = []
    for index, name in enumerate(names):
        a, b = mine.get(name), theirs.get(name)
        both = a is not None and b is not None
        kind = merge_types(a.column_type, b.column_type) if both else (a or b).column_type
        out.append(ColumnInfo(name, kind, a.nullable or b.nullable if both else True, index))
    return out


# ------------------------------------------------------------------------- CSV

def csv_summary(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Summary of a table of text columns. Cells are turned into rows first, so
    the typing code is compiled once, however wide the table is."""
    names = df.columns
    if not names:
        raise ValueError("The CSV has no header row.")
    place = F.monotonically_increasing_id() if order is None else order.cast("bigint")
    placed = df.select(place.alias("place"), F.array(*(column(n).cast("string") for n in names)).alias("cells"))
    cells = placed.select("place", F.posexplode("cells").alias("index", "cell"))
    typed = cells.select("place", "index", (F.col("cell").isNull() | is_blank(F.col("cell"))).alias("empty"), "cell")
    bits = typed.select("place", "index", "empty", F.when(~F.col("empty"), type_bit(text_type_code(F.col("cell")))).otherwise(0).alias("bit"))
    seen = bits.groupBy("index").agg(
        F.bit_or("bit").alias("mask"),
        F.count(F.when(~F.col("empty"), 1)).alias("filled"),
        F.count(F.lit(1)).alias("rows"),
        F.min("place").alias("first"),
        F.min(F.when(F.col("empty"), F.col("place"))).alias("first_empty"),
    )
    name = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("index") + 1)
    return seen.select(name.alias("name"), "mask", "filled", "rows", "first", "first_empty")


def csv_schema(summary: DataFrame) -> DataFrame:
    """(name, type, label, nullable). An empty cell in the first row makes the
    column text; empty cells further down only make it nullable."""
    starts_empty = F.col("first_empty") == F.col("first")
    return _schema(summary, F.coalesce(starts_empty, F.lit(False)), F.col("filled") < F.col("rows"))


def infer_csv(df: DataFrame, rows: int | None = None, order: Column | None = None) -> list[ColumnInfo]:
    """Schema of a CSV table, of its first ``rows`` rows if given."""
    part = df if rows is None else df.limit(rows)
    found = {row["name"]: row for row in csv_schema(csv_summary(part, order)).collect()}
    out = []
    for index, name in enumerate(df.columns):
        row = found.get(name)
        kind = ColumnType(row["type"]) if row else ColumnType.TEXT
        out.append(ColumnInfo(name, kind, row["nullable"] if row else True, index))
    return out


def infer_csv_file(spark: SparkSession, path: str | list[str], rows: int | None = None, quoted_breaks: bool | None = None) -> list[ColumnInfo]:
    """Schema of CSV files: ragged rows are skipped, a ragged first row is an error."""
    names = header_names(spark, path)
    check_first_row(spark, path, names)
    return infer_csv(read_csv(spark, path, names, quoted_breaks, on_ragged="skip"), rows)


# ------------------------------------------------------------------------ JSON

def json_entries(lines: DataFrame, order: Column | None = None) -> DataFrame:
    """(place, name, bits, empty, again) per member of every JSON object line, and
    one row with a NULL name per such line to count them by."""
    place = F.monotonically_increasing_id() if order is None else order.cast("bigint")
    line, record = F.col(LINE), F.col("record")
    parsed = drop_blank(lines.select(place.alias("place"), LINE)).withColumn("record", F.try_parse_json(LINE))
    # The parser refuses repeated keys; such lines are read member by member.
    refused = F.when(record.isNull() & J.is_object_line(line), line)
    read = parsed.withColumn("members", exact_members(refused)).withColumn("points", point_bits(line))
    pairs = F.map_entries(F.try_variant_get(F.when(J.is_object_line(line), record), "$", "map<string,variant>"))
    entries = F.coalesce(
        F.transform(pairs, lambda e: entry_of(e["key"], e["value"], F.lit(False))),
        F.transform(F.col("members"), lambda m: entry_of(m["key"], F.try_parse_json(m["raw"]), m["again"])),
    )
    return typed_entries(read.select("place", "points", F.explode(F.concat(F.array(line_mark()), entries)).alias("e")))


def entry_of(name: Column, value: Column, again: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"), again.alias("again"))


def line_mark() -> Column:
    return entry_of(F.lit(None).cast("string"), F.try_parse_json(F.lit("null")), F.lit(False))


def typed_entries(exploded: DataFrame) -> DataFrame:
    """Type the values. Numbers with a decimal point are floats, others beyond 64
    bits are text; a variant only leaves that open for doubles and for decimals
    of 19 and more digits, which ``points`` (see ``point_bits``) settles."""
    members = exploded.select("place", "points", "e.*")
    schemas = members.withColumn("schema", F.schema_of_variant("value"))
    named = schemas.select(
        "place", "name", "again", F.regexp_extract("schema", "^[A-Z]+", 0).alias("kind"),
        F.when(F.col("schema") == "STRING", F.try_variant_get("value", "$", "string")).alias("text"),
        F.when(F.col("schema").rlike(r"^(?:DOUBLE|DECIMAL\((?:19|[23]\d),0\))$"), F.try_element_at("points", "name")).alias("points"),
        F.col("schema").rlike(r"^DECIMAL\((?:19|[23]\d),0\)$").alias("huge"),
    )
    code = J.json_type_code(F.col("kind"), parse_timestamp(F.col("text")).isNotNull())
    float_bit, text_bit = (F.lit(1 << kind.code) for kind in (ColumnType.FLOAT, ColumnType.TEXT))
    pointed = F.when(F.col("points") == 1, float_bit).when(F.col("points") == 2, text_bit).when(F.col("points") == 3, float_bit.bitwiseOR(text_bit))
    bits = F.coalesce(pointed, F.when(F.col("huge"), text_bit), type_bit(code))
    return named.select("place", "name", "again", bits.alias("bits"), (F.col("kind") == "VOID").alias("empty"))


def entry_summary(entries: DataFrame) -> DataFrame:
    """Summary rows of members; the row without a name counts the lines."""
    grouped = entries.groupBy("name").agg(
        F.bit_or("bits").alias("mask"),
        F.count(F.when(~F.col("empty") & ~F.col("again"), 1)).alias("filled"),
        F.count(F.lit(1)).alias("rows"),
        F.min("place").alias("first"),
        F.min(F.when(F.col("empty"), F.col("place"))).alias("first_empty"),
    )
    return grouped.withColumn("mask", F.col("mask").cast("int"))


def json_summary(lines: DataFrame, order: Column | None = None) -> DataFrame:
    return entry_summary(json_entries(lines, order))


def _with_total(summary: DataFrame) -> DataFrame:
    """Put the line count next to every column. A summary has one row per column
    of the table, so one window over it stays small."""
    everything = Window.partitionBy(F.lit(0))
    total = F.max(F.when(F.col("name").isNull(), F.col("rows"))).over(everything)
    return summary.withColumn("total", total).where("name is not null")


def json_schema(summary: DataFrame) -> DataFrame:
    """(name, type, label, nullable). A null before any value makes the key text
    for good; a null or absence further on only makes it nullable."""
    counted = _with_total(summary)
    starts_empty = F.coalesce(F.col("first_empty") == F.col("first"), F.lit(False))
    return _schema(counted, starts_empty, F.col("filled") < F.col("total"))


def drill_schema(summary: DataFrame) -> DataFrame:
    """As ``json_schema``, but nulls never touch the type."""
    return _schema(_with_total(summary), F.lit(False), F.col("filled") < F.col("total"))


def infer_json(lines: DataFrame, rows: int | None = None, order: Column | None = None) -> list[ColumnInfo]:
    """Schema of JSON lines in first-seen key order."""
    part = lines if rows is None else lines.limit(rows)
    found = {row["name"]: row for row in json_schema(json_summary(part, order)).collect()}
    if not found:
        raise ValueError("None of the lines is a JSON object.")
    names = in_first_seen_order(part, order, {name: row["first"] for name, row in found.items()}, ())
    return [ColumnInfo(n, ColumnType(found[n]["type"]), found[n]["nullable"], i) for i, n in enumerate(names)]


# ---------------------------------------------------------------------- shared

def _schema(summary: DataFrame, starts_empty: Column, nullable: Column) -> DataFrame:
    type_name = F.when(starts_empty, ColumnType.TEXT.value).otherwise(merged_type_name(F.col("mask")))
    typed = summary.select("name", type_name.alias("type"), nullable.alias("nullable"), "first")
    return typed.select("name", "type", label_of(F.col("type")).alias("label"), "nullable", "first")


def merge_summaries(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Summary of two stretches of data whose places are comparable (given by a
    common ``order``). ``rowloom.streaming.schema`` merges those of batches."""
    both = earlier.unionByName(later)
    return both.groupBy("name").agg(
        F.bit_or("mask").alias("mask"),
        F.sum("filled").alias("filled"),
        F.sum("rows").alias("rows"),
        F.min("first").alias("first"),
        F.min("first_empty").alias("first_empty"),
    )


def describe(schema: Sequence[ColumnInfo], spark) -> DataFrame:
    """A schema as rows: index, name, type, label, nullable."""
    rows = [(c.index, c.name, c.column_type.value, c.label, c.nullable) for c in schema]
    return spark.createDataFrame(rows, "index int, name string, type string, label string, nullable boolean")
