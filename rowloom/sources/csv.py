"""CSV: header names, scan, rows with quoted line breaks, ragged rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cells import column
from .splitting import CSV_ROWS, split_records

_OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "inferSchema": "false"}
_WHOLE_ROW = "__whole_row"


def resolve_names(header: Sequence[str | None]) -> list[str]:
    """Column names of a header row: a blank cell gets ``Column<n>``, a name used
    twice is an error."""
    names = [name if name and name.strip() else f"Column{i}" for i, name in enumerate(header, start=1)]
    seen: set[str] = set()
    for name in names:
        if name in seen:
            raise ValueError(f"Two columns are called '{name}'.")
        seen.add(name)
    return names


def header_names(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> list[str]:
    """Names in the header row, which must be the same in all files of a path."""
    return resolve_names(_header(spark, path, encoding))


def _header(spark: SparkSession, path: str | list[str], encoding: str) -> list[str | None]:
    first = spark.read.options(**_OPTIONS, encoding=encoding, header="false").csv(path).first()
    if first is None:
        raise ValueError("The CSV has no header row.")
    return list(first)


def has_quoted_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Does any line leave a quote open? One pass, stopping at the first such line."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(F.contains(line, F.lit('"')) & (quotes % 2 == 1)).isEmpty()


def _check_lines(spark: SparkSession, path: str | list[str]) -> None:
    """No line may end inside a quoted cell. One pass, stopping at the first that does."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    # Without its closed cells, such a line still has a quote where a cell begins.
    rest = F.regexp_replace(line, '(^|,)"(?:[^"]|"")*+"(?!")', "$1")
    found = spark.read.text(path).where((quotes % 2 == 1) & F.rlike(rest, F.lit('(^|,)"'))).first()
    if found is not None:
        raise ValueError(f"A line ends inside a quoted cell: {found[0][:200]}")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    names: Sequence[str] | None = None,
    quoted_breaks: bool | None = None,
    encoding: str = "UTF-8",
    on_ragged: str = "pad",
    on_damage: str = "fail",
) -> DataFrame:
    """All columns as text; an empty cell is the empty string.

    ``quoted_breaks``: whether cells may hold line breaks; None looks (one more
    pass). Such files are still read in parallel, see ``splitting``.
    ``on_ragged``: rows of another width than the header are padded or cut
    ("pad"), left out ("skip"), or fail the run ("fail").
    ``on_damage``: a quoted cell that the file ends in fails the run ("fail"), or
    reaches to the end of the file ("row"). With ``quoted_breaks=False`` the same holds
    for every line, which "fail" takes a pass to look for (but in UTF-16 and UTF-32). A
    quote opens a cell only at its beginning; elsewhere outside quotes it is text.
    """
    if on_damage not in ("fail", "row"):
        raise ValueError(f"Unknown on_damage '{on_damage}'.")
    if on_ragged not in ("pad", "skip", "fail"):
        raise ValueError(f"Unknown on_ragged '{on_ragged}'.")
    header = None if names is not None else _header(spark, path, encoding)
    names = list(names) if names is not None else resolve_names(header)
    if quoted_breaks is None:
        quoted_breaks = has_quoted_breaks(spark, path)
    elif not quoted_breaks and on_damage == "fail" and not encoding.upper().startswith(("UTF-16", "UTF16", "UTF-32", "UTF32")):
        _check_lines(spark, path)
    if quoted_breaks:
        if encoding.upper().replace("-", "") != "UTF8":
            raise ValueError("Quoted line breaks are only read from UTF-8 files.")
        return _read_broken_rows(spark, path, names, on_ragged, on_damage, header)
    # Inner names are made up, so that header names may be anything; but where they can
    # be taken as they are, Spark holds the header of every file against them.
    checked = header is not None and header == names and _WHOLE_ROW not in names
    inner = names if checked else [f"c{i}" for i in range(len(names))]
    fields = [T.StructField(name, T.StringType()) for name in inner]
    options = {**_OPTIONS, "header": "true", "enforceSchema": str(not checked).lower(), "encoding": encoding}
    if on_ragged != "pad":
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _WHOLE_ROW}
        fields.append(T.StructField(_WHOLE_ROW, T.StringType()))
    rows = spark.read.options(**options).schema(T.StructType(fields)).csv(path)
    return _named(_ragged(rows, on_ragged), names, inner)


def check_first_row(spark: SparkSession, path: str | list[str], names: Sequence[str], encoding: str = "UTF-8") -> None:
    """Schema inference starts from the first data row, which must be as wide as
    the header; ragged rows further down are left out of it."""
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    schema = T.StructType([*fields, T.StructField(_WHOLE_ROW, T.StringType())])
    options = {**_OPTIONS, "header": "true", "encoding": encoding, "multiLine": "false", "columnNameOfCorruptRecord": _WHOLE_ROW}
    first = spark.read.options(**options).schema(schema).csv(path).first()
    whole = first and first[_WHOLE_ROW]
    # A row cut short inside quotes is not ragged, it goes on in the next line.
    if whole is not None and whole.count('"') % 2 == 0:
        raise ValueError(f"First row has another width than the header of {len(names)} columns: {whole}")


def _ragged(rows: DataFrame, on_ragged: str) -> DataFrame:
    if on_ragged == "pad":
        return rows
    whole = F.col(_WHOLE_ROW)
    if on_ragged == "skip":
        return rows.where(whole.isNull())
    failure = F.raise_error(F.concat(F.lit("Row width differs from header: "), whole)).cast("boolean")
    return rows.where(F.when(whole.isNull(), True).otherwise(failure))


def _named(rows: DataFrame, names: Sequence[str], inner: Sequence[str]) -> DataFrame:
    return rows.select(*(F.coalesce(column(held), F.lit("")).alias(name) for held, name in zip(inner, names, strict=True)))


def _read_broken_rows(spark: SparkSession, path: str | list[str], names: Sequence[str], on_ragged: str, on_damage: str, header: list[str | None] | None) -> DataFrame:
    records = split_records(spark, path, CSV_ROWS, "\n", with_file=False, on_damage=on_damage)
    text = F.regexp_replace("text", r"\r?\n?$" if on_damage == "row" else r"\r$", "")
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), f"{_WHOLE_ROW} string"])
    options = {**{k: v for k, v in _OPTIONS.items() if k != "inferSchema"}, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _WHOLE_ROW}
    rows = records.where(text != "").select("number", F.from_csv(text, schema, options).alias("row"))
    inner = [f"c{i}" for i in range(len(names))]
    kept = F.col("number") > 0
    if header is not None:
        same = reduce(and_, (F.col(f"row.c{i}").eqNullSafe(F.lit(name)) for i, name in enumerate(header)))
        kept = F.when(kept, True).when(same, False).otherwise(F.raise_error("Files have different header rows.").cast("boolean"))
    return _named(_ragged(rows.where(kept).select("row.*"), on_ragged), names, inner)
