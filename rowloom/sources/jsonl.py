"""JSON Lines: scan, key union, and cells for recipes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_cells as J
from ..functions.json_exact import exact_cells, exact_members, first_members, leaf_key_order
from ..functions.parsing import parse_whole
from ..functions.text import ERROR_TEXT, NULL_TEXT, array_preview, double_text, object_preview
from ..plans.cells import Cell, Stages, json_string

LINE = "line"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line as it stands (``line``), blank ones included. Byte order mark
    and carriage returns are dropped by Spark's text reader."""
    return spark.read.text(path).withColumnRenamed("value", LINE)


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per non-blank line: the line and its variant (NULL if malformed)."""
    return records(read_lines(spark, path))


def read_jsonl_columns(spark: SparkSession, path: str | list[str], names: Iterable[str]) -> DataFrame:
    """The named members as text, by Spark's own JSON reader and without Python:
    strings decoded, numbers and nested values exactly as written, NULL for null
    and missing members and for broken lines.

    The fastest way when it does not matter which of these a NULL is. Of repeated
    members the last one counts, and a line holding an array gives a row for each
    of its objects.
    """
    names = list(names)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "__unused").json(path)


def records(lines: DataFrame) -> DataFrame:
    return with_record(drop_blank(lines))


def with_record(lines: DataFrame) -> DataFrame:
    """Add ``record``, the variant of the line. The parser refuses objects that name a
    member twice; such lines, and no others, are written anew with the first member of
    each name before they are parsed."""
    parsed = lines.withColumn("record", F.try_parse_json(LINE))
    refused = F.col("record").isNull() & F.col(LINE).rlike(r"^\s*[\[{]")
    anew = first_members(F.when(refused, F.col(LINE)))
    return parsed.withColumn("record", F.coalesce("record", F.try_parse_json(anew)))


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col(LINE).rlike(r"^\s*$"))


# ------------------------------------------------------------------- key union

def _numbered(lines: DataFrame, order: Column | None) -> DataFrame:
    order = F.monotonically_increasing_id() if order is None else order
    return lines.select("*", order.cast("bigint").alias("place"))


#: Java arrays have fewer elements, and so has a line fewer keys.
_LINE_KEYS = 1 << 31


def key_union(lines: DataFrame, order: Column | None = None) -> DataFrame:
    """Distinct top-level keys: (key, first, rank), ``first`` being the place of the
    first line with the key (``order``, or the scan order) and ``rank`` a number that
    goes by that place and, within a line, by the order in which keys are written.

    Lines that are not one whole JSON object add nothing. Keys are reduced on
    the map side, so only the distinct keys of each task are shuffled.
    """
    line = F.col(LINE)
    # Inside brackets the parser also refuses text that follows the object. It
    # refuses repeated keys too, so what it refuses is read exactly.
    in_brackets = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    checked = drop_blank(_numbered(lines, order)).select(
        line, "place", (F.size(J.elements(in_brackets)) == 1).alias("plain")
    )
    plain = F.coalesce(F.col("plain"), F.lit(False))
    exact = exact_members(F.when(~plain & J.is_object_line(line), line), whole_only=True)
    keys = checked.select(
        "place", F.when(plain, F.json_object_keys(line)).otherwise(F.transform(exact, lambda m: m["key"])).alias("keys")
    )
    # One number, which a hash aggregate can update in place: the line, then the key in it.
    rank = F.col("place").cast("decimal(20,0)") * F.lit(_LINE_KEYS).cast("decimal(11,0)") + F.col("at")
    met = keys.select("place", F.posexplode("keys").alias("at", "key")).select("place", "key", rank.cast("decimal(38,0)").alias("rank"))
    return met.groupBy("key").agg(F.min("place").alias("first"), F.min("rank").alias("rank"))


def key_names(lines: DataFrame, order: Column | None = None) -> list[str]:
    """The key union in first-appearance order. What reaches the driver are the
    distinct keys, that is, the columns of the table to be made."""
    return [row["key"] for row in key_union(lines, order).orderBy("rank").collect()]


def in_first_seen_order(
    lines: DataFrame,
    order: Column | None,
    first_places: dict[str, int],
    path: Iterable = (),
    key_order: Callable = leaf_key_order,
) -> list[str]:
    """Sort keys by the place of their first line and, within a line, as written
    there. Only the lines that introduce several keys are read for that."""
    if len(set(first_places.values())) == len(first_places):
        return sorted(first_places, key=first_places.get)
    shared = sorted(place for place, keys in Counter(first_places.values()).items() if keys > 1)
    # Fewer rows of one number than the table to be made has columns.
    listed = F.broadcast(lines.sparkSession.createDataFrame([(place,) for place in shared], "place bigint"))
    wanted = _numbered(lines, order).join(listed, "place", "left_semi")
    rows = wanted.select("place", key_order(F.col(LINE), path).alias("keys")).collect()
    within = {(row["place"], key): i for row in rows for i, key in enumerate(row["keys"] or ())}
    return sorted(first_places, key=lambda key: (first_places[key], within.get((first_places[key], key), len(within))))


# ------------------------------------------------------------ cells for recipes

@dataclass
class JsonLinesCell(Cell):
    """A member of a JSON line, held as a CELL struct column."""

    cell: Column

    @property
    def has_value(self) -> Column:
        return ~self.cell["kind"].isin("null", "missing", "invalid")

    @property
    def text(self) -> Column:
        return self.cell["text"]

    @property
    def table_value(self) -> Column:
        return self.cell["text"]

    def json(self, stages: Stages) -> Column:
        kind = self.cell["kind"]
        return (
            F.when(kind == "missing", F.lit(None).cast("string"))
            .when(kind == "null", "null")
            .when(kind == "invalid", '""')
            .when(kind == "string", json_string(self.text))
            .otherwise(self.text)
        )


@dataclass
class JsonLinesTestCell(Cell):
    """What a filter reads of a member: text with numbers normalised and strings
    not unescaped. NULL (row dropped) for null, missing and unreadable members."""

    shown: Column

    @property
    def text(self) -> Column:
        return F.when(~self.shown.isin(NULL_TEXT, ERROR_TEXT), self.shown)

    def view_text(self) -> Column:
        return self.shown


def with_cells(lines: DataFrame, keys: Iterable[str], exact: bool = True, prefix: str = "cell", raw: bool = True) -> DataFrame:
    """Add one CELL struct column per key: ``<prefix>_0``, ``<prefix>_1``, ...

    Strings, numbers, booleans, nulls and absent members come from the variant, where
    it keeps their spelling. With ``exact`` (the default) lines with other members under
    these keys, and lines the variant parser refuses, are read once more by the exact
    reader. Without ``raw`` cells have no field of that name, and strings in lines with
    escapes come from the variant as well.
    """
    keys = list(keys)
    parsed, base = _with_record(lines)
    if not keys:
        return parsed
    line = F.col(LINE)
    # What the parser refuses goes to the exact reader as it stands: ``record``, for which
    # such lines are written anew in Python, is not needed here.
    first = parsed.withColumn("__record", F.try_parse_json(LINE)) if exact else parsed
    record = "__record" if exact else "record"
    found = F.transform(_typed(keys, record), lambda c: _plain_cell(c["value"], c["type"], line, exact, raw))
    first = first.select("*", F.when(_readable(record), found).alias("__plain"))
    if not exact:
        broken = _cell_struct("invalid", None, keep_raw=raw)
        return first.select(*base, *(F.coalesce(F.col("__plain")[i], broken).alias(f"{prefix}_{i}") for i in range(len(keys))))
    some_open = F.col("__plain").isNull() | F.exists("__plain", lambda c: c.isNull())
    read = first.select("*", exact_cells(F.when(some_open, line), keys).alias("__exact"))
    # A null has no text, whichever way it was read.
    fields = ("text", "raw") if raw else ("text",)
    same = F.transform("__exact", lambda c: F.struct(c["kind"].alias("kind"), *(F.when(c["kind"] != "null", c[f]).alias(f) for f in fields)))
    read = read.withColumn("__exact", same)
    return read.select(
        *base, *(F.coalesce(F.col("__plain")[i], F.col("__exact")[i]).alias(f"{prefix}_{i}") for i in range(len(keys)))
    )


def _with_record(lines: DataFrame) -> tuple[DataFrame, list[str]]:
    parsed = lines if "record" in lines.columns else lines.withColumn("record", F.try_parse_json(LINE))
    return parsed, parsed.columns


def _readable(record: str = "record") -> Column:
    return F.col(record).isNotNull() & J.is_object_line(F.col(LINE))


def _typed(keys: list[str], record: str = "record") -> Column:
    """The members as an array of (value, type). Cells are made of it by one expression
    over the array, so that neither code nor work grows faster than the number of keys."""
    values = F.array(*(J.member(F.col(record), key) for key in keys))
    return F.transform(values, lambda v: F.struct(v.alias("value"), J.variant_type(v).alias("type")))


def _cell_struct(kind: str | Column, text: Column | None, keep_raw: bool = True) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.lit(None).cast("string") if text is None else text
    return F.struct(kind.alias("kind"), text.alias("text"), *([text.alias("raw")] if keep_raw else ()))


# Lines in which some member may be a fraction that ends in zeros. Variants drop these zeros,
# and keep every other decimal as it is written.
_ENDS_IN_ZEROS = r'"\s*:\s*-?[0-9]+\.[0-9]*0(?![0-9])'


def _plain_cell(value: Column, type_name: Column, line: Column, exact: bool, raw: bool = True) -> Column:
    """CELL where the variant keeps the source text, NULL where it may not."""
    text = F.try_variant_get(value, "$", "string")

    def cell(kind: str, text: Column | None) -> Column:
        return _cell_struct(kind, text, raw)

    out = (
        F.when(value.isNull(), cell("missing", None))
        .when(type_name == "VOID", cell("null", None))
        .when(type_name == "BOOLEAN", cell("boolean", text))
    )
    if exact:
        # Without a backslash in the line, a string is its own raw form.
        as_written = ~F.contains(line, F.lit("\\")) if raw else F.lit(True)
        signed_zero = (text == "0") & F.contains(line, F.lit("-0"))
        as_decimal = ~F.contains(text, F.lit("E")) & ~F.rlike(line, F.lit(_ENDS_IN_ZEROS))
        return (
            out.when((type_name == "STRING") & as_written, cell("string", text))
            .when((type_name == "BIGINT") & ~signed_zero, cell("number", text))
            .when((type_name == "DECIMAL") & as_decimal, cell("number", text))
        )
    return (
        out.when(type_name == "STRING", cell("string", text))
        .when(type_name == "OBJECT", cell("object", F.to_json(value)))
        .when(type_name == "ARRAY", cell("array", F.to_json(value)))
        .otherwise(cell("number", text))
    )


def with_shown(lines: DataFrame, keys: Iterable[str], exact: bool = True, prefix: str = "shown") -> DataFrame:
    """Add the view text of each key as ``<prefix>_0``, ``<prefix>_1``, ...

    Nearly all of it comes from the variant. Only lines it refuses, and strings in
    lines with escapes (which a view shows unescaped), need the exact reader.
    """
    keys = list(keys)
    parsed, base = _with_record(lines)
    if not keys:
        return parsed
    line, count = F.col(LINE), range(len(keys))
    escaped = F.contains(line, F.lit("\\"))

    def text(c: Column) -> Column:
        shown = J.display(c["value"], c["type"], c["number"])
        return F.when(~(escaped & (F.coalesce(c["type"], F.lit("")) == "STRING")), shown) if exact else shown

    numbers = F.transform(_typed(keys), lambda c: F.struct(c["value"].alias("value"), c["type"].alias("type"), F.when(c["type"].isin("DECIMAL", "DOUBLE"), J.as_double(c["value"])).alias("number")))
    first = parsed.select("*", F.when(_readable(), F.transform(numbers, text)).alias("__plain"))
    if not exact:
        return first.select(*base, *(F.coalesce(F.col("__plain")[i], F.lit(ERROR_TEXT)).alias(f"{prefix}_{i}") for i in count))
    some_open = F.col("__plain").isNull() | F.exists("__plain", lambda c: c.isNull())
    read = first.select("*", exact_cells(F.when(some_open, line), keys).alias("__exact"))
    late = read.select(*base, "__plain", _shown_cells(F.col("__exact")).alias("__late"))
    return late.select(*base, *(F.coalesce(F.col("__plain")[i], F.col("__late")[i]).alias(f"{prefix}_{i}") for i in count))


def _shown_cells(cells: Column) -> Column:
    """View texts of CELLs: sentinels, normalised numbers, previews of nested values."""
    read = F.transform(
        cells,
        lambda c: F.struct(
            c["kind"].alias("kind"), c["raw"].alias("raw"), F.when(c["kind"].isin("object", "array"), F.try_parse_json(c["raw"])).alias("nested"),
            F.when(c["kind"] == "number", c["raw"].try_cast("double")).alias("number"),
        ),
    )

    def text(c: Column) -> Column:
        kind = c["kind"]
        return (
            F.when(kind == "string", c["raw"])
            .when(kind == "number", F.coalesce(parse_whole(c["raw"]).cast("string"), double_text(c["number"]), F.lit(ERROR_TEXT)))
            .when(kind == "boolean", F.initcap(c["raw"]))
            .when(kind == "object", F.coalesce(object_preview(J.property_count(c["nested"])), F.lit(ERROR_TEXT)))
            .when(kind == "array", F.coalesce(array_preview(J.element_count(c["nested"])), F.lit(ERROR_TEXT)))
            .when(kind == "invalid", ERROR_TEXT)
            .otherwise(NULL_TEXT)
        )

    return F.transform(read, text)
