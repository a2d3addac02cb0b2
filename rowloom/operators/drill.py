"""Drill-down: follow a key path through every record, flatten what it reaches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_cells as J
from ..functions.json_exact import leaf_key_order, point_bits
from ..functions.types import ColumnType
from ..plans.apply import apply_recipe
from ..plans.cells import Cell, DisplayCell, Stages, column
from ..plans.plan import VIEW
from ..recipes.actions import Action
from ..recipes.recipe import Recipe
from ..sources.jsonl import LINE, drop_blank, in_first_seen_order, with_record
from .profile import ColumnInfo, entry_of, line_mark, drill_schema, entry_summary, typed_entries

LINEAGE, _TASK = "#", "__task"


@dataclass(frozen=True)
class Segment:
    """A step of a key path. The kind is explicit: a key may be called "[0]"."""

    name: str
    kind: str = "key"


def key(name: str) -> Segment:
    return Segment(name)


def index(number: int = 0) -> Segment:
    return Segment(f"[{number}]", "index")


def key_path(*parts: str | int) -> tuple[Segment, ...]:
    """``key_path("orders", 0, "tags")``: strings are keys, numbers indexes."""
    return tuple(index(part) if isinstance(part, int) else key(part) for part in parts)


def render_path(path: Sequence[Segment], collapse: bool = True) -> str:
    """``a > b[*]``; ``root`` for the empty path."""
    out = ""
    for segment in path:
        if segment.kind == "index":
            out += "[*]" if collapse else segment.name
        else:
            out += f" > {segment.name}" if out else segment.name
    return out or "root"


def scalar_column(path: Sequence[Segment]) -> str:
    """Column of a plain value at the end of a path: the last key, or ``value``."""
    return next((s.name for s in reversed(path) if s.kind == "key"), "value")


# ------------------------------------------------------------------ leaf rows

def leaf_rows(records: DataFrame, path: Sequence[Segment], position: str, on_error: str = "skip", keep: Iterable[str] = ()) -> DataFrame:
    """One row per leaf: ``#`` (lineage), ``leaf`` (variant) and ``holder`` (the
    column of a plain value, NULL if the leaf is an object).

    Records hold ``line`` or ``record`` (its variant). A step that does not fit
    drops the record; an index step opens every element, whatever its number.
    All of it is narrow: no row leaves its task.
    """
    if on_error not in ("skip", "fail"):
        raise ValueError(f"Unknown on_error '{on_error}'.")
    keep = list(keep)
    kept = [column(name) for name in keep]
    rows = records if on_error == "skip" or LINE not in records.columns else drop_blank(records)
    if "record" not in rows.columns:
        rows = with_record(rows)
    node = F.col("record")
    if on_error == "fail" and LINE in rows.columns:
        node = F.coalesce(node, F.raise_error(F.concat(F.lit("Not JSON: "), F.left(LINE, F.lit(200)))).cast("variant"))
    # What a step does not fit becomes NULL, and NULL arrays open to no row. Without
    # filters in between nothing is parsed twice: the optimizer would push them, and a
    # copy of the parsing, below the steps. It takes the task number for changing, so
    # what it infers from an array that depends on it stays above.
    rows = rows.select(*kept, column(position).cast("string").alias(LINEAGE), node.alias("node"), F.spark_partition_id().alias(_TASK))
    for step, segment in enumerate(path):
        if segment.kind == "key":
            rows = rows.select(*keep, LINEAGE, J.member(F.col("node"), segment.name).alias("node"), _TASK)
        elif step < len(path) - 1:
            opened = rows.select(*keep, LINEAGE, _TASK, F.posexplode(F.when(F.col(_TASK) >= 0, J.elements(F.col("node")))).alias("i", "node"))
            rows = opened.select(*keep, F.concat_ws(":", LINEAGE, F.col("i").cast("string")).alias(LINEAGE), "node", _TASK)
    with_elements = rows.select(*keep, LINEAGE, "node", _TASK, J.elements(F.col("node")).alias("items"))
    is_array = F.col("items").isNotNull()
    # A last index step stands for the array itself, and accepts nothing else.
    single = F.lit(None) if path and path[-1].kind == "index" else F.when(F.col("node").isNotNull(), F.array("node"))
    opened = with_elements.select(
        *keep, LINEAGE, is_array.alias("in_array"),
        F.posexplode(F.when(F.col(_TASK) >= 0, F.coalesce("items", single))).alias("i", "leaf"),
    )
    lineage = F.when(F.col("in_array"), F.concat_ws(":", LINEAGE, F.col("i").cast("string"))).otherwise(column(LINEAGE))
    holder = F.when(J.variant_type(F.col("leaf")) != "OBJECT", F.when(F.col("in_array"), "value").otherwise(scalar_column(path)))
    return opened.select(*keep, lineage.alias(LINEAGE), "leaf", holder.alias("holder"))


# --------------------------------------------------------------------- schema

def leaf_summary(records: DataFrame, path: Sequence[Segment], order: Column | None = None, on_error: str = "skip") -> DataFrame:
    """Summary of the leaf rows (see ``profile``). Object members are typed;
    plain values only name their column, which stays text."""
    place = F.monotonically_increasing_id() if order is None else order.cast("bigint")
    columns = [c for c in (LINE, "record") if c in records.columns]
    points = point_bits(F.col(LINE), path, scalar_column(path)) if LINE in columns else F.lit(None).cast("map<string,int>")
    placed = records.select(*columns, place.alias("place")).withColumn("points", points)
    rows = leaf_rows(placed, path, "place", on_error, keep=["place", "points"])
    pairs = F.map_entries(F.try_variant_get("leaf", "$", "map<string,variant>"))
    own = F.array(entry_of(F.col("holder"), F.try_parse_json(F.lit('""')), F.lit(False)))
    members = F.coalesce(
        F.when(F.col("holder").isNotNull(), own),
        F.transform(pairs, lambda e: entry_of(e["key"], e["value"], F.lit(False))),
    )
    return entry_summary(typed_entries(rows.select("place", "points", F.explode(F.concat(F.array(line_mark()), members)).alias("e"))))


def infer_leaves(records: DataFrame, path: Sequence[Segment], order: Column | None = None, on_error: str = "skip") -> list[ColumnInfo]:
    """Schema of a drilled table: union of all leaf keys in first-seen order."""
    rows = drill_schema(leaf_summary(records, path, order, on_error)).collect()
    found = {row["name"]: row for row in rows}
    if not found:
        any_leaf = not leaf_rows(records.withColumn("__at", F.lit(0)), path, "__at", on_error).isEmpty()
        raise ValueError("What the path reaches has no members." if any_leaf else "The path reaches nothing.")
    first = {name: row["first"] for name, row in found.items()}
    if LINE in records.columns:
        order_of = lambda line, steps: leaf_key_order(line, steps, scalar_column(path))
        names = in_first_seen_order(records, order, first, path, order_of)
    else:
        names = sorted(first, key=lambda name: (first[name], name))
    return [ColumnInfo(n, ColumnType(found[n]["type"]), found[n]["nullable"], i) for i, n in enumerate(names)]


# ----------------------------------------------------------------------- table

def drill(
    records: DataFrame,
    path: Sequence[Segment],
    position: str = "position",
    schema: Sequence[ColumnInfo] | Sequence[str] | None = None,
    cells: str = "display",
    on_error: str = "skip",
) -> DataFrame:
    """Table of everything a key path reaches, with lineage ids in ``#``.

    ``position`` names the record number column. ``schema`` (columns to show)
    is inferred by one pass over the records if not given. ``cells``: "display"
    for the text a view shows (``<null>``, ``{Object: 2 properties}``), "text" for
    plain text with SQL NULL and JSON for nested values, "variant" for variants.
    """
    if schema is None:
        schema = infer_leaves(records, path, on_error=on_error)
    names = [info.name if isinstance(info, ColumnInfo) else info for info in schema]
    return leaf_table(leaf_rows(records, path, position, on_error), names, cells)


def leaf_table(rows: DataFrame, names: Sequence[str], cells: str = "display", keep: Iterable[str] = ()) -> DataFrame:
    values = rows.select(*keep, LINEAGE, *(_leaf_value(name).alias(f"__v{i}") for i, name in enumerate(names)))
    columns = [F.col(f"__v{i}") for i in range(len(names))]
    if cells == "variant":
        shown = columns
    elif cells == "text":
        shown = [_plain_text(value) for value in columns]
    elif cells == "display":
        typed = values.select("*", *(J.variant_type(v).alias(f"__k{i}") for i, v in enumerate(columns)))
        stages = Stages()
        kinds = [F.col(f"__k{i}") for i in range(len(names))]
        numbers = [stages.keep(F.when(k.isin("DECIMAL", "DOUBLE"), J.as_double(v))) for k, v in zip(kinds, columns, strict=True)]
        shown = [J.display(v, k, n) for v, k, n in zip(columns, kinds, numbers, strict=True)]
        values = stages.before(typed)
    else:
        raise ValueError(f"Unknown cells '{cells}'.")
    return values.select(*keep, LINEAGE, *(value.alias(name) for value, name in zip(shown, names, strict=True)))


def _leaf_value(name: str) -> Column:
    return F.when(F.col("holder").isNull(), J.member(F.col("leaf"), name)).when(F.col("holder") == name, F.col("leaf"))


def _plain_text(value: Column) -> Column:
    nested = J.variant_type(value).isin("OBJECT", "ARRAY")
    return F.when(nested, F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))


def apply_to_drilled(table: DataFrame, recipe: Recipe | Iterable[Action], schema: Sequence[ColumnInfo] | None = None, **options) -> DataFrame:
    """Apply actions, the view way, to a drilled table of display cells. ``#``
    passes through untouched and no action can name it."""
    names = [name for name in table.columns if name != LINEAGE]
    cells: dict[str, Cell] = {name: DisplayCell(column(name)) for name in names}
    types = {info.name: info.column_type for info in schema or ()}
    return apply_recipe(table, recipe, VIEW, types, cells, protect=[LINEAGE], **options)


# ------------------------------------------------------------- one chosen node

def drill_node(node: DataFrame, keep: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Elements of the array in column ``record`` of a frame of chosen nodes, one
    per file: (rows with ``#`` = ``[i]`` and ``leaf``, counts to check them by)."""
    keep = list(keep)
    items = node.select(*keep, J.elements(F.col("record")).alias("items"))
    rows = items.select(*keep, F.posexplode("items").alias("i", "leaf"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("elements"),
        F.count(F.when(J.variant_type(F.col("leaf")) != "OBJECT", 1)).alias("others"),
    )
    lineage = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]"))
    return rows.select(*keep, lineage.alias(LINEAGE), "leaf", F.lit(None).cast("string").alias("holder")), counts


def drill_single(node: DataFrame, cells: str = "display") -> DataFrame:
    """Table of one chosen node (column ``line``): a non-empty array of objects.
    Anything else is an error, found by one counting pass."""
    parsed = with_record(node)
    head = parsed.agg(
        F.count(F.when(F.col("record").isNull(), 1)).alias("broken"),
        F.count(F.when(J.variant_type(F.col("record")) != "ARRAY", 1)).alias("not_arrays"),
    ).first()
    if head["broken"]:
        raise ValueError("The node is not JSON.")
    if head["not_arrays"]:
        raise ValueError("The node is no array.")
    rows, counts = drill_node(parsed)
    found = counts.first()
    if found["others"]:
        raise ValueError("The array holds something else than objects.")
    if not found["elements"]:
        raise ValueError("The array has no elements.")
    schema = infer_leaves(node, ())
    return leaf_table(rows, [info.name for info in schema], cells)


# ------------------------------------------------------------------- structure

def json_children(records: DataFrame, path: Sequence[Segment], position: str = "position") -> DataFrame:
    """Children of the node a path reaches in every record: position, label, kind
    and display text. Members are listed by name, elements by number."""
    rows = records if "record" in records.columns else with_record(records)
    rows = rows.select(column(position).alias(position), F.col("record").alias("node"))
    for segment in path:
        if segment.kind == "key":
            step = J.member(F.col("node"), segment.name)
        else:
            step = F.try_variant_get("node", f"$[{segment.name.strip('[]')}]", "variant")
        rows = rows.select(position, step.alias("node"))
    parts = rows.sparkSession.tvf.variant_explode(F.col("node").outer())
    children = rows.where("node is not null").lateralJoin(parts)
    label = F.coalesce("key", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    typed = children.select(position, label.alias("label"), "value", J.variant_type(F.col("value")).alias("type"))
    text = F.try_variant_get("value", "$", "string")
    for mark, written in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        text = F.replace(text, F.lit(mark), F.lit(written))
    shown = (
        F.when(F.col("type") == "STRING", F.concat(F.lit('"'), text, F.lit('"')))
        .when(F.col("type") == "VOID", "<null>")
        .when(F.col("type").isin("OBJECT", "ARRAY"), J.preview(F.col("value")))
        .otherwise(F.try_variant_get("value", "$", "string"))
    )
    return typed.select(position, "label", J.kind(F.col("value")).alias("kind"), F.concat("label", F.lit(": "), shown).alias("display"))


def structure_profile(records: DataFrame, path: Sequence[Segment], position: str = "position") -> DataFrame:
    """How often each child label and kind occurs over all records."""
    return json_children(records, path, position).groupBy("label", "kind").agg(F.count(F.lit(1)).alias("records"))
