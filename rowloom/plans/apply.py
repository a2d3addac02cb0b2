"""Applying an action list to a DataFrame: one ``where``, one ``select``."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import ColumnType, logical_type
from ..recipes.actions import Action
from ..recipes.recipe import Recipe
from .cells import Cell, Stages, TypedCell, batch_value, column, typed_view_value, view_condition, view_value
from .plan import BATCH, VIEW, Plan, build_plan  # noqa: F401


def actions_of(recipe: Recipe | Iterable[Action]) -> tuple[Action, ...]:
    return tuple(recipe.actions if isinstance(recipe, Recipe) else recipe)


def table_cells(df: DataFrame, names: Iterable[str]) -> dict[str, Cell]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return {name: TypedCell(column(name), types[name]) for name in names}


def row_condition(plan: Plan, cells: dict[str, Cell]) -> Column | None:
    """All row tests joined by AND; they always read the source cells."""
    if plan.mode == BATCH:
        tests = [cells[t.source].test(t) for t in plan.tests]
    else:
        tests = [view_condition(cells[t.source], t) for t in plan.tests]
    return reduce(lambda a, b: a & b, tests) if tests else None


def keep_rows(df: DataFrame, plan: Plan, cells: dict[str, Cell], computed: bool = False) -> DataFrame:
    """Rows that pass all tests. ``computed``: cells are long expressions of this
    frame. A test reads its cell many times, and pushing it below the projection
    that makes the cell would copy the expression as often. A constant that the
    optimizer takes for changing per task keeps the test above it."""
    condition = row_condition(plan, cells)
    if condition is None:
        return df
    if not computed:
        return df.where(condition)
    fenced = df.select("*", F.spark_partition_id().alias("__task"))
    return fenced.where((F.col("__task") >= 0) & condition).drop("__task")


def project(
    df: DataFrame,
    plan: Plan,
    cells: dict[str, Cell],
    labels: bool = False,
    typed: bool = False,
    keep: Iterable[str] = (),
) -> DataFrame:
    value = batch_value if plan.mode == BATCH else typed_view_value if typed else view_value
    stages = Stages()
    kept = [column(name) for name in keep]
    shown = [value(cells[c.source], c, stages).alias(shown_name(c, labels)) for c in plan.columns]
    return stages.before(df).select(*kept, *shown)


def shown_name(out, labels: bool) -> str:
    return f"{out.name} ({out.column_type.label})" if labels else out.name


def apply_recipe(
    df: DataFrame,
    recipe: Recipe | Iterable[Action],
    mode: str = BATCH,
    types: dict[str, ColumnType] | None = None,
    cells: dict[str, Cell] | None = None,
    labels: bool = False,
    typed: bool = False,
    protect: Iterable[str] = (),
) -> DataFrame:
    """Apply a recipe to a table.

    ``types`` are the logical column types a view starts from (inferred, see
    ``rowloom.operators.profile``); by default those of the Spark columns.
    ``cells`` overrides how source cells are read. ``protect`` names columns that
    no action can reach; they are passed on in front.
    """
    protect = list(protect)
    names = [name for name in df.columns if name not in protect]
    computed = cells is not None
    cells = cells or table_cells(df, names)
    if types is None:
        types = {f.name: logical_type(f.dataType) for f in df.schema.fields}
    plan = build_plan(names, actions_of(recipe), mode, types)
    return project(keep_rows(df, plan, cells, computed), plan, cells, labels, typed, protect)


def matched_rows(df: DataFrame, recipe: Recipe | Iterable[Action], position: str, mode: str = BATCH) -> DataFrame:
    """Positions of the rows that pass a recipe's filters."""
    names = [name for name in df.columns if name != position]
    types = {f.name: logical_type(f.dataType) for f in df.schema.fields}
    plan = build_plan(names, actions_of(recipe), mode, types)
    return keep_rows(df, plan, table_cells(df, names)).select(column(position))


__all__ = ["BATCH", "VIEW", "apply_recipe", "matched_rows"]
