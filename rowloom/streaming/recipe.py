"""Recipes and drill-down on streams: the batch expressions, stateless."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from ..operators.drill import Segment, leaf_rows, leaf_table
from ..plans.apply import apply_recipe, project
from ..plans.plan import BATCH
from ..plans.run import recipe_over_lines
from ..recipes.actions import Action
from ..recipes.recipe import Recipe
from ..sinks.files import json_lines


def stream_recipe(stream: DataFrame, recipe: Recipe | Iterable[Action], mode: str = BATCH, **options) -> DataFrame:
    """Apply a recipe to a stream of table rows (csv, parquet, ...)."""
    return apply_recipe(stream, recipe, mode, **options)


def stream_recipe_over_lines(
    lines: DataFrame, recipe: Recipe | Iterable[Action], names: Sequence[str], to_json: bool = False, exact: bool = True
) -> DataFrame:
    """Apply a recipe to a stream of JSON lines. Column names are given, since a
    stream has no whole file to take them from."""
    rows, plan, cells = recipe_over_lines(lines, recipe, list(names), exact)
    return json_lines(rows, plan, cells) if to_json else project(rows, plan, cells)


def stream_drill(
    stream: DataFrame, path: Sequence[Segment], record_id: str, names: Sequence[str], cells: str = "display"
) -> DataFrame:
    """Drill into a stream of JSON lines. ``#`` starts with the caller's record
    id, as a stream has no file positions; the columns are given."""
    return leaf_table(leaf_rows(stream, path, record_id), list(names), cells)
