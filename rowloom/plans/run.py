"""Running a recipe from files to files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..recipes.actions import Action
from ..recipes.recipe import Recipe
from ..sinks.files import json_lines, write_csv, write_json_array, write_jsonl
from ..sources.csv import read_csv
from ..sources.detect import format_of_path
from ..sources.json_documents import read_json_array, read_json_object
from ..sources.jsonl import JsonLinesCell, JsonLinesTestCell, key_names, read_lines, records, with_cells, with_shown
from .apply import actions_of, keep_rows, project, table_cells
from .cells import Cell, CsvCell, column
from .plan import BATCH, Plan, build_plan


def recipe_over_lines(
    lines: DataFrame, recipe: Recipe | Iterable[Action], names: list[str] | None = None, exact: bool = True
) -> tuple[DataFrame, Plan, dict[str, Cell]]:
    """Filtered rows, plan and output cells of a recipe over JSON lines.

    Filters run first and on their own columns, so that the cells of the output
    are only made for rows that stay.
    """
    names = key_names(lines) if names is None else names
    plan = build_plan(names, actions_of(recipe), BATCH)
    rows = records(lines.select("line")) if "record" not in lines.columns else lines
    sources = plan.test_sources
    if sources:
        rows = with_shown(rows, sources, exact)
        tests: dict[str, Cell] = {s: JsonLinesTestCell(F.col(f"shown_{i}")) for i, s in enumerate(sources)}
        rows = keep_rows(rows, plan, tests, computed=True).drop(*(f"shown_{i}" for i in range(len(sources))))
    read = plan.read_sources
    rows = with_cells(rows, read, exact, raw=False)
    return rows, plan, {source: JsonLinesCell(F.col(f"cell_{i}")) for i, source in enumerate(read)} | _blank_cells(plan)


def _blank_cells(plan: Plan) -> dict[str, Cell]:
    """Filled columns never read their source."""
    return {c.source: CsvCell(F.lit("")) for c in plan.columns if c.fill is not None}


def recipe_over_csv(df: DataFrame, recipe: Recipe | Iterable[Action]) -> tuple[DataFrame, Plan, dict[str, Cell]]:
    plan = build_plan(df.columns, actions_of(recipe), BATCH)
    cells: dict[str, Cell] = {name: CsvCell(column(name)) for name in df.columns}
    return keep_rows(df, plan, cells), plan, cells


def recipe_over_table(df: DataFrame, recipe: Recipe | Iterable[Action]) -> tuple[DataFrame, Plan, dict[str, Cell]]:
    plan = build_plan(df.columns, actions_of(recipe), BATCH)
    cells = table_cells(df, df.columns)
    return keep_rows(df, plan, cells), plan, cells


def open_input(
    spark: SparkSession, path: str | list[str], data_format: str, recipe: Recipe | Iterable[Action], exact: bool = True,
    quoted_breaks: bool | None = None, encoding: str = "UTF-8", names: list[str] | None = None,
) -> tuple[DataFrame, Plan, dict[str, Cell]]:
    if data_format == "csv":
        return recipe_over_csv(read_csv(spark, path, quoted_breaks=quoted_breaks, encoding=encoding), recipe)
    if data_format == "jsonl":
        return recipe_over_lines(read_lines(spark, path), recipe, names, exact)
    if data_format == "json_array":
        return recipe_over_lines(read_json_array(spark, path).select("line"), recipe, names, exact)
    if data_format == "json_object":
        return recipe_over_lines(read_json_object(spark, path).select("line"), recipe, names, exact)
    if data_format == "parquet":
        return recipe_over_table(spark.read.parquet(*([path] if isinstance(path, str) else path)), recipe)
    raise ValueError(f"Unsupported format: {data_format}")


def run_recipe(
    spark: SparkSession,
    input_path: str | list[str],
    recipe: Recipe | Iterable[Action],
    output_path: str,
    input_format: str | None = None,
    output_format: str | None = None,
    exact: bool = True,
    quoted_breaks: bool | None = None,
    encoding: str = "UTF-8",
    write_mode: str = "errorifexists",
    names: list[str] | None = None,
) -> None:
    """Read, filter, transform and write in one job.

    ``input_path`` may be a file, a folder, a glob or a list of them. Formats
    follow from the extensions (``.csv``, ``.jsonl``) unless given; inputs may
    also be "json_array", "json_object" (its values are the records) or "parquet",
    outputs "json_array". ``names`` of JSON members save the passes that look for
    them. Any failure fails the job.
    """
    first = input_path if isinstance(input_path, str) else input_path[0]
    input_format = input_format or format_of_path(first, allow_json=False)
    output_format = output_format or format_of_path(output_path, allow_json=False)
    if output_format not in ("csv", "jsonl", "json_array"):
        raise ValueError(f"Unsupported format: {output_format}")
    rows, plan, cells = open_input(spark, input_path, input_format, recipe, exact, quoted_breaks, encoding, names)
    if output_format == "csv":
        write_csv(project(rows, plan, cells), output_path, write_mode)
    else:
        write = write_jsonl if output_format == "jsonl" else write_json_array
        write(json_lines(rows, plan, cells), output_path, write_mode)
