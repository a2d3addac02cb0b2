"""An action list folded into one projection and one conjunction."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from ..functions.parsing import literal_type
from ..functions.types import ColumnType
from ..recipes.actions import Action, Cast, Comparison, Delete, Fill, Filter, FormatTimestamp, Operator, Rename

BATCH, VIEW = "batch", "view"


@dataclass(frozen=True)
class RowTest:
    source: str
    operator: Operator
    value: str
    comparison: Comparison
    column_type: ColumnType


@dataclass
class OutputColumn:
    position: int
    source: str
    name: str
    column_type: ColumnType
    source_type: ColumnType
    fill: str | None = None
    target_format: str | None = None


@dataclass
class Plan:
    mode: str
    columns: list[OutputColumn]
    tests: list[RowTest] = field(default_factory=list)

    @property
    def test_sources(self) -> list[str]:
        return list(dict.fromkeys(test.source for test in self.tests))

    @property
    def read_sources(self) -> list[str]:
        """Source columns whose cells reach the output."""
        return [c.source for c in self.columns if c.fill is None]


def build_plan(
    names: Sequence[str],
    actions: Iterable[Action],
    mode: str = BATCH,
    types: dict[str, ColumnType] | None = None,
) -> Plan:
    """Fold the actions, in order, over the columns known by their current names.

    An action naming no current column does nothing. Taking over the name of
    another column hides that column. In batch mode a column has one transform,
    the last one given; in view mode fill and format live side by side.
    """
    if mode not in (BATCH, VIEW):
        raise ValueError(f"Unknown mode '{mode}'.")
    types = types or {}
    current: dict[str, OutputColumn] = {}
    for position, name in enumerate(names):
        kind = types.get(name, ColumnType.TEXT)
        current[name] = OutputColumn(position, name, name, kind, kind)
    plan = Plan(mode, [])
    for action in actions:
        target = action.old_name if isinstance(action, Rename) else action.column
        column = current.get(target)
        if column is None:
            continue
        if isinstance(action, Rename):
            current[action.new_name] = current.pop(target)
            column.name = action.new_name
        elif isinstance(action, Delete):
            del current[target]
        elif isinstance(action, Filter):
            plan.tests.append(
                RowTest(column.source, action.operator, action.value, action.comparison, column.column_type)
            )
        elif isinstance(action, Cast):
            column.column_type = action.target
        elif isinstance(action, Fill):
            column.fill = action.value
            column.column_type = literal_type(action.value)
            if mode == BATCH:
                column.target_format = None
        elif isinstance(action, FormatTimestamp):
            column.target_format = action.target_format
            if mode == BATCH:
                column.fill = None
        else:
            raise TypeError(f"Unknown action {action!r}")
    plan.columns = sorted(current.values(), key=lambda c: c.position)
    return plan
