"""The six recipe actions and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from ..functions.parsing import literal_float, literal_is_timestamp
from ..functions.types import ColumnType


class Operator(Enum):
    EQUALS = "Equals"
    NOT_EQUALS = "NotEquals"
    GREATER_THAN = "GreaterThan"
    LESS_THAN = "LessThan"
    GREATER_OR_EQUAL = "GreaterThanOrEqual"
    LESS_OR_EQUAL = "LessThanOrEqual"
    CONTAINS = "Contains"
    NOT_CONTAINS = "NotContains"
    STARTS_WITH = "StartsWith"
    ENDS_WITH = "EndsWith"

    @property
    def is_ordering(self) -> bool:
        return self in (Operator.GREATER_THAN, Operator.LESS_THAN, Operator.GREATER_OR_EQUAL, Operator.LESS_OR_EQUAL)

    @property
    def is_equality(self) -> bool:
        return self in (Operator.EQUALS, Operator.NOT_EQUALS)


class Comparison(Enum):
    TEXT = "Text"
    NUMBER = "Number"
    TIMESTAMP = "Timestamp"


@dataclass(frozen=True)
class Rename:
    old_name: str
    new_name: str


@dataclass(frozen=True)
class Delete:
    column: str


@dataclass(frozen=True)
class Cast:
    column: str
    target: ColumnType


@dataclass(frozen=True)
class Fill:
    column: str
    value: str


@dataclass(frozen=True)
class FormatTimestamp:
    column: str
    target_format: str

    def __post_init__(self) -> None:
        if not self.target_format.strip():
            raise ValueError("Formatting a timestamp needs a targetFormat.")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: Operator
    comparison: Comparison
    value: str

    def __post_init__(self) -> None:
        fits = self.operator.is_equality or self.operator.is_ordering != (self.comparison is Comparison.TEXT)
        if not fits:
            raise ValueError(f"{self.comparison.value} cells cannot be tested by {self.operator.value}.")
        if self.comparison is Comparison.NUMBER:
            number = literal_float(self.value)
            readable = number is not None and math.isfinite(number)
        else:
            readable = self.comparison is Comparison.TEXT or literal_is_timestamp(self.value)
        if not readable:
            raise ValueError(f"A filter by {self.comparison.value} cannot read '{self.value}'.")


Action = Rename | Delete | Cast | Fill | FormatTimestamp | Filter


def where(column: str, operator: str | Operator, value: str, comparison: str | Comparison = Comparison.TEXT) -> Filter:
    """Short form: ``where("age", "GreaterThan", "30", "Number")``."""
    return Filter(column, Operator(operator), Comparison(comparison), value)
