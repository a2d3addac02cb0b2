"""Recipes: named action lists, and their text files."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, replace

from ..functions.types import ColumnType
from .actions import Action, Cast, Comparison, Delete, Fill, Filter, FormatTimestamp, Operator, Rename


@dataclass(frozen=True)
class Recipe:
    name: str
    actions: tuple[Action, ...] = ()
    description: str | None = None
    last_modified: datetime.datetime | None = None

    def append(self, action: Action) -> Recipe:
        return replace(self, actions=(*self.actions, action))

    def clear(self) -> Recipe:
        return replace(self, actions=())


# Field names per action type in recipe files.
_FIELDS = {
    "Rename": ("oldName", "newName"),
    "Delete": ("columnName",),
    "Cast": ("columnName", "targetType"),
    "Filter": ("columnName", "operator", "comparisonType", "value"),
    "Fill": ("columnName", "value"),
    "FormatTimestamp": ("columnName", "targetFormat"),
}
_BARE_FIELDS = ("targetType", "operator", "comparisonType")


def _member(enum: type, name: str, field: str):
    try:
        return enum(name)
    except ValueError:
        raise ValueError(f"{field} has no choice '{name}'.") from None


_BUILD = {
    "Rename": Rename,
    "Delete": Delete,
    "Cast": lambda column, target: Cast(column, ColumnType.named(target)),
    "Filter": lambda column, op, kind, value: Filter(
        column, _member(Operator, op, "operator"), _member(Comparison, kind, "comparisonType"), value
    ),
    "Fill": Fill,
    "FormatTimestamp": FormatTimestamp,
}


def action_from_fields(fields: dict[str, str]) -> Action:
    """Build one action from the fields of a recipe file entry."""
    if "type" not in fields:
        raise ValueError("An action without a type.")
    kind = fields["type"]
    if kind not in _FIELDS:
        raise ValueError(f"There is no action '{kind}'.")
    missing = next((name for name in _FIELDS[kind] if name not in fields), None)
    if missing:
        raise ValueError(f"A {kind} action needs '{missing}'.")
    return _BUILD[kind](*(fields[name] for name in _FIELDS[kind]))


def action_to_fields(action: Action) -> dict[str, str]:
    values = [getattr(value, "value", value) for value in vars(action).values()]
    kind = type(action).__name__
    return {"type": kind, **dict(zip(_FIELDS[kind], values, strict=True))}


_ENTRY = re.compile(r"  - type: (?P<type>.*)|    (?P<key>.+?): (?P<value>.*)")
_ROOT_KEYS = ("name", "description", "lastModified")


def loads(text: str) -> Recipe:
    """Read a recipe file: root keys, then a list of flat action entries."""
    root: dict[str, str] = {}
    entries: list[dict[str, str]] = []
    in_actions = False
    for line in (raw.rstrip("\r") for raw in text.split("\n")):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if in_actions:
            _read_entry_line(line, entries)
        elif line == "actions:":
            in_actions = True
        elif line != "actions: []":
            _read_root_line(line, root)
    if not root.get("name"):
        raise ValueError("A recipe needs a 'name'.")
    modified = root.get("lastModified")
    return Recipe(
        name=root["name"],
        actions=tuple(action_from_fields(entry) for entry in entries),
        description=root.get("description"),
        last_modified=_read_time(modified) if modified is not None else None,
    )


def _read_root_line(line: str, root: dict[str, str]) -> None:
    key, colon, value = line.partition(": ")
    if not colon:
        raise ValueError(f"Cannot read the line '{line}'.")
    if key not in _ROOT_KEYS:
        raise ValueError(f"A recipe has no '{key}'.")
    if root.get(key):
        raise ValueError(f"'{key}' is given twice.")
    root[key] = _unquoted(value)


def _read_entry_line(line: str, entries: list[dict[str, str]]) -> None:
    match = _ENTRY.fullmatch(line)
    if match and match["type"] is not None:
        entries.append({"type": match["type"]})
    elif not entries or not line.startswith("    "):
        raise ValueError(f"No action begins in the line '{line}'.")
    elif not match:
        raise ValueError(f"Cannot read the action's line '{line}'.")
    else:
        entries[-1][match["key"]] = _unquoted(match["value"])


def _read_time(text: str) -> datetime.datetime:
    try:
        return datetime.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text))
    except ValueError:
        raise ValueError(f"lastModified is no time: '{text}'.") from None


def _unquoted(text: str) -> str:
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    return re.sub(r"\\(.)", r"\1", text[1:-1])


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dumps(recipe: Recipe) -> str:
    lines = [f"name: {_quoted(recipe.name)}"]
    if recipe.description is not None:
        lines.append(f"description: {_quoted(recipe.description)}")
    if recipe.last_modified is not None:
        lines.append(f"lastModified: {recipe.last_modified.isoformat(timespec='microseconds')}")
    lines.append("actions:" if recipe.actions else "actions: []")
    for action in recipe.actions:
        fields = action_to_fields(action)
        lines.append(f"  - type: {fields.pop('type')}")
        lines += [f"    {key}: {value if key in _BARE_FIELDS else _quoted(value)}" for key, value in fields.items()]
    return "\n".join(lines) + "\n"


def load(path: str) -> Recipe:
    with open(path, encoding="utf-8") as source:
        return loads(source.read())


def save(recipe: Recipe, path: str) -> None:
    with open(path, "w", encoding="utf-8") as target:
        target.write(dumps(recipe))
