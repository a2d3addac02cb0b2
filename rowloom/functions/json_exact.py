"""Reading JSON members with their exact source text.

Variants normalise numbers and nested text (``1.50`` becomes ``1.5``). Where the
source spelling matters, lines go through the small reader below as an Arrow
function: Spark hands over batches of lines and only those that need it, the
others are passed as NULL.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"[ \t\n\r]*")
_KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}


def _no_constant(name: str) -> None:
    raise ValueError(name)


# Values are only skipped over, so numbers need not be converted.
_skip_value = json.JSONDecoder(parse_constant=_no_constant, parse_int=len, parse_float=len).scan_once
_read_string = json.decoder.scanstring


class Broken(ValueError):
    """The line is not a JSON object, or stops being one after some members."""


def members(line: str) -> Iterator[tuple[str, str, str]]:
    """(key, kind, raw text) of the top-level members in source order.

    Text after the closing brace is not looked at. Raises ``Broken`` where the
    line stops being JSON; members before that place have been yielded.
    """
    at = _SPACE.match(line, 0).end()
    if line[at : at + 1] != "{":
        raise Broken
    at = _SPACE.match(line, at + 1).end()
    if line[at : at + 1] == "}":
        return
    while True:
        if line[at : at + 1] != '"':
            raise Broken
        try:
            key, at = _read_string(line, at + 1, True)
            at = _SPACE.match(line, at).end()
            if line[at : at + 1] != ":":
                raise Broken
            start = _SPACE.match(line, at + 1).end()
            _, at = _skip_value(line, start)
        except (ValueError, StopIteration, RecursionError):
            raise Broken from None
        yield key, _KINDS.get(line[start], "number"), line[start:at]
        at = _SPACE.match(line, at).end()
        mark = line[at : at + 1]
        if mark == "}":
            return
        if mark != ",":
            raise Broken
        at = _SPACE.match(line, at + 1).end()


def is_complete(line: str) -> bool:
    """One whole JSON object and nothing after it."""
    try:
        _, end = _skip_value(line, _SPACE.match(line, 0).end())
    except (ValueError, StopIteration, RecursionError):
        return False
    return _SPACE.match(line, end).end() == len(line)


def decoded(raw: str) -> str:
    """Text of a raw JSON string. A lone surrogate cannot be written as UTF-8."""
    return _read_string(raw, 1, True)[0].encode("utf-8", "replace").decode("utf-8")


CELL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("raw", T.StringType())])
_ARROW_CELL = pa.struct([("kind", pa.string()), ("text", pa.string()), ("raw", pa.string())])

# ``again``: the line has an earlier member of that name.
MEMBER = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("raw", T.StringType()),
    T.StructField("again", T.BooleanType()),
])
_ARROW_MEMBER = pa.struct([("key", pa.string()), ("kind", pa.string()), ("raw", pa.string()), ("again", pa.bool_())])


def _cell(kind: str, raw: str) -> dict:
    inner = raw[1:-1] if kind == "string" else raw
    return {"kind": kind, "text": decoded(raw) if kind == "string" else raw, "raw": inner}


def read_cells(line: str, keys: Sequence[str]) -> list[dict]:
    """One cell per wanted key. The first member of a name counts; keys not
    reached before the line breaks are invalid, keys never found are missing."""
    wanted, found, rest = set(keys), {}, "missing"
    try:
        for key, kind, raw in members(line):
            if key in wanted and key not in found:
                found[key] = _cell(kind, raw)
                if len(found) == len(wanted):
                    break
    except Broken:
        rest = "invalid"
    blank = {"kind": rest, "text": None, "raw": None}
    return [found.get(key, blank) for key in keys]


def exact_cells(line: Column, keys: Sequence[str]) -> Column:
    """array<CELL>, one entry per key; NULL for a NULL line."""
    keys = tuple(keys)

    @F.arrow_udf(T.ArrayType(CELL))
    def reader(lines: pa.Array) -> pa.Array:
        if lines.null_count == len(lines):
            return pa.nulls(len(lines), pa.list_(_ARROW_CELL))
        rows = [None if line is None else read_cells(line, keys) for line in lines.to_pylist()]
        return pa.array(rows, pa.list_(_ARROW_CELL))

    return reader(line)


def read_members(line: str, whole_only: bool) -> list[dict] | None:
    found, seen = [], set()
    try:
        for key, kind, raw in members(line):
            found.append({"key": key, "kind": kind, "raw": raw, "again": key in seen})
            seen.add(key)
    except Broken:
        return None
    return found if not whole_only or is_complete(line) else None


def exact_members(line: Column, whole_only: bool = False) -> Column:
    """array<MEMBER> of a line, NULL where it is no JSON object. ``whole_only``
    also rejects an object followed by other text."""

    @F.arrow_udf(T.ArrayType(MEMBER))
    def reader(lines: pa.Array) -> pa.Array:
        rows = [None if line is None else read_members(line, whole_only) for line in lines.to_pylist()]
        return pa.array(rows, pa.list_(_ARROW_MEMBER))

    return reader(line)


class _Object(list):
    """(key, value) pairs of a JSON object, to tell it from an array."""


class _Number(str):
    """A number as it is written."""


_decode = json.JSONDecoder(object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number).raw_decode


class _Raw(str):
    """JSON text that stands as it is."""


def _text_of(value: object) -> str:
    if isinstance(value, _Raw):
        return str(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_text_of, value)) + "]"
    return json.dumps(value)


def _first_pairs(pairs: list[tuple[str, object]]) -> _Raw:
    first: dict[str, object] = {}
    for key, value in pairs:
        first.setdefault(key, value)
    return _Raw("{" + ",".join(f"{json.dumps(key)}:{_text_of(value)}" for key, value in first.items()) + "}")


_decode_first = json.JSONDecoder(object_pairs_hook=_first_pairs, parse_int=_Raw, parse_float=_Raw, parse_constant=_no_constant).raw_decode


def _with_first_members(line: str) -> str | None:
    try:
        return _text_of(_decode_first(line, _SPACE.match(line, 0).end())[0])
    except (ValueError, RecursionError):
        return None


def first_members(line: Column) -> Column:
    """The JSON text with only the first member of each name in every object, which
    is the one that counts; NULL for what is not JSON. Numbers keep their spelling."""

    @F.arrow_udf(T.StringType())
    def reader(lines: pa.Array) -> pa.Array:
        return pa.array([None if line is None else _with_first_members(line) for line in lines.to_pylist()], pa.string())

    return reader(line)


def _leaf(value: object, scalar_name: str) -> list[tuple[str, object]]:
    return value if isinstance(value, _Object) else [(scalar_name, value)]


def leaves(value: object, path: Sequence[tuple[str, str]], scalar_name: str) -> Iterator[list[tuple[str, object]]]:
    """(column, value) pairs of every leaf row below a value, in document order."""
    is_array = isinstance(value, list) and not isinstance(value, _Object)
    if not path:
        yield from (_leaf(element, "value") for element in value) if is_array else (_leaf(value, scalar_name),)
        return
    (segment_kind, name), *rest = path
    if segment_kind == "key" and isinstance(value, _Object):
        for inner in [inner for key, inner in value if key == name][:1]:
            yield from leaves(inner, rest, scalar_name)
    elif segment_kind == "index" and is_array:
        for element in value if rest else [value]:
            yield from leaves(element, rest, scalar_name)


def leaf_cells(line: str, path: Sequence[tuple[str, str]], scalar_name: str) -> list[tuple[str, object]]:
    try:
        value, _ = _decode(line, _SPACE.match(line, 0).end())
    except (ValueError, RecursionError):
        return []
    return [cell for row in leaves(value, path, scalar_name) for cell in row]


def leaf_key_order(line: Column, path: Sequence, scalar_name: str = "value") -> Column:
    """array<string>: columns of the line's leaf rows in first-seen order."""
    steps = [(segment.kind, segment.name) for segment in path]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def reader(lines: pa.Array) -> pa.Array:
        keys = [None if line is None else list(dict(leaf_cells(line, steps, scalar_name))) for line in lines.to_pylist()]
        return pa.array(keys, pa.list_(pa.string()))

    return reader(line)


def _point_bits(cells: list[tuple[str, object]]) -> dict[str, int]:
    found: dict[str, int] = {}
    for key, value in cells:
        if isinstance(value, _Number) and not (value.lstrip("-").isdigit() and -(2**63) <= int(value) < 2**63):
            found[key] = found.get(key, 0) | (1 if "." in value else 2)
    return found


# Lines that may hold a number with an exponent, or one of 19 digits and more.
UNUSUAL_NUMBER = r"[:,\[]\s*-?(?:\d+(?:\.\d+)?[eE]|[\d.]{19})"


def point_bits(line: Column, path: Sequence = (), scalar_name: str = "value") -> Column:
    """map<string,int>: for numbers of the leaf rows that are no 64-bit integers,
    1 if one is written with a decimal point, 2 if one is without, 3 for both.
    NULL for lines without unusual numbers."""
    steps = [(segment.kind, segment.name) for segment in path]

    @F.arrow_udf(T.MapType(T.StringType(), T.IntegerType()))
    def reader(lines: pa.Array) -> pa.Array:
        bits = [None if line is None else list(_point_bits(leaf_cells(line, steps, scalar_name)).items()) for line in lines.to_pylist()]
        return pa.array(bits, pa.map_(pa.string(), pa.int32()))

    return reader(F.when(line.rlike(UNUSUAL_NUMBER), line))
