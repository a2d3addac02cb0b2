"""Target formats of FormatTimestamp: .NET date/time patterns as Spark columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FORMAT = "yyyy-MM-dd HH:mm:ss"

# What the one-letter formats stand for.
STANDARD_FORMATS = {
    "d": "MM/dd/yyyy",
    "D": "dddd, dd MMMM yyyy",
    "f": "dddd, dd MMMM yyyy HH:mm",
    "F": "dddd, dd MMMM yyyy HH:mm:ss",
    "g": "MM/dd/yyyy HH:mm",
    "G": "MM/dd/yyyy HH:mm:ss",
    "M": "MMMM dd",
    "m": "MMMM dd",
    "O": "yyyy'-'MM'-'dd'T'HH':'mm':'ss'.'fffffffK",
    "o": "yyyy'-'MM'-'dd'T'HH':'mm':'ss'.'fffffffK",
    "R": "ddd, dd MMM yyyy HH':'mm':'ss 'GMT'",
    "r": "ddd, dd MMM yyyy HH':'mm':'ss 'GMT'",
    "s": "yyyy'-'MM'-'dd'T'HH':'mm':'ss",
    "t": "HH:mm",
    "T": "HH:mm:ss",
    "u": "yyyy'-'MM'-'dd HH':'mm':'ss'Z'",
    "U": "dddd, dd MMMM yyyy HH:mm:ss",
    "Y": "yyyy MMMM",
    "y": "yyyy MMMM",
}

# Specifiers with the same meaning under another spelling.
SAME_MEANING = {
    "d": "d", "dd": "dd", "ddd": "EEE", "dddd": "EEEE",
    "M": "M", "MM": "MM", "MMM": "MMM", "MMMM": "MMMM",
    "yy": "yy", "yyy": "yyy", "yyyy": "yyyy", "yyyyy": "yyyyy",
    "h": "h", "hh": "hh", "H": "H", "HH": "HH",
    "m": "m", "mm": "mm", "s": "s", "ss": "ss", "tt": "a",
}

# Specifiers that always print the same, the zone being UTC and
# parsed values carrying no zone of their own.
CONSTANT = {"g": "A.D.", "K": "", "z": "+0", "zz": "+00", "zzz": "+00:00"}

_LONGEST = {"d": 4, "M": 4, "h": 2, "H": 2, "m": 2, "s": 2, "t": 2, "z": 3, "g": 1}
_PIECE = re.compile(r"'(?P<q1>[^']*)'|\"(?P<q2>[^\"]*)\"|\\(?P<esc>.)|%(?P<one>.)|(?P<run>([dfFgHhKMmstyz])\6*)|(?P<other>.)", re.S)


def format_timestamp(value: Column, pattern: str) -> Column:
    """Render a timestamp; unknown one-letter formats fail while the plan is built."""
    if len(pattern) == 1:
        if pattern not in STANDARD_FORMATS:
            raise ValueError(f"Unknown timestamp format '{pattern}'.")
        pattern = STANDARD_FORMATS[pattern]
    parts = _joined([piece for match in _PIECE.finditer(pattern) for piece in _translate(match)])
    columns = [_column(value, kind, text) for kind, text in parts]
    if not columns:
        return F.when(value.isNotNull(), "")
    return columns[0] if len(columns) == 1 and parts[0][0] == "java" else F.when(value.isNotNull(), F.concat(*columns))


def _translate(match: re.Match) -> list[tuple[str, str]]:
    for group in ("q1", "q2", "esc", "other"):
        if match.group(group) is not None:
            return [("java", _quoted(match.group(group)))]
    run = match.group("run") or match.group("one")
    letter = run[0]
    if letter in "fF":
        if len(run) > 7:
            raise ValueError(f"Unknown timestamp format part '{run}'.")
        return [("java", "S" * len(run))] if letter == "f" else [("trimmed fraction", "S" * len(run))]
    if letter == "y":
        return [("short year", run)] if len(run) == 1 else [("java", SAME_MEANING.get(run, "y" * len(run)))]
    if letter not in _LONGEST and letter != "K":
        return [("java", _quoted(run))]
    run = run[: _LONGEST.get(letter, 1)]
    if run == "t":
        return [("half day letter", "a")]
    return [("java", _quoted(CONSTANT[run]) if run in CONSTANT else SAME_MEANING[run])]


def _quoted(text: str) -> str:
    if not text:
        return ""
    return "'" + text.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#]", text) else text


def _joined(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Adjacent plain parts become one pattern, so most formats are one call."""
    def add(done: list, part: tuple[str, str]) -> list:
        if done and part[0] == done[-1][0] == "java" and not (done[-1][1].endswith("'") and part[1].startswith("'")):
            return [*done[:-1], ("java", done[-1][1] + part[1])]
        return [*done, part] if part[1] else done
    return reduce(add, parts, [])


def _column(value: Column, kind: str, pattern: str) -> Column:
    if kind == "trimmed fraction":
        return F.regexp_replace(F.date_format(value, pattern), "0+$", "")
    if kind == "short year":
        return F.date_format(value, "yy").cast("int").cast("string")
    if kind == "half day letter":
        return F.substring(F.date_format(value, "a"), 1, 1)
    return F.date_format(value, pattern)
