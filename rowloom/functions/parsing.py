"""Reading cell text as booleans, numbers and timestamps.

All of it is built-in column expressions. Cheap tests come first, so that the
rarely needed forms (grouped digits, month names, ...) cost nothing on plain data.
"""

from __future__ import annotations

import datetime
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import ColumnType

_BLANKS = "\t\n\x0b\f\r "


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(_BLANKS))


def is_blank(text: Column) -> Column:
    return text.rlike(r"^\s*$")


# ---------------------------------------------------------------- booleans

def is_bool(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(?:true|false)\s*$")


def parse_bool(text: Column) -> Column:
    """``true``/``false`` in any case; a plain cast would also take t, yes, 1."""
    return F.when(is_bool(text), F.lower(trimmed(text)) == "true")


# ----------------------------------------------------------------- numbers

_NUMBER = r"(?:\d[\d,]*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
_PLAIN = r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_SIGNED = rf"^\s*[+-]?{_NUMBER}\s*$"
_DRESSED = rf"^\s*([+\-(])?\s*¤?\s*({_NUMBER})\s*¤?\s*([+\-)])?\s*$"


def parse_whole(text: Column) -> Column:
    """64-bit integer or NULL. The cast throws inside Spark on other text, which
    costs far more than the test before it."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint"))


def parse_float(text: Column, lenient: bool = True) -> Column:
    """Double or NULL. Digit grouping and exponents are always accepted;
    ``lenient`` adds trailing signs, parentheses and the currency sign."""
    # As above; and the cast takes forms of its own, like 10d and 0x1p3.
    plain = text.rlike(_PLAIN)
    slow = (
        F.when(text.rlike(_SIGNED), F.translate(trimmed(text), ",", "").try_cast("double"))
        .when(text.rlike(r"(?i)^\s*[+-]?nan\s*$"), F.lit(math.nan))
        .when(text.rlike(r"(?i)^\s*\+?infinity\s*$"), F.lit(math.inf))
        .when(text.rlike(r"(?i)^\s*-infinity\s*$"), F.lit(-math.inf))
    )
    if lenient:
        slow = slow.when(text.rlike(_DRESSED), _dressed_number(text))
    return F.when(plain, text.try_cast("double")).otherwise(slow)


def _dressed_number(text: Column) -> Column:
    before = F.regexp_extract(text, _DRESSED, 1)
    after = F.regexp_extract(text, _DRESSED, 3)
    size = F.translate(F.regexp_extract(text, _DRESSED, 2), ",", "").try_cast("double")
    bracketed = (before == "(") & (after == ")")
    one_sign = before.isin("", "+", "-") & after.isin("", "+", "-") & ((before == "") | (after == ""))
    negative = bracketed | (before == "-") | (after == "-")
    return F.when(bracketed | one_sign, F.when(negative, -size).otherwise(size))


# -------------------------------------------------------------- timestamps

_ISO = (
    r"^\s*(?!0000)\d{4}-\d{1,2}-\d{1,2}"
    r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?\s*$"
)
# Month first, digits only: common enough to be read in one step.
_SLASHED = r"^\s*(\d{1,2})[-/](\d{1,2})[-/](\d{4})(?:\s+(\d{1,2}:\d{2})(?:(:\d{2}(?:\.\d{1,9})?))?)?\s*$"
_NAMES = "mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_OTHER_START = rf"(?i)^\s*(?:\d{{1,4}}[-/.]\d{{1,2}}(?:[-/.\s]|$)|\d{{1,2}}:\d|\d{{1,2}}[\s-]+(?:{_NAMES})|(?:{_NAMES})[a-z]*[,\s])"
_DAY_NAME = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+"
_MONTH_NAME = (
    r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    r"sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Date shapes beyond ISO and how they read as year-month-day. ``#n#`` is a month
# that was written as a name, ``{year}`` and ``{today}`` stand for the current ones.
_SHAPES = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?=$|[t\s])", "$1-$2-$3"),
    (r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4}|\d{2})(?=$|[t\s])", "$3-$1-$2"),
    (r"^(\d{1,2})[\s-]+#(\d+)#[\s,-]+(\d{4}|\d{2})(?=$|[t\s])", "$3-$2-$1"),
    (r"^#(\d+)#\s+(\d{1,2}),?\s+(\d{4})(?=$|[t\s])", "$3-$1-$2"),
    (r"^(\d{4})[-/](\d{1,2})$", "$1-$2-1"),
    (r"^#(\d+)#,?\s+(\d{4})$", "$2-$1-1"),
    (r"^(\d{1,2})/(\d{1,2})$", "{year}-$1-$2"),
    (r"^#(\d+)#\s+(\d{1,2})$", "{year}-$1-$2"),
    (r"^(\d{1,2})\s+#(\d+)#$", "{year}-$2-$1"),
    (r"^(?=\d{1,2}:\d{1,2})", "{today} "),
    # Two-digit years: 00-49 are 2000-2049, 50-99 are 1950-1999.
    (r"^([0-4]\d)-", "20$1-"),
    (r"^([5-9]\d)-", "19$1-"),
)
_CLOCK = (
    (r"^(\S+?)(?:t|\s+t?\s*)(?=\d{1,2}:\d{1,2})", "$1 "),
    (r" 12(:[\d:.]+)\s*am\b", " 0$1"),
    (r" (0?[1-9]|1[012])(:[\d:.]+)\s*[ap]m\b", " $1$2"),
    (r"\s*(?:gmt|utc|z)$", "Z"),
    (r" (\d{1,2}:\d{1,2})\s*(?=Z|[+-]|$)", " $1:00"),
    (r"\s+(?=[+-]\d)", ""),
)
_AFTERNOON = r"(?:^|[t\s])(?:0?[1-9]|1[01]):[\d:.]+\s*pm\b"
_CANONICAL = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,9})?(?:Z|[+-]\d{1,2}(?::?\d{2})?)?)?$"


def _layouts() -> dict[str, tuple[int, ...]]:
    """Common layouts of dates with month names, by their skeleton (digits as 9, letters as a):
    where year, month, day, clock, zone and day name begin (0: none), and the clock's length."""
    found = {}
    for day_name in ("", "aaa, ", "aaa "):
        for date in ("99 aaa 9999", "99-aaa-9999", "aaa 99, 9999", "aaa 99 9999"):
            for clock in ("", " 99:99", " 99:99:99"):
                for zone in ("", " aaa") if clock else ("",):
                    first = len(day_name) + 1
                    places = [first + date.index(part) for part in ("9999", "aaa")] + [first + date.index("99")]
                    at_clock = first + len(date) + 1 if clock else 0
                    at_zone = at_clock + len(clock) if zone else 0
                    found[day_name + date + clock + zone] = (*places, at_clock, at_zone, 1 if day_name else 0, max(0, len(clock) - 1))
    return found


_LAYOUTS = _layouts()
_LETTERS, _DAYS = "abcdefghijklmnopqrstuvwxyz", "montuewedthufrisatsun"


def _by_layout(text: Column) -> Column:
    """Timestamp of a text in one of the layouts, NULL for any other."""
    lowered = F.lower(trimmed(text))
    skeleton = F.translate(lowered, _LETTERS + "0123456789", "a" * 26 + "9" * 10)
    places = F.array(*(F.array(*map(F.lit, x)) for x in _LAYOUTS.values()))
    layout = F.get(places, F.array_position(F.array(*map(F.lit, _LAYOUTS)), skeleton).cast("int") - 1)

    def third(name: Column, names: str) -> Column:
        """Number of a three-letter name, from 1; NULL if it is none."""
        at = F.position(name, F.lit(names))
        return F.when(at % 3 == 1, F.floor(at / 3) + 1)

    def read(found: Column) -> Column:
        part = lambda k, size: F.substring(found["text"], found["places"][k], F.lit(size) if isinstance(size, int) else size)
        named = (found["places"][5] == 0) | third(part(5, 3), _DAYS).isNotNull()
        zoned = (found["places"][4] == 0) | part(4, 3).isin("gmt", "utc")
        year, month = part(0, 4), third(part(1, 3), _MONTHS)
        clock = F.when(found["places"][3] == 0, "00:00:00").when(found["places"][6] == 5, F.concat(part(3, 5), F.lit(":00"))).otherwise(part(3, 8))
        whole = F.concat(year, F.lit("-"), month.cast("string"), F.lit("-"), part(2, 2), F.lit(" "), clock)
        return F.when(found["places"].isNotNull() & named & zoned & (year != "0000"), whole.try_cast("timestamp"))

    # Over an array of one, so that text and layout are worked out once.
    return F.transform(F.array(F.struct(lowered.alias("text"), layout.alias("places"))), read)[0]


def parse_timestamp(text: Column) -> Column:
    """Timestamp or NULL, read the invariant-culture way (month before day)."""
    seconds_added = F.regexp_replace(trimmed(text), r"^(\S+[T ]\d{1,2}:\d{2})( ?(?:Z|[+-]))", "$1:00$2")
    # No readable form is longer than this once runs of blanks count as one.
    brief = F.regexp_replace(trimmed(text), r"\s+", " ")
    short = (F.length(text) <= 80) | (F.length(brief) <= 80)
    other = F.when(text.rlike(_OTHER_START) & short, F.coalesce(_by_layout(text), _other_timestamp(text)))
    slashed = F.regexp_replace(text, _SLASHED, "$3-$1-$2 $4$5")
    return (
        F.when(text.rlike(_ISO), seconds_added.try_cast("timestamp"))
        .when(text.rlike(_SLASHED), slashed.try_cast("timestamp"))
        .otherwise(other)
    )


def _other_timestamp(text: Column) -> Column:
    lowered = F.lower(trimmed(text))
    month_no = (F.position(F.substring(F.regexp_extract(lowered, _MONTH_NAME, 1), 1, 3), F.lit(_MONTHS)) + 2).cast("int")
    month_token = F.concat(F.lit("#"), F.floor(month_no / 3).cast("string"), F.lit("#"))
    iso = F.regexp_replace(F.regexp_replace(lowered, _DAY_NAME, ""), F.lit(_MONTH_NAME), month_token)
    for shape, reading in (*_SHAPES, *_CLOCK):
        iso = F.regexp_replace(iso, F.lit(shape), _filled_in(reading))
    hours = F.when(lowered.rlike(_AFTERNOON), F.expr("interval 12 hours")).otherwise(F.expr("interval 0 hours"))
    return F.regexp_extract(iso, _CANONICAL, 0).try_cast("timestamp") + hours


def _filled_in(reading: str) -> Column:
    if reading.startswith("{year}"):
        return F.concat(F.date_format(F.current_date(), "yyyy"), F.lit(reading.removeprefix("{year}")))
    if reading.startswith("{today}"):
        return F.concat(F.current_date().cast("string"), F.lit(reading.removeprefix("{today}")))
    return F.lit(reading)


# --------------------------------------------------------- type of a text cell

def text_type_code(text: Column) -> Column:
    """Most specific logical type of a text cell, as its code."""
    return (
        F.when(is_bool(text), ColumnType.BOOLEAN.code)
        .when(parse_whole(text).isNotNull(), ColumnType.WHOLE.code)
        .when(parse_float(text, lenient=False).isNotNull(), ColumnType.FLOAT.code)
        .when(parse_timestamp(text).isNotNull(), ColumnType.TIMESTAMP.code)
        .otherwise(ColumnType.TEXT.code)
    )


# --------------------------------------------- the same readings for one literal
# Recipe values (thresholds, fill texts) are single strings, checked while the
# plan is built and without running a Spark job.

_LITERAL_NUMBER = re.compile(_DRESSED)
_LITERAL_SIGNS = {("", ""), ("+", ""), ("-", ""), ("", "+"), ("", "-"), ("(", ")")}
_LITERAL_WHOLE = re.compile(r"\s*[+-]?\d+\s*")


def literal_is_whole(value: str) -> bool:
    return bool(_LITERAL_WHOLE.fullmatch(value)) and -(2**63) <= int(value) < 2**63


def literal_float(value: str, lenient: bool = True) -> float | None:
    word = value.strip().lower()
    if word in ("nan", "+nan", "-nan", "infinity", "+infinity", "-infinity"):
        return float(word)
    match = _LITERAL_NUMBER.match(value)
    if not match:
        return None
    signs = (match.group(1) or "", match.group(3) or "")
    if signs not in _LITERAL_SIGNS or (not lenient and (signs[1] or "¤" in value)):
        return None
    size = float(match.group(2).replace(",", ""))
    return -size if "-" in signs or "(" in signs else size


_LITERAL_DATE = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2}):(\d{1,2}):(\d{1,2}))?")


def literal_is_timestamp(value: str) -> bool:
    text = re.sub(_DAY_NAME, "", value.strip().lower())
    text = re.sub(_MONTH_NAME, lambda m: f"#{_MONTHS.index(m[0][:3]) // 3 + 1}#", text)
    for shape, reading in (*_SHAPES, *_CLOCK):
        reading = reading.replace("{year}", "2000").replace("{today}", "2000-1-1")
        text = re.sub(shape, re.sub(r"\$(\d)", r"\\g<\1>", reading), text)
    if not re.match(_CANONICAL, text):
        return False
    try:
        datetime.datetime(*(int(part) for part in _LITERAL_DATE.match(text).groups() if part is not None))
        return True
    except ValueError:
        return False


def literal_type(value: str) -> ColumnType:
    if value.strip().lower() in ("true", "false"):
        return ColumnType.BOOLEAN
    if literal_is_whole(value):
        return ColumnType.WHOLE
    if literal_float(value, lenient=False) is not None:
        return ColumnType.FLOAT
    return ColumnType.TIMESTAMP if literal_is_timestamp(value) else ColumnType.TEXT
