"""Comparing text without regard to case, one character at a time.

Two characters are the same if their one-character uppercase forms are. Spark's
``lower`` comes close and is fast. It differs for a few characters: some have
lowercase forms of several characters or of another class (the Kelvin sign), for
some the form depends on the neighbours (the final sigma). Those are replaced
before lowering, and only where they could matter.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNCHANGED = "İı"  # dotted capital I and dotless small i: caseless here
_PRIVATE = 0xE000


def upper_of(char: str) -> str:
    """One-character uppercase form, the character itself if there is none."""
    upper = char.upper()
    return char if len(upper) != 1 or char in _UNCHANGED else upper


@cache
def replacements() -> dict[str, str]:
    """Characters for which ``lower`` is no substitute, and what stands for them:
    the small letter of their class, or a private character for a class of its own."""
    out: dict[str, str] = {"Σ": "σ"}
    own: dict[str, str] = {}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000)):
        char = chr(code)
        upper = upper_of(char)
        small = upper.lower()
        if len(small) != 1 or upper_of(small) != upper:
            small = own.setdefault(upper, chr(_PRIVATE + len(own)))
        if char.lower() != small:
            out[char] = small
    return out


def fold(value: str) -> str:
    table = replacements()
    return "".join(table.get(char, char) for char in value).lower()


def folded(text: Column, value: str) -> Column:
    """``text`` in the form to be compared with ``fold(value)``."""
    table = replacements()
    # Characters that matter: those that fold to, or are lowered to, one in the value.
    wanted = set(fold(value)) | set(value.lower())
    chars = [c for c, small in table.items() if small in wanted or set(c.lower()) & wanted]
    lowered = F.lower(text)
    if not chars:
        return lowered
    replaced = F.lower(F.translate(text, "".join(chars), "".join(table[c] for c in chars)))
    if not value.isascii():
        return replaced
    present = F.contains(text, F.lit(chars[0]))
    for char in chars[1:]:
        present = present | F.contains(text, F.lit(char))
    return F.when(present, replaced).otherwise(lowered)
