"""Small helpers for text columns and the character classes of the patterns."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules were written for Unicode-aware `\w \d \s \b` and for a `.` that stops at \n
# only. Java's shorthands differ (with and without its `U` flag), so the patterns spell the
# classes out. ASCII members are listed one by one, which Java tests with a single look-up. The
# last member of WORD, a letter outside the basic plane, makes Java look back by code points.
WORD = f"{ascii_letters}{digits}_\\p{{L}}\\p{{N}}\U00020000"
DIGIT = f"{digits}\\p{{Nd}}"
SPACE = (
    "\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
NOT_AFTER_WORD = f"(?<![{WORD}])"
NOT_BEFORE_WORD = f"(?![{WORD}])"
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def fill(template: str, *values: Column | str) -> Column:
    """`template` with each `{}` replaced by the matching value."""
    pieces = template.split("{}")
    parts: list[Column] = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        column = F.col(value) if isinstance(value, str) else value
        parts += [column.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def first_chars(column: Column, limit: int) -> Column:
    return F.substring(column, 1, limit)


def listed(*parts: Column) -> Column:
    """The parts that are not null, joined by commas."""
    return F.array_join(F.array_compact(F.array(*parts)), ", ")
