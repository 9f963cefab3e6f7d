"""Patterns for personal data."""

from __future__ import annotations

from string import ascii_uppercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatehouse.functions.text import DIGIT, EDGE, NOT_BEFORE_WORD, WORD


def first(chars: str, not_after: str) -> str:
    """One of `chars`, not preceded by one of `not_after`.

    The look-back comes second, so that it is tried only where a match could start.
    """
    return f"[{chars}](?<![{not_after}][{chars}])"


UPPER = ascii_uppercase
CODE = UPPER + digits

# Kinds and patterns, in the order in which they are applied. The order
# matters: an IBAN or a card holds digits that the phone pattern would take.
PII_PATTERNS = (
    (
        "iban",
        f"{first(UPPER, WORD)}[{UPPER}][{DIGIT}]{{2}}(?:[ ]?[{CODE}]{{4}}){{2,7}}"
        f"(?:[ ]?[{CODE}]{{1,4}})?{NOT_BEFORE_WORD}",
    ),
    (
        "card",
        f"{first(DIGIT, WORD)}[{DIGIT}]{{3}}[ -](?:[{DIGIT}]{{4}}[ -]){{2}}[{DIGIT}]{{4}}"
        f"{NOT_BEFORE_WORD}",
    ),
    (
        "email",
        # A word edge: a word character after none, or another one after a word character.
        f"(?:{first(WORD, WORD)}|[.+-](?<=[{WORD}][.+-]))[{WORD}.+-]*+@"
        f"[{WORD}-]++\\.[{WORD}.-]+{EDGE}",
    ),
    (
        "phone",
        f"(?:{first('+', WORD + '/')}[{DIGIT}]|{first(DIGIT, WORD + '/')})"
        f"[{DIGIT} .-]{{7,14}}[{DIGIT}](?![{WORD}/])",
    ),
)

KINDS = tuple(kind for kind, _ in PII_PATTERNS)

# What a part of a text must hold for a match of these patterns, which never hold a space and see none but as
# an edge: each part between two spaces can be searched alone, and only those with this text need be.
WITHIN_SPACES = {dict(PII_PATTERNS)["email"]: "@"}

# What every match of the number patterns begins with: two capitals and two digits, or nine
# characters of a long number. No mask holds a digit, so a text without either never gets one.
NUMBER_KINDS = ("iban", "card", "phone")
NUMBER_START = (
    f"[{UPPER}{DIGIT}+](?:[{DIGIT} .-]{{8}}|(?<=[{UPPER}])[{UPPER}][{DIGIT}]{{2}})"
)


def may_match(kind: str, text: Column, has_number: Column) -> Column | None:
    """A cheap test that rules most texts out, null if there is none for this kind."""
    if kind in NUMBER_KINDS:
        return has_number
    return F.contains(text, F.lit("@")) if kind == "email" else None


def marker(kind: str) -> str:
    return f"[{kind.upper()}_REDACTED]"
