"""Columns for the prompt-injection scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from string import ascii_letters, digits

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gatehouse.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE, WORD


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # Java pattern, searched in normalised lower-case text
    weight: int
    # Every match holds one of these words; a plain search for them spares most texts the
    # pattern. Empty: always try the pattern.
    words: tuple[str, ...] = ()

    def hits(self, text: Column) -> Column:
        found = text.rlike(self.pattern)
        if not self.words:
            return found
        return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in self.words]) & found


# Names, patterns and weights of the rules, in reporting order. The repeated
# group of the first one is possessive, because Java would otherwise recurse once per
# repetition; no qualifier is a prefix of a following word, so the matches are the same.
RULES = (
    Rule(
        "override-instructions",
        "(?:ignore|disregard|forget) (?:your |the |all |previous |prior )*+"
        "(?:instructions|prompts?|rules|everything)",
        2,
        ("ignore", "disregard", "forget"),
    ),
    Rule("fake-system", f"{NOT_AFTER_WORD}system[{SPACE}]*:", 2, ("system",)),
    Rule("new-instructions", f"new instructions?[{SPACE}]*:", 2, ("new instruction",)),
    Rule(
        "role-hijack",
        f"(?:you are now{NOT_BEFORE_WORD}|act as (?:an? |the )?(?:admin|root|developer|system))",
        2,
        ("you are now", "act as "),
    ),
    Rule("reveal-prompt", "reveal (?:your|the) (?:system )?prompt", 2, ("reveal ",)),
    Rule("exfil-explicit", "(?:exfiltrate|leak (?:the|all|internal))", 2, ("exfiltrate", "leak ")),
    Rule("send-to-target", "send (?:it|them|the|this|all)[^\\n]{0,60}(?:to|@)", 1, ("send ",)),
    Rule(
        "urgency-override",
        "(?:before doing anything else|do this first|immediately and without)",
        1,
        ("before doing anything else", "do this first", "immediately and without"),
    ),
    Rule("tool-coercion", f"(?:use|call) the [{WORD}]+ tool", 1, (" tool",)),
)

# Characters counted as hidden text, and what looks like an encoded payload.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
ENCODED = f"{ascii_letters}{digits}+/"
ENCODED_BLOB = f"[{ENCODED}]{{40,}}={{0,2}}"
# Matches a whole text without any such run.
NO_BLOB = f"\\A(?:[{ENCODED}]{{0,39}}+[^{ENCODED}])*+[{ENCODED}]{{0,39}}+\\z"

HIDDEN_TEXT = "hidden-text"
ENCODED_PAYLOAD = "encoded-payload"

# Characters that NFKC leaves alone wherever they stand: ASCII, Latin and Cyrillic letters,
# common punctuation, kana and the main CJK block. A test checks every one of them.
NFKC_STABLE = (
    "\\x00-\\x7f\\xa1-\\xa7\\xa9\\xab-\\xae\\xb0\\xb1\\xb6\\xb7\\xbb\\xbf-\\u0131\\u0134-\\u013e"
    "\\u0141-\\u0148\\u014a-\\u017e\\u0400-\\u0482\\u048a-\\u052f\\u2010\\u2012-\\u2016"
    "\\u2018-\\u2023\\u20ac\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fff"
)


def not_ascii(text: Column) -> Column:
    """Whether a text holds more than ASCII; only then the next two steps can change it."""
    return F.length(text) != F.octet_length(text)


def strip_hidden(text: Column) -> Column:
    # Searching is much cheaper than translating, and most texts hold none. The first class
    # rules out Latin text with one comparison per character.
    some = not_ascii(text) & text.rlike(f"[\\u200b-\\ufeff](?<=[{ZERO_WIDTH}])")
    return F.when(some, F.translate(text, ZERO_WIDTH, "")).otherwise(text)


def nfkc(text: Column) -> Column:
    """Compatibility form of a text, the one step Spark has no function for."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    # Only the texts that could change are sent to Python: the others go as nulls.
    unstable = not_ascii(text) & text.rlike(f"[^\\x00-\\x7f](?<![{NFKC_STABLE}])")
    return F.coalesce(compose(F.when(unstable, text)), text)


def any_rule(text: Column, rules=RULES) -> Column:
    return reduce(Column.__or__, [rule.hits(text) for rule in rules])


def decoded_blobs(text: Column) -> Column:
    """Texts hidden in base64 blobs, lower-cased; what is not strictly valid is left out."""
    found = F.regexp_extract_all(text, F.lit(ENCODED_BLOB), F.lit(0))
    # The guard reads each character once; most texts need no more.
    blobs = F.when(text.rlike(NO_BLOB), F.array().cast("array<string>")).otherwise(found)
    whole = F.filter(blobs, lambda b: F.length(b) % 4 == 0)
    texts = F.transform(whole, lambda b: F.try_to_binary(b, F.lit("base64")).cast("string"))
    return F.transform(
        F.filter(texts, lambda t: F.coalesce(F.is_valid_utf8(t), F.lit(False))), F.lower
    )
