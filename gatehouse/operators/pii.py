"""Masking of personal data in a table of texts: projections only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.pii import (
    NUMBER_KINDS,
    NUMBER_START,
    PII_PATTERNS,
    WITHIN_SPACES,
    marker,
    may_match,
)
from gatehouse.functions.text import fill, listed
from gatehouse.settings import DEFAULT, Settings


def replace_counted(
    rows: DataFrame, column: str, pattern: str, mark: str, count: str, likely: Column | None
) -> DataFrame:
    """Replaces the matches in `column` by `mark` and puts their number into `count`.

    Texts for which `likely` is false are known to hold no match.
    """
    before = F.col(column)

    def replaced(text: Column) -> Column:
        return F.regexp_replace(text, F.lit(pattern), F.lit(mark))

    def counted(text: Column) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    after, found = replaced(before), counted(before)
    if pattern in WITHIN_SPACES:
        parts = F.split(before, " ")

        def holds(part: Column) -> Column:
            return F.contains(part, F.lit(WITHIN_SPACES[pattern]))

        after = F.array_join(F.transform(parts, lambda p: F.when(holds(p), replaced(p)).otherwise(p)), " ")
        found = F.aggregate(F.filter(parts, holds), F.lit(0), lambda n, p: n + counted(p))
    if likely is not None:
        after = F.when(likely, after).otherwise(before)
    # Only texts that changed are searched a second time, for the count.
    number = F.when(F.col("_after") == before, 0).otherwise(found)
    return (
        rows.withColumn("_after", after)
        .withColumns({count: number, column: F.col("_after")})
        .drop("_after")
    )


def redact_pii(
    docs: DataFrame,
    text: str = "text",
    patterns=PII_PATTERNS,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Masks `text`; adds `n_<kind>`, `counts`, `total` and `summary`.

    Each pattern works on what the one before has left.
    """
    kinds = [kind for kind, _ in patterns]
    rows = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    if set(kinds) & set(NUMBER_KINDS):
        rows = rows.withColumn("_number", F.col(text).rlike(NUMBER_START))
    for kind, pattern in patterns:
        likely = may_match(kind, F.col(text), F.col("_number"))
        rows = replace_counted(rows, text, pattern, marker(kind), f"n_{kind}", likely)
    return (
        rows.drop("_number")
        .withColumns(
            {
                "counts": _counts(kinds),
                "total": reduce(add, [F.col(f"n_{kind}") for kind in kinds]),
            }
        )
        .withColumn("summary", _summary(kinds, settings))
    )


def _counts(kinds: list[str]) -> Column:
    pairs = [column for kind in kinds for column in (F.lit(kind), F.col(f"n_{kind}"))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def _summary(kinds: list[str], settings: Settings) -> Column:
    parts = [
        F.when(F.col(f"n_{kind}") > 0, fill(f"{{}} {kind}", F.col(f"n_{kind}")))
        for kind in kinds
    ]
    texts = settings.messages
    found = fill(texts.pii_masked, F.col("total"), listed(*parts))
    return F.when(F.col("total") == 0, F.lit(texts.no_pii)).otherwise(found)


def pii_report(redacted: DataFrame, *by: str, patterns=PII_PATTERNS) -> DataFrame:
    """Texts, texts with hits and hits per kind, by the given columns."""
    sums = [F.sum(f"n_{kind}").alias(f"n_{kind}") for kind, _ in patterns]
    return redacted.groupBy(*by).agg(
        F.count("*").alias("texts"),
        F.count(F.when(F.col("total") > 0, 1)).alias("texts_with_pii"),
        *sums,
        F.sum("total").alias("total"),
    )
