"""Scan rules as a table, so that they can be changed without touching code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.functions.injection import Rule

SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("words", T.ArrayType(T.StringType())),
    ]
)
#: Rules become part of the plan of a scan.
MOST_RULES = 1_000


def rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """One line per rule; `position` gives the order of reports."""
    rows = [(k, r.name, r.pattern, r.weight, list(r.words)) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, SCHEMA)


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rules from JSON lines, ready for `scan_injection(rules=...)`."""
    return rules_of(spark.read.schema(SCHEMA).json(path))


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table. Incomplete lines, names that repeat and patterns that do not compile are errors."""
    rows = table.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = sorted(rows, key=lambda r: (r["position"] is None, r["position"]))
    names = [r["name"] for r in found]
    if any(None in (r["position"], r["name"], r["pattern"], r["weight"]) for r in found):
        raise ValueError("every rule needs position, name, pattern and weight")
    if len(set(names)) < len(names):
        raise ValueError("names of rules must differ")
    # Spark compiles each pattern here, not in the middle of a scan.
    table.select(F.regexp_like(F.lit(""), F.col("pattern"))).collect()
    return tuple(Rule(r["name"], r["pattern"], r["weight"], tuple(r["words"] or ())) for r in found)
