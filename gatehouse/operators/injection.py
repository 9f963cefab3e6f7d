"""Prompt-injection scan of a table of texts: projections only, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions import injection as I
from gatehouse.functions.text import fill
from gatehouse.settings import DEFAULT, Settings


def scan_injection(
    docs: DataFrame, text: str = "text", rules=I.RULES, settings: Settings = DEFAULT
) -> DataFrame:
    """Adds `safe`, `score`, `matches` and `reason`."""
    source = F.coalesce(F.col(text), F.lit(""))
    # One stage per costly value, so that each is computed once per row.
    plain = F.col("_plain")
    hidden = F.when(plain == source, 0).otherwise(F.length(source) - F.length(plain))
    staged = (
        docs.withColumn("_plain", I.strip_hidden(source)).withColumns(
            {
                "_low": F.lower(I.nfkc(plain)),
                "_hidden": hidden,
                "_decoded": I.decoded_blobs(source),
            }
        )
    )
    signals = [(rule.name, rule.hits(F.col("_low")), rule.weight) for rule in rules]
    signals += [
        (I.HIDDEN_TEXT, F.col("_hidden") >= settings.hidden_min, settings.hidden_weight),
        (
            I.ENCODED_PAYLOAD,
            F.exists("_decoded", lambda t: I.any_rule(t, rules)),
            settings.encoded_weight,
        ),
    ]
    found = F.array(*[F.when(hit, F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")))
                      for n, hit, w in signals])
    return (
        staged.withColumn("_found", F.array_compact(found))
        .withColumn("matches", F.col("_found.name"))
        .withColumn(
            "score", F.aggregate("_found.weight", F.lit(0), lambda total, w: total + w)
        )
        .withColumn("safe", F.col("score") < settings.block_threshold)
        .withColumn("reason", _reason(settings))
        .drop("_plain", "_hidden", "_low", "_decoded", "_found")
    )


def _reason(settings: Settings) -> Column:
    texts = settings.messages
    unsafe = fill(texts.injection, F.col("score"), F.array_join("matches", ", "))
    return F.when(F.col("safe"), F.lit(texts.ok)).otherwise(unsafe)


def neutralize(
    docs: DataFrame, text: str = "text", rules=I.RULES, settings: Settings = DEFAULT
) -> DataFrame:
    """The scan, with unsafe texts replaced by a notice."""
    shown = F.when(F.col("safe"), F.col(text)).otherwise(F.lit(settings.messages.withheld))
    return scan_injection(docs, text, rules, settings).withColumn(text, shown)


def rule_hits(scanned: DataFrame, *by: str) -> DataFrame:
    """How many texts each rule fired on, by the given columns."""
    # Few distinct groups, and partial sums before the shuffle: a hot source is no issue.
    # The outer form, because Spark would copy the whole scan into a filter on the inner one.
    return (
        scanned.select(*by, F.explode_outer("matches").alias("rule"))
        .filter(F.col("rule").isNotNull())
        .groupBy("rule", *by)
        .agg(F.count("*").alias("hits"))
    )
