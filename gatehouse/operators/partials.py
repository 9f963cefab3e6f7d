"""Key figures from partial sums that can be merged, so that a growing log is not read again.

A partial row holds sums, counts and a sketch of the sessions of one bucket (a day, an hour). Rows
of one bucket add up, and sketches are merged, in any order. `refresh` keeps one row per day of a log and
reads only the days that have grown.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.operators.reports import timed_allow
from gatehouse.settings import DEFAULT, Settings

#: Size of a sketch: 2**14 registers, at most 16 KB. The relative error of a count is 1.04 / sqrt(2**14), 0.8 %;
#: up to about 1,500 sessions it counts them one by one.
SKETCH_BITS = 14

DECISIONS = {
    "actions_allowed": "allow",
    "actions_denied": "deny",
    "injections_blocked": "firewall",
    "egress_sanitized": "egress",
    "errors": "error",
}
SUMS = ("events", *DECISIONS, "pii_redacted", "latency_sum", "timed")
PARTIALS = T.StructType(
    [*(T.StructField(n, T.LongType()) for n in SUMS), T.StructField("sketch", T.BinaryType()), T.StructField("event_date", T.DateType())]
)


def partial_figures(log: DataFrame, *by: Column | str) -> DataFrame:
    """One row of mergeable figures per group."""
    return log.groupBy(*by).agg(
        F.count("*").alias("events"),
        *(F.count(F.when(F.col("decision") == d, 1)).alias(n) for n, d in DECISIONS.items()),
        F.coalesce(F.sum("pii_redacted"), F.lit(0)).cast("long").alias("pii_redacted"),
        F.coalesce(F.sum(F.when(timed_allow(), F.col("latency_ms"))), F.lit(0)).cast("long").alias("latency_sum"),
        F.count(F.when(timed_allow(), 1)).alias("timed"),
        F.hll_sketch_agg("session_id", SKETCH_BITS).alias("sketch"),
    )


def merged(partials: DataFrame, *by: Column | str) -> DataFrame:
    """Partial rows of the same group as one."""
    return partials.groupBy(*by).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in SUMS), F.hll_union_agg("sketch").alias("sketch"))


def figures(partials: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The row of `reports.kpi_metrics`; the number of sessions is an estimate (see SKETCH_BITS)."""
    one = merged(partials)
    # bround on doubles is half-even, as the exact report has it.
    mean = F.when(F.col("timed") > 0, F.col("latency_sum") / F.col("timed")).otherwise(0.0)
    minutes = F.bround(F.col("actions_allowed") * settings.seconds_saved_per_action / 60, 1)
    return one.select(
        "events",
        *DECISIONS,
        "pii_redacted",
        F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("sessions"),
        F.bround(mean).cast("bigint").alias("avg_latency_ms"),
        (F.col("actions_denied") + F.col("injections_blocked")).alias("total_blocked"),
        minutes.alias("minutes_saved"),
    )


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PARTIALS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PARTIALS)


def grown_days(log: DataFrame, partials: DataFrame) -> list:
    """Days of the log with another number of rows than their partial row says.

    Counting rows per day reads no column, only the row counts in the files.
    """
    now = log.groupBy("event_date").agg(F.count("*").alias("now"))
    known = partials.groupBy(F.col("event_date").alias("_day")).agg(F.sum("events").alias("events"))
    changed = now.join(known, F.col("event_date").eqNullSafe(F.col("_day")), "left").filter(~F.col("now").eqNullSafe(F.col("events")))
    # One value per day.
    return sorted((r[0] for r in changed.select("event_date").collect()), key=str)


def stale(log: DataFrame, days: list) -> DataFrame:
    """The rows of some days; the filter prunes the folders of all others."""
    return log.filter(F.col("event_date").isin(*[d for d in days if d is not None]) if any(days) else F.lit(False))


def refresh(log: DataFrame, path: str) -> list:
    """Brings the partial rows at `path` up to date with an append-only log; the days it read.

    A day is replaced as a whole, so a refresh that failed is simply run again.
    """
    days = grown_days(log, read_partials(log.sparkSession, path))
    if days:
        rows = partial_figures(stale(log, days), "event_date")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    return days
