"""The audit log as an append-only Parquet table, partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.schemas import AUDIT_EVENTS
from gatehouse.session import stored

COLUMNS = [field.name for field in AUDIT_EVENTS.fields]
SHOWN = ["ts", "agent", "tool", "decision", "reason", "latency_ms", "session_id", "pii_redacted"]


def upgrade(log: DataFrame) -> DataFrame:
    """Brings rows written before sessions, masking counts or hashes existed to the schema."""
    empty = log.sparkSession.createDataFrame([], AUDIT_EVENTS)
    full = empty.unionByName(log, allowMissingColumns=True)
    return full.withColumn("pii_redacted", F.coalesce("pii_redacted", F.lit(0)))


def with_ids(events: DataFrame, order: list[str], after: int = -1) -> DataFrame:
    """Adds consecutive ids beyond `after` in the given order.

    The rows are sorted by range and written out, so no task sees them all and the numbers do not
    change when a task is run again. Only the row count of each range reaches the driver.
    """
    place = F.monotonically_increasing_id()
    ranged = events.orderBy(*order).withColumns(
        {"_range": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}
    )
    rows = stored(ranged, "ranged")
    counts = sorted(tuple(r) for r in rows.groupBy("_range").count().collect())
    starts, start = [], after + 1
    for number, count in counts:
        starts.append((number, start))
        start += count
    offsets = rows.sparkSession.createDataFrame(starts, "_range long, _start long")
    # One row per range of the sort.
    numbered = rows.join(F.broadcast(offsets), "_range")
    return numbered.withColumn("id", F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def last_id(log: DataFrame) -> int:
    """The highest id, -1 in an empty log. Anchors (`last_id`) tell the same with less to read."""
    column = "last_id" if "last_id" in log.columns else "id"
    newest = log.agg(F.max(column)).first()[0]
    return -1 if newest is None else newest


def append_events(events: DataFrame, path: str) -> None:
    """Appends a batch; missing columns get their defaults.

    Rows are laid out by day and id: a task writes to few days, a busy day is split over many
    tasks, and each file covers a short range of ids, so that readers can skip most files.
    """
    day = F.coalesce(F.to_date(F.try_to_timestamp("ts")), F.lit("1970-01-01").cast("date"))
    (
        upgrade(events)
        .withColumn("event_date", day)
        .repartitionByRange("event_date", "id")
        .sortWithinPartitions("event_date", "id")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The log, old files included. Filters on `event_date` skip whole days."""
    schema = T.StructType([*AUDIT_EVENTS.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(path).withColumn(
        "pii_redacted", F.coalesce("pii_redacted", F.lit(0))
    )


def newest_first(log: DataFrame) -> DataFrame:
    return log.select("id", *SHOWN).orderBy(F.desc("id"))


def events_since(log: DataFrame, before: int) -> DataFrame:
    """Events after a known id, in order. The filter reaches the Parquet scan."""
    return log.filter(F.col("id") > before).orderBy("id")


def count_events(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("events"))


def append_if_empty(log: DataFrame, events: DataFrame, path: str) -> bool:
    """Loads the events only into an empty log; tells whether it did."""
    if not log.isEmpty():
        return False
    append_events(events, path)
    return True


def export_csv(log: DataFrame, path: str) -> None:
    """CSV files with a header, written in parallel."""
    log.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
