"""From a batch of events to sealed rows in the log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.operators import chain
from gatehouse.schemas import AUDIT_EVENTS
from gatehouse.session import stored
from gatehouse.sources.audit_log import (
    COLUMNS,
    append_events,
    last_id,
    read_events,
    upgrade,
    with_ids,
)


def open_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, empty if nothing has been written yet."""
    try:
        return read_events(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AUDIT_EVENTS)


ANCHORS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("head", T.StringType()),
    ]
)


def anchor_path(path: str) -> str:
    return f"{path.rstrip('/')}-anchors"


def open_anchors(spark: SparkSession, path: str) -> DataFrame:
    """The newest anchor of each segment of the log at `path`."""
    try:
        written = spark.read.schema(ANCHORS).parquet(anchor_path(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        written = spark.createDataFrame([], ANCHORS)
    return chain.newest_anchors(written)


def append_sealed(
    events: DataFrame, order: list[str], path: str, segment_rows: int = chain.SEGMENT_ROWS
) -> None:
    """Numbers a batch in the given order, seals it onto the log and appends it with its anchors.

    One writer at a time. A batch that failed half-way leaves the log as it was, because Spark
    commits the files of an append together; its anchors are written last, and until then
    `verify_log` reports its rows as unanchored. The cost does not grow with the log: the last id
    comes from the anchors, and only the unfinished segment of the log is read.
    """
    spark = events.sparkSession
    log, anchored = open_log(spark, path), open_anchors(spark, path)
    # Numbered from rows that `with_ids` has written, so the ids stay as they are when read again.
    numbered = upgrade(with_ids(events, order, last_id(anchored))).select(*COLUMNS)
    batch = stored(chain.seal(numbered, log, segment_rows).select(*COLUMNS), "sealed")
    append_events(batch, path)
    grown = chain.segment_anchors(batch, segment_rows)
    before = anchored.select("block", F.col("rows").alias("_rows"), F.col("first_id").alias("_first"))
    grown.join(before, "block", "left").select(
        "block",
        (F.col("rows") + F.coalesce("_rows", F.lit(0))).alias("rows"),
        F.coalesce("_first", "first_id").alias("first_id"),
        "last_id",
        "head",
    ).write.mode("append").parquet(anchor_path(path))


def verify(spark: SparkSession, path: str, segment_rows: int = chain.SEGMENT_ROWS) -> DataFrame:
    """`chain.verify_log` for the log at `path` and its anchors."""
    return chain.verify_log(open_log(spark, path), open_anchors(spark, path), segment_rows)
