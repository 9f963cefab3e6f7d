"""A stream of sealed events into a log, batch by batch, with the anchors of the chains.

Every batch has a folder for its rows and one for its anchors, named by the batch. A batch that failed
half-way is written anew over what it left, so each row is in the log once, whatever was killed when.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from gatehouse.operators import key_chain
from gatehouse.streaming.files import NO_EMPTY_BATCHES, ROCKSDB, settings
from gatehouse.streaming.govern import EVENTS

ANCHORS = T.StructType(
    [
        T.StructField("chain", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("head", T.StringType()),
    ]
)


def _folder(path: str, kind: str, batch: int | None = None) -> str:
    return f"{path.rstrip('/')}/{kind}" + ("" if batch is None else f"/batch={batch}")


def commit(path: str):
    """What is done with each batch: its rows, then its anchors."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(_folder(path, "events", batch))
        # Read back, so that the stateful job runs once.
        written = spark.read.schema(EVENTS).parquet(_folder(path, "events", batch))
        grown = written.groupBy("chain").agg(
            (F.max("place") + 1).alias("rows"), F.lit(0).cast("long").alias("first_id"), F.max("place").alias("last_id"), F.max_by("hash", "place").alias("head")
        )
        grown.write.mode("overwrite").parquet(_folder(path, "anchors", batch))

    return write


def write_log(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes the events of `govern_stream` and their anchors below `path`."""
    writer = rows.writeStream.foreachBatch(commit(path)).option("checkpointLocation", checkpoint).outputMode("append")
    with settings(rows.sparkSession, ROCKSDB | (NO_EMPTY_BATCHES if available_now else {})):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(_folder(path, "events"))


def newest_anchors(spark: SparkSession, path: str) -> DataFrame:
    """One anchor per chain: the last one written. A chain only grows."""
    written = spark.read.schema(ANCHORS).parquet(_folder(path, "anchors"))
    newest = F.max_by(F.struct("rows", "first_id", "last_id", "head"), "last_id")
    return written.groupBy("chain").agg(newest.alias("a")).select("chain", "a.*")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """One row as of `key_chain.verify_keys`: edited, lost and unanchored rows of the log at `path`.

    Places take the part of ids, so `first_bad_id` is the first bad place within its chain.
    """
    return key_chain.verify_keys(read_log(spark, path), newest_anchors(spark, path), "chain", "place")
