"""Streams of audit events: sealing and key figures over time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatehouse.functions.event_hash import GENESIS, payload
from gatehouse.operators.chain import SEGMENT_ROWS
from gatehouse.operators.partials import PARTIALS, merged, partial_figures
from gatehouse.operators.reports import timed_allow

STATE = "last_hash string, last_id bigint"
BUCKETS = T.StructType(
    [
        T.StructField("bucket", T.TimestampType()),
        *(f for f in PARTIALS.fields if f.name != "event_date"),
        T.StructField("late", T.LongType()),
        T.StructField("newest", T.TimestampType()),
        T.StructField("batch", T.LongType()),
    ]
)


def sealer(genesis: str):
    """The state handler. Nested, so that it travels to the workers by itself."""

    def seal(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        from hashlib import sha256

        head, last = state.get if state.exists else (genesis, None)
        rows = pd.concat(list(batches)).sort_values("id", kind="stable")
        previous, hashes, late = [], [], []
        for place, rest in zip(rows["id"], rows["payload"]):
            late.append(last is not None and place <= last)
            if late[-1]:
                previous.append(None)
                hashes.append(None)
                continue
            previous.append(head)
            head = sha256(f"{head}|{rest}".encode()).hexdigest()
            hashes.append(head)
            last = place
        state.update((head, int(last)))
        yield rows.drop(columns=["payload", "_chain"]).assign(prev_hash=previous, hash=hashes, late=late)

    return seal


def seal_stream(
    events: DataFrame, segment_rows: int = SEGMENT_ROWS, chain: str | None = None
) -> DataFrame:
    """Adds `prev_hash`, `hash` and `late` to a stream of events.

    Without `chain` the result is that of the batch job: one chain per `segment_rows` ids, so
    that no group is larger, whatever one batch holds. With `chain`, a column, there is one
    unbroken chain per value of it, continued from batch to batch; a constant gives the one
    chain over the whole log. Such a chain is sealed in sequence, a batch at a time: bound the
    batches with `files_per_trigger`.

    Ids of a chain must arrive in order over batches; a late event stays unsealed and is marked.
    """
    fields = [f for f in events.schema.fields if f.name not in ("prev_hash", "hash")]
    added = [
        T.StructField("prev_hash", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("late", T.BooleanType()),
    ]
    key = F.col(chain) if chain else F.expr(f"id div {segment_rows}")
    rows = events.select(*[f.name for f in fields])
    rows = rows.withColumns({"payload": payload(), "_chain": key})
    return rows.groupBy("_chain").applyInPandasWithState(
        sealer(GENESIS),
        T.StructType(fields + added),
        STATE,
        "append",
        GroupStateTimeout.NoTimeout,
    )


def kpi_stream(log: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Key figures per time bucket; a bucket is final once the watermark has passed it."""

    def n(decision: str):
        return F.count(F.when(F.col("decision") == decision, 1))

    return (
        log.withWatermark("event_ts", delay)
        .groupBy(F.window("event_ts", width))
        .agg(
            F.count("*").alias("events"),
            n("allow").alias("allowed"),
            n("deny").alias("denied"),
            n("firewall").alias("firewall"),
            n("egress").alias("egress"),
            n("error").alias("errors"),
            F.sum("pii_redacted").alias("pii_redacted"),
            F.sum(F.when(timed_allow(), F.col("latency_ms"))).alias("latency_sum"),
            F.count(F.when(timed_allow(), 1)).alias("timed"),
        )
        .select(F.col("window.start").alias("bucket"), "*")
        .drop("window")
    )


def bucket_commit(path: str, width: str, delay: str):
    """What is done with each batch of `write_buckets`."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        seen = read_buckets(spark, path).filter(F.col("batch") < batch).agg(F.max("newest")).first()[0]
        behind = F.col("event_ts") < F.lit(seen) - F.expr(f"INTERVAL {delay}") if seen else F.lit(False)
        bucketed = rows.withColumns({"bucket": F.window("event_ts", width)["start"], "behind": behind})
        sums = partial_figures(bucketed, "bucket").join(
            bucketed.groupBy(F.col("bucket").alias("_bucket")).agg(
                F.count_if("behind").alias("late"), F.max("event_ts").alias("newest")
            ),
            F.col("bucket").eqNullSafe(F.col("_bucket")),
        )
        sums.drop("_bucket").select(*BUCKETS.names[:-1]).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return write


def write_buckets(
    log: DataFrame, path: str, checkpoint: str, width: str = "1 hour", delay: str = "1 hour", available_now: bool = False
) -> StreamingQuery:
    """Key figures per time bucket, of every event of the stream, however late.

    Each batch adds partial sums, a row per bucket that it touches, in a folder of its own; a batch that is
    run again replaces it. `late` counts the events that came when an event newer by `delay` had been seen in a
    batch before. Nothing is held as state, and no bucket has to close.
    """
    writer = log.writeStream.foreachBatch(bucket_commit(path, width, delay)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The partial rows as they were written."""
    try:
        return spark.read.schema(BUCKETS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BUCKETS)


def bucket_figures(spark: SparkSession, path: str) -> DataFrame:
    """All buckets so far, open ones too, with the sums of `merged` and `late`."""
    rows = read_buckets(spark, path)
    late = rows.groupBy(F.col("bucket").alias("_bucket")).agg(F.sum("late").alias("late"))
    return merged(rows, "bucket").join(late, F.col("bucket").eqNullSafe(F.col("_bucket"))).drop("_bucket")
