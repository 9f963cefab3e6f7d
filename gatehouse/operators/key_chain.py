"""Chains of any length: one per key (a session, say), or one over a whole log.

A sha256 chain can only be written in sequence, but many of them at once, and long ones piece by
piece. Rows are laid out in ranges of (key, order), sorted, one task a range. A task folds its range in one
pass over Arrow batches: it holds the head of a chain, never its rows. Only for the first key of a
range it cannot know the head, if that key began in the range before; the rows of this key wait. Then
rounds follow: each seals the waiting rows of all ranges whose head is known by now. Keys within a
range need one round, a key over k ranges k of them, each over that one range; so no task ever sees
more than a range, whatever a key holds, and a lost executor costs a range.

The heads of all chains are chained in turn (`anchor_heads`), so that a cut tail or a lost chain is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.functions.event_hash import GENESIS, event_hash, payload
from gatehouse.operators.chain import with_previous
from gatehouse.operators.joins import same_keys
from gatehouse.session import shared_folder

#: Ranges whose rows are sealed.
SEALED = -1
ADDED = [T.StructField(n, T.StringType()) for n in ("prev_hash", "hash")]
PLACED = [T.StructField(n, T.IntegerType()) for n in ("_range", "_waits")]
#: Digits of the hash of a key that name its anchor chain: 256 of them.
ANCHOR_DIGITS = 2


def folds():
    """The two folds over the sorted rows of a task. Nested, so that they travel to the workers by themselves.

    Each row brings `_start`, the head that its chain had before this job, and `_payload`.
    """

    def linked(batches: Iterator[pa.RecordBatch], mark: str, head_at, drop: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        current, head = object(), None
        for batch in batches:
            previous, hashes, waits = [], [], []
            for own, start, text in zip(*(batch.column(n).to_pylist() for n in (mark, "_start", "_payload"))):
                if own != current:
                    head = head_at(own, start)
                    current = own
                previous.append(head)
                waits.append(head is None)
                if head is not None:
                    head = sha256(f"{head}|{text}".encode()).hexdigest()
                hashes.append(head)
            kept = [n for n in batch.schema.names if n not in drop]
            found = {n: batch.column(n) for n in kept}
            found |= {"prev_hash": pa.array(previous, pa.string()), "hash": pa.array(hashes, pa.string())}
            yield found, waits

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Seals all keys of a range but the first, whose rows get the number of the range in `_waits`."""
        from pyspark import TaskContext

        number, begun = TaskContext.get().partitionId(), False

        def head_at(key, start):
            nonlocal begun
            head, begun = start if begun else None, True
            return head

        for found, waits in linked(batches, "_key", head_at, ()):
            found["_range"] = pa.array([number] * len(waits), pa.int32())
            found["_waits"] = pa.array([number if w else -1 for w in waits], pa.int32())
            # Only rows that wait are hashed again.
            for name in ("_start", "_payload"):
                found[name] = pc.if_else(pa.array(waits, pa.bool_()), found[name], None)
            yield pa.record_batch(found)

    def later(heads: dict[int, str | None]):
        """Seals the waiting rows of ranges, from the head of each; without one, from that of the row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop = ("_key", "_start", "_payload", "_waits")
            for found, _ in linked(batches, "_range", lambda number, start: heads[number] or start, drop):
                yield pa.record_batch(found)

        return run

    return first, later


def seal_chains(
    events: DataFrame,
    key: str | None,
    order: str = "id",
    rest: Column | None = None,
    heads: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Adds `prev_hash` and `hash`: one unbroken chain per value of `key`, in the order of `order`.

    Without `key` there is one chain over all rows. Rows with a null key form a chain of their own.
    `order` must be unique within a key. `rest` is the text that is hashed after the previous hash, that of an audit event
    if not given. `heads` (key, head) continues chains that a log already holds. `ranges` sets the
    number of ranges; otherwise Spark cuts them by their size.

    Results are written to the shared folder. Of each range only its first and last key and its head
    reach the driver.
    """
    spark = events.sparkSession
    fields = [f for f in events.schema.fields if f.name not in ("prev_hash", "hash")]
    names = [f.name for f in fields]
    rows = events.select(
        *names,
        (F.col(key).cast("string") if key else F.lit("")).alias("_key"),
        F.lit(GENESIS).alias("_start"),
        (payload() if rest is None else rest).alias("_payload"),
    )
    if heads is not None:
        rows = _continued(rows, heads, key)
    place = ["_key", order]
    ranged = rows.repartitionByRange(ranges, *place) if ranges else rows.repartitionByRange(*place)
    extra = [T.StructField(n, T.StringType()) for n in ("_key", "_start", "_payload")]
    full = T.StructType([*fields, *extra, *ADDED, *PLACED])
    path = shared_folder(spark, "chains")
    # The rows of a range that wait lie in a folder of their own.
    first, _ = folds()
    ranged.sortWithinPartitions(*place).mapInArrow(first, full).write.partitionBy("_waits").parquet(f"{path}/first")
    written = spark.read.schema(full).parquet(f"{path}/first")
    paths = _rounds(written, T.StructType([*fields, *ADDED, PLACED[0]]), order, f"{path}/rounds")
    sealed = written.filter(F.col("_waits") == SEALED).select(*names, "prev_hash", "hash")
    for later in paths:
        sealed = sealed.unionByName(spark.read.schema(T.StructType([*fields, *ADDED])).parquet(later))
    return sealed


def _continued(rows: DataFrame, heads: DataFrame, key: str | None) -> DataFrame:
    """Rows whose chain starts at the head that the log has for their key."""
    known = heads.select((F.col(key).cast("string") if key else F.lit("")).alias("_known"), F.col("head").alias("_head"))
    joined = rows.join(known, same_keys(rows, known, {"_key": "_known"}), "left")
    return joined.withColumn("_start", F.coalesce("_head", "_start")).drop("_known", "_head")


def _rounds(written: DataFrame, kind: T.StructType, order: str, path: str) -> list[str]:
    """Seals the waiting rows, round by round; the folders with the results."""
    spark = written.sparkSession
    edge = F.struct("_key", order, "hash")
    edges = (
        written.groupBy("_range")
        .agg(F.min(F.struct("_key", order)).alias("first"), F.max(edge).alias("last"))
        .select("_range", F.col("first._key").alias("first"), F.col("last._key").alias("last"), F.col("last.hash").alias("head"))
    )
    # One row per range.
    found = sorted(edges.collect(), key=lambda r: r["_range"])
    heads, waits, (_, later) = {}, {}, folds()
    for before, own in zip([None, *found], found):
        # A range whose first key did not begin in the one before starts that chain itself.
        waits[own["_range"]] = before["_range"] if before is not None and before["last"] == own["first"] else None
        if own["first"] != own["last"]:
            heads[own["_range"]] = own["head"]
    paths = []
    while waits:
        ready = {r: None if before is None else heads[before] for r, before in waits.items() if before is None or before in heads}
        rows = written.filter(F.col("_waits").isin(*ready)).repartition(len(ready), "_range").sortWithinPartitions("_range", order)
        paths.append(f"{path}/{len(paths)}")
        rows.mapInArrow(later(ready), kind).write.parquet(paths[-1])
        sealed = spark.read.schema(kind).parquet(paths[-1])
        ends = sealed.groupBy("_range").agg(F.max_by("hash", order).alias("head")).collect()
        for end in ends:
            # The head of a range with several keys belongs to the last of them, not to this one.
            heads.setdefault(end["_range"], end["head"])
        waits = {r: before for r, before in waits.items() if r not in ready}
    return paths


def packed(digest: Column) -> Column:
    """A hash of 64 hex digits as 32 bytes, any other text as more than these: different texts stay different."""
    other = F.concat(digest.cast("binary"), F.lit(bytes(33)))
    return F.when(digest.rlike("\\A[0-9a-f]{64}\\z"), F.unhex(digest)).otherwise(other)


def with_key_check(log: DataFrame, key: str, order: str = "id") -> DataFrame:
    """`key`, `id` and whether a sealed row is `bad`: its hash, or its link to the row before it in its chain.

    `order` is the whole number that orders a chain; it stands as `id` in the result.
    """
    # The hash is checked before anything moves; the two that are shuffled go as bytes, at half their length.
    own = log.filter(F.col("hash").isNotNull()).select(
        key,
        F.col(order).alias("id"),
        packed(F.col("prev_hash")).alias("prev_hash"),
        packed(F.col("hash")).alias("hash"),
        F.col("hash").eqNullSafe(event_hash(F.col("prev_hash"), payload())).alias("intact"),
    )
    linked = with_previous(own, "id", "hash", within=key)
    before = F.coalesce("previous", packed(F.lit(GENESIS)))
    return linked.select(key, "id", (~F.col("intact") | ~F.col("prev_hash").eqNullSafe(before)).alias("bad"))


def key_heads(log: DataFrame, key: str, order: str = "id") -> DataFrame:
    """(key, rows, first_id, last_id, head) of each chain."""
    return log.filter(F.col("hash").isNotNull()).groupBy(key).agg(
        F.count("*").alias("rows"), F.min(order).alias("first_id"), F.max(order).alias("last_id"), F.max_by("hash", order).alias("head")
    )


def anchor_heads(heads: DataFrame, key: str) -> DataFrame:
    """The heads, chained: `anchor_chain` (by the hash of the key), `prev_hash` and `hash` of each.

    An anchor chain runs over its keys in ascending order.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    # A null key comes before the empty one.
    number = F.concat(F.when(F.col(key).isNull(), "0").otherwise("1"), name)
    chained = heads.withColumns({"anchor_chain": F.substring(F.sha2(name.cast("binary"), 256), 1, ANCHOR_DIGITS), "_place": number})
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in (key, "rows", "first_id", "last_id", "head")]
    return seal_chains(chained, "anchor_chain", "_place", rest=F.concat_ws("|", *fields)).drop("_place")


def key_findings(log: DataFrame, anchored: DataFrame, key: str, order: str = "id") -> DataFrame:
    """(key, id, kind) of all damage to a log that is sealed per key, held against its anchors.

    kind is `edited` for a row whose hash or link is wrong (so for the row after a lost one, too), `missing` for
    the last id of a chain that has lost its end, or the first one of a chain that is gone, `unanchored` for
    rows beyond the anchor (the first of them), and `anchor` for an anchor that was itself changed, if the
    anchors are chained.
    """
    rows = with_key_check(log, key, order).filter("bad").select(key, "id", F.lit("edited").alias("kind"))
    now = key_heads(log, key, order).select(F.col(key).alias("_key"), F.lit(True).alias("here"), *(F.col(c).alias(f"_{c}") for c in ("first_id", "last_id", "head")))
    both = anchored.join(now, same_keys(anchored, now, {key: "_key"}), "full")
    short = F.col("here").isNotNull() & (F.col("_last_id") < F.col("last_id"))
    longer = F.col("here").isNotNull() & (F.col("last_id").isNull() | (F.col("_last_id") > F.col("last_id")))
    changed = (F.col("_last_id") == F.col("last_id")) & (F.col("_head") != F.col("head"))
    kind = (
        F.when(F.col("here").isNull(), F.struct(F.col("first_id").alias("id"), F.lit("missing").alias("kind")))
        .when(short, F.struct(F.col("last_id").alias("id"), F.lit("missing").alias("kind")))
        .when(longer, F.struct(F.coalesce(F.col("last_id") + 1, F.col("_first_id")).alias("id"), F.lit("unanchored").alias("kind")))
        .when(changed, F.struct(F.col("last_id").alias("id"), F.lit("edited").alias("kind")))
    )
    of_chains = both.select(F.when(F.col("here").isNull(), F.col(key)).otherwise(F.col("_key")).alias(key), kind.alias("f")).filter("f IS NOT NULL").select(key, "f.*")
    found = rows.unionByName(of_chains)
    if "hash" not in anchored.columns:
        return found.distinct()
    again = anchor_heads(anchored.select(key, "rows", "first_id", "last_id", "head"), key)
    theirs = anchored.select(F.col(key).alias("_key"), F.col("hash").alias("_hash"))
    broken = again.join(theirs, same_keys(again, theirs, {key: "_key"})).filter(~F.col("hash").eqNullSafe(F.col("_hash")))
    of_anchors = broken.select(key, F.col("first_id").alias("id"), F.lit("anchor").alias("kind"))
    return found.unionByName(of_anchors).distinct()


def verify_keys(log: DataFrame, anchored: DataFrame, key: str, order: str = "id") -> DataFrame:
    """One row: `ok`, `checked` (sealed rows), and how many findings of each kind there are."""
    kinds = ("edited", "missing", "unanchored", "anchor")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    found = key_findings(log, anchored, key, order).agg(F.min("id").alias("first_bad_id"), *counts)
    checked = log.filter(F.col("hash").isNotNull()).agg(F.count("*").alias("checked"))
    # One row each.
    return checked.join(F.broadcast(found), F.lit(True)).select(F.col("first_bad_id").isNull().alias("ok"), "checked", "first_bad_id", *kinds)
