"""Sealing and verification of the audit log.

A sealed event carries sha256(previous hash | its fields), so an edit or a deletion breaks the
chain from there on. Such a chain can only be written in sequence. The batch job therefore
starts a new chain every `segment_rows` ids, so that segments are sealed in parallel and no task
ever holds more than one segment; a log shorter than a segment is one plain chain. The heads of
the segments are chained in turn by `anchors`, level by level up to one root, which binds the
segments together. Every append writes the anchors of its segments, and `verify_log` holds the log
against them, so that a lost row is found wherever it stood: inside a segment, at its border, in a
cut-off tail or in a segment that is gone as a whole. `streaming.audit.seal_stream` can also write one unbroken chain, batch after
batch.

Verification is parallel for both layouts: the costly hash needs only its own row, and the
comparison with the row before runs within bounded blocks of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.functions.event_hash import GENESIS, event_hash, payload

SEGMENT_ROWS = 1024
FAN = 1024
#: Rows whose hashes are gathered in one array: the root of the two above.
PIECE_ROWS = 32
BLOCK_ROWS = 100_000
# 2**63 ids make at most 9,224 blocks after three divisions by BLOCK_ROWS.
LEVELS = 3


def hash_events(log: DataFrame) -> DataFrame:
    """Adds `expected_hash`, the hash of each event given the `prev_hash` it stores."""
    return log.withColumn("expected_hash", event_hash(F.col("prev_hash"), payload()))


def last_hash(log: DataFrame) -> DataFrame:
    """One row: the newest hash, or the start value of a chain if there is none."""
    newest = F.max_by("hash", "id")
    return log.filter(F.col("hash").isNotNull()).agg(
        F.coalesce(newest, F.lit(GENESIS)).alias("last_hash")
    )


def running_hashes(rows: Column, start: Column) -> Column:
    """`start` and then the hash after each of the rows.

    An array is copied whenever a hash is added to it. So the hashes grow in pieces, each of which begins with
    the last hash of the one before, and what is copied per row stays at two short arrays.
    """

    def last(hashes: Column) -> Column:
        return F.element_at(hashes, F.lit(-1))

    def sealed(piece: Column, head: Column) -> Column:
        return F.aggregate(
            piece,
            F.array(head),
            lambda done, row: F.array_append(done, event_hash(last(done), row["payload"])),
        )

    count = F.size(rows)
    begins = F.when(count > 0, F.sequence(F.lit(1), count, F.lit(PIECE_ROWS))).otherwise(F.array().cast("array<int>"))
    pieces = F.aggregate(
        begins,
        F.array(F.array(start)),
        lambda done, at: F.array_append(
            done, F.slice(sealed(F.slice(rows, at, F.lit(PIECE_ROWS)), last(last(done))), F.lit(2), F.lit(PIECE_ROWS))
        ),
    )
    return F.flatten(pieces)


def seal(
    events: DataFrame, sealed: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Adds `prev_hash` and `hash` to events with unique ids.

    With `sealed`, the log so far, a segment that it left unfinished is continued; the new
    ids must lie beyond its last one.
    """
    fields = [name for name in events.columns if name not in ("prev_hash", "hash")]
    rows = events.select(*fields).withColumn("payload", payload())
    # Ids are unique, so a group has at most `segment_rows` rows.
    segments = (
        rows.groupBy(F.expr(f"id div {segment_rows}").alias("segment"))
        .agg(F.array_sort(F.collect_list(F.struct("id", "payload", *_others(fields)))).alias("rows"))
    )
    start = F.lit(GENESIS)
    if sealed is not None:
        segments = segments.join(_open_heads(events, sealed, segment_rows), "segment", "left")
        start = F.coalesce("head", F.lit(GENESIS))
    count = F.size("rows")
    return (
        segments.withColumn("hashes", running_hashes(F.col("rows"), start))
        # The outer form: Spark would copy the whole computation into a filter on the inner one.
        .select(
            F.inline_outer(
                F.arrays_zip(
                    F.col("rows").alias("row"),
                    F.slice("hashes", F.lit(1), count).alias("prev_hash"),
                    F.slice("hashes", F.lit(2), count).alias("hash"),
                )
            )
        )
        .select(*[F.col(f"row.{name}").alias(name) for name in fields], "prev_hash", "hash")
    )


def _others(fields: list[str]) -> list[str]:
    return [name for name in fields if name != "id"]


def _open_heads(events: DataFrame, sealed: DataFrame, segment_rows: int) -> DataFrame:
    # The first new id tells from where on the old log matters; the filter reaches the scan.
    first = events.agg(F.min("id")).first()[0] or 0
    begin = first // segment_rows * segment_rows
    return (
        sealed.filter((F.col("id") >= begin) & F.col("hash").isNotNull())
        .groupBy(F.expr(f"id div {segment_rows}").alias("segment"))
        .agg(F.max_by("hash", "id").alias("head"))
    )


def with_previous(
    rows: DataFrame,
    key: str,
    value: str,
    levels: int = LEVELS,
    width: int = BLOCK_ROWS,
    within: str | None = None,
) -> DataFrame:
    """Adds `previous`: the `value` of the row with the next smaller `key`, null for the first.

    With `within`, a column, that is the row before among those with the same value of it; null
    is a value like any other.

    A window over all rows would run in one task. Here it runs within blocks of keys; the
    first row of a block takes the last value of the nearest block before it, which is the same
    question about far fewer rows.
    """
    if not within:
        return _previous(rows.withColumn("_group", F.lit(0)), key, value, levels, width, False).drop("_group")
    # Null and the empty text are told apart. The text takes the place of the column, so that rows are
    # shuffled with one of them.
    group = F.coalesce(F.concat(F.lit("="), F.col(within).cast("string")), F.lit(""))
    kind = rows.schema[within].dataType
    found = _previous(rows.withColumn("_group", group).drop(within), key, value, levels, width, True)
    own = F.when(F.col("_group") != "", F.substr("_group", F.lit(2))).cast(kind)
    return found.withColumn(within, own).select(*rows.columns, "previous")


def _previous(rows: DataFrame, key: str, value: str, levels: int, width: int, grouped: bool) -> DataFrame:
    group = ["_group"] if grouped else []
    if levels == 0:
        return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(*group).orderBy(key)))
    block = f"_block{levels}"
    blocked = rows.withColumn(block, F.expr(f"{key} div {width}"))
    inner = Window.partitionBy(*group, block).orderBy(key)
    inside = blocked.withColumn("_before", F.lag(value).over(inner))
    # The last row of each block, from sums of the tasks: a window would shuffle all rows once more.
    last = blocked.groupBy("_group", block).agg(F.max_by(value, key).alias("_last"))
    tails = _previous(last, block, "_last", levels - 1, width, grouped).select(
        *group, block, F.col("previous").alias("_tail")
    )
    return (
        inside.join(tails, [*group, block])
        .withColumn("previous", F.coalesce("_before", "_tail"))
        .drop(block, "_before", "_tail")
    )


def with_link_check(log: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Ids of the sealed rows and whether each is `bad`.

    Without `segment_rows` the log is one unbroken chain, else one chain per segment.
    """
    # The hash is checked against the stored previous hash before anything moves, so only a
    # flag and two hashes are shuffled. If the link is right, that is the same check.
    own = log.filter(F.col("hash").isNotNull()).select(
        "id",
        "prev_hash",
        "hash",
        F.col("hash").eqNullSafe(event_hash(F.col("prev_hash"), payload())).alias("intact"),
    )
    if segment_rows:
        within = Window.partitionBy(F.expr(f"id div {segment_rows}")).orderBy("id")
        linked = own.withColumn("previous", F.lag("hash").over(within))
    else:
        linked = with_previous(own, "id", "hash")
    before = F.coalesce("previous", F.lit(GENESIS))
    return linked.select(
        "id", (~F.col("intact") | ~F.col("prev_hash").eqNullSafe(before)).alias("bad")
    )


def verify_chain(log: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """One row: `ok`, `checked` (sealed rows) and `first_bad_id`."""
    return (
        with_link_check(log, segment_rows)
        .agg(F.count("*").alias("checked"), F.min(F.when(F.col("bad"), F.col("id"))).alias("bad"))
        .select(F.col("bad").isNull().alias("ok"), "checked", F.col("bad").alias("first_bad_id"))
    )


def anchors(
    log: DataFrame, segment_rows: int = SEGMENT_ROWS, fan: int = FAN
) -> DataFrame:
    """Heads of the segments (level 1), heads of blocks of heads (level 2), ... up to one root."""
    top = (log.agg(F.max("id")).first()[0] or 0) // segment_rows
    level = (
        log.filter(F.col("hash").isNotNull())
        .groupBy(F.expr(f"id div {segment_rows}").alias("block"))
        .agg(
            F.count("*").alias("rows"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
            F.max_by("hash", "id").alias("head"),
        )
        .select(F.lit(1).alias("level"), "*")
    )
    found = level
    number = 1
    while top > 0:
        top //= fan
        number += 1
        level = _next_level(level, number, fan)
        found = found.unionByName(level)
    return found


def _next_level(level: DataFrame, number: int, fan: int) -> DataFrame:
    text = F.concat_ws("|", "block", "rows", "first_id", "last_id", "head")
    return (
        level.withColumn("payload", text)
        .groupBy(F.expr(f"block div {fan}").alias("block"))
        .agg(
            F.sum("rows").alias("rows"),
            F.min("first_id").alias("first_id"),
            F.max("last_id").alias("last_id"),
            # At most `fan` heads.
            F.array_sort(F.collect_list(F.struct("block", "payload"))).alias("heads"),
        )
        .withColumn(
            "head", F.element_at(running_hashes(F.col("heads"), F.lit(GENESIS)), F.lit(-1))
        )
        .select(F.lit(number).alias("level"), "block", "rows", "first_id", "last_id", "head")
    )


def verify_anchors(
    log: DataFrame, stored: DataFrame, segment_rows: int = SEGMENT_ROWS, fan: int = FAN
) -> DataFrame:
    """Blocks whose anchor is missing, new or different; no rows if all is well.

    Unlike the chain alone, this also shows a cut-off tail.
    """
    now = anchors(log, segment_rows, fan)
    mine = now.select("level", "block", F.struct("rows", "first_id", "last_id", "head").alias("found"))
    theirs = stored.select(
        "level", "block", F.struct("rows", "first_id", "last_id", "head").alias("stored")
    )
    return mine.join(theirs, ["level", "block"], "full").filter(
        ~F.col("found").eqNullSafe(F.col("stored"))
    )


def segment_anchors(log: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The anchors of level 1 alone: what each segment holds, and its head."""
    return (
        log.filter(F.col("hash").isNotNull())
        .groupBy(F.expr(f"id div {segment_rows}").alias("block"))
        .agg(
            F.count("*").alias("rows"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
            F.max_by("hash", "id").alias("head"),
        )
    )


def newest_anchors(written: DataFrame) -> DataFrame:
    """One anchor per segment: the last one written. A segment only grows."""
    newest = F.max_by(F.struct("rows", "first_id", "last_id", "head"), "last_id")
    return written.groupBy("block").agg(newest.alias("a")).select("block", "a.*")


def findings(log: DataFrame, anchored: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(id, kind) of all damage to a log whose sealed rows have consecutive ids.

    `anchored` are the newest anchors. kind is `edited` for a row whose hash or link is wrong,
    `missing` for the first lost id of a gap, `unanchored` for a row beyond its anchor.
    """
    segment = F.expr(f"id div {segment_rows}")
    own = log.filter(F.col("hash").isNotNull()).select(
        "id",
        segment.alias("block"),
        "prev_hash",
        "hash",
        F.col("hash").eqNullSafe(event_hash(F.col("prev_hash"), payload())).alias("intact"),
    )
    # A segment has at most `segment_rows` rows.
    within = Window.partitionBy("block").orderBy("id")
    rows = (
        own.withColumns(
            {
                "before": F.lag("id").over(within),
                "previous": F.lag("hash").over(within),
                "after": F.lead("id").over(within),
            }
        )
        .join(anchored.select("block", "first_id", "last_id", "head"), "block", "left")
        .withColumn("expected", F.coalesce(F.col("before") + 1, F.col("first_id"), F.col("id")))
    )
    gap = F.col("id") > F.col("expected")
    linked = F.col("prev_hash").eqNullSafe(F.coalesce("previous", F.lit(GENESIS)))
    last = F.col("after").isNull()
    headless = last & (F.col("id") == F.col("last_id")) & (F.col("hash") != F.col("head"))
    beyond = F.col("last_id").isNull() | (F.col("id") > F.col("last_id"))

    def found(when: Column, number: Column, kind: str) -> Column:
        return F.when(when, F.struct(number.alias("id"), F.lit(kind).alias("kind")))

    in_rows = rows.select(
        F.explode(
            F.array_compact(
                F.array(
                    found(gap, F.col("expected"), "missing"),
                    found(~F.col("intact") | (~gap & ~linked) | headless, F.col("id"), "edited"),
                    found(last & (F.col("id") < F.col("last_id")), F.col("id") + 1, "missing"),
                    found(beyond, F.col("id"), "unanchored"),
                )
            )
        ).alias("f")
    ).select("f.*")
    lost = anchored.join(own.select("block").distinct(), "block", "left_anti").select(
        F.col("first_id").alias("id"), F.lit("missing").alias("kind")
    )
    return in_rows.unionByName(lost)


def verify_log(log: DataFrame, anchored: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row: `ok`, `checked` (sealed rows) and `first_bad_id`, edited or missing."""
    bad = findings(log, anchored, segment_rows).agg(F.min("id").alias("first_bad_id"))
    checked = log.filter(F.col("hash").isNotNull()).agg(F.count("*").alias("checked"))
    # One row each.
    return checked.join(F.broadcast(bad), F.lit(True)).select(
        F.col("first_bad_id").isNull().alias("ok"), "checked", "first_bad_id"
    )
