"""Authorisation of tool calls against the policy of their agent.

The quota is the only check that looks at other calls. The calls a session may make are its
first `max` eligible ones (those that pass every other check), so all that is needed per
session is the place of the last of them: a call beyond it meets an exhausted quota. That place
is found by counting: eligible calls, narrow rows, are laid out in sorted ranges; the number of
calls of each session in each range gives, by a running sum over the ranges, the range and the place
in it of the last call allowed. A session with a third of all calls spans many ranges and is never
gathered, whatever its quota is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.functions import policy_checks as P
from gatehouse.functions.text import fill
from gatehouse.operators.joins import broadcast_if_small, row_bytes, same_keys
from gatehouse.session import stored
from gatehouse.settings import DEFAULT, Settings

# A row's number within a range takes the lower bits of its place, the number of the range the others.
RANGE_BITS = 33

CHECKS = ("_known", "_denied", "_unlisted", "_traverses", "_tag", "_max_calls")


@dataclass(frozen=True)
class Rules:
    """A policy table made ready for joins, and its largest quota (0 if there is none)."""

    table: DataFrame
    largest_quota: int


def prepare(policy: DataFrame) -> Rules:
    """Reads four numbers from the policy table: its rows and bytes, its agents and its largest quota.

    Two lines for one agent are an error: each call would get two verdicts.
    """
    sized = policy.withColumn("_bytes", row_bytes())
    rows, agents, most, n_bytes = sized.agg(
        F.count("*"), F.count_distinct("agent"), F.max("max_calls_per_session"), F.sum("_bytes")
    ).first()
    if agents < rows:
        raise ValueError(f"the policy table has {rows} lines for {agents} agents")
    table = policy.select(
        "agent",
        F.col("allowed_tools").alias("_allowed"),
        F.col("denied_tools").alias("_denied_tools"),
        F.col("max_calls_per_session").alias("_max_calls"),
        F.col("deny_path_tags").alias("_tags"),
        F.lit(True).alias("_known"),
    )
    return Rules(broadcast_if_small(table, rows, n_bytes or 0), max(most or 0, 0))


def check_calls(calls: DataFrame, rules: Rules) -> DataFrame:
    """Adds the outcome of each check that needs only the call and its policy."""
    return (
        calls.join(rules.table, "agent", "left")
        .withColumns(
            {
                "_known": F.coalesce("_known", F.lit(False)),
                "_denied": P.deny_listed(F.col("tool"), F.col("_denied_tools")),
                "_unlisted": P.not_allow_listed(F.col("tool"), F.col("_allowed")),
                "_traverses": P.traverses(F.col("args")),
                "_tag": P.first_forbidden_tag(F.col("args"), F.col("_tags")),
            }
        )
        .drop("_allowed", "_denied_tools", "_tags")
    )


def eligible() -> Column:
    return (
        F.col("_known")
        & ~F.col("_denied")
        & ~F.col("_unlisted")
        & ~F.col("_traverses")
        & F.col("_tag").isNull()
    )


def last_allowed(checked: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """For sessions that use up their quota: the place of the last call within it.

    The eligible calls are written to the shared folder, sorted by range, with their place in that
    order. Ranges follow from the data, so a long session covers many of them.
    """
    counted = checked.filter(eligible() & (F.col("_max_calls") > 0)).select(
        *session, *order, "_max_calls"
    )
    ranged = counted.repartitionByRange(*session, *order).sortWithinPartitions(*session, *order)
    rows = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "eligible-calls")
    # A session lies in one piece within a range: one row per session and range is left.
    pieces = rows.groupBy(*session, F.shiftright("_place", RANGE_BITS).alias("_range")).agg(
        F.min("_place").alias("_first"), F.count("*").alias("_calls"), F.max("_max_calls").alias("_max")
    )
    earlier = Window.partitionBy(*session).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.withColumn("_before", F.coalesce(F.sum("_calls").over(earlier), F.lit(0)))
    here = (F.col("_before") < F.col("_max")) & (F.col("_before") + F.col("_calls") >= F.col("_max"))
    last = counts.filter(here).select((F.col("_first") + F.col("_max") - F.col("_before") - 1).alias("_place"))
    return rows.join(last, "_place").select(
        *[F.col(name).alias(f"_at_{name}") for name in session],
        F.struct(*order).alias("_last_allowed"),
    )


def quota_ends(
    checked: DataFrame, rules: Rules, session: list[str], order: list[str], store: bool = False
) -> DataFrame:
    """`last_allowed` for the quotas of a policy table, written out first if `store`."""
    if not rules.largest_quota:
        # No quota can be reached: nothing to find, and nothing to join with.
        at = [F.col(name).alias(f"_at_{name}") for name in session]
        return checked.filter(F.lit(False)).select(*at, F.struct(*order).alias("_last_allowed"))
    ends = last_allowed(checked, session, order)
    return stored(ends, "session-ends") if store else ends


def exhausted(order: list[str]) -> Column:
    """Whether the session had used up its quota before this call."""
    none_left = F.col("_max_calls") <= 0
    beyond = F.struct(*order) > F.col("_last_allowed")
    return F.coalesce(none_left, F.lit(False)) | F.coalesce(beyond, F.lit(False))


def join_ends(rows: DataFrame, ends: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Adds `_last_allowed`; `keys` names the columns that hold the session."""
    pairs = {mine: f"_at_{name}" for name, mine in keys.items()}
    return rows.join(ends, same_keys(rows, ends, pairs), "left").drop(*pairs.values())


def refusal(exhausted: Column, strict: bool = True, settings: Settings = DEFAULT) -> Column:
    """Reason of the first failing check, null if the call is allowed."""
    texts = settings.messages
    unknown = fill(texts.unknown_agent, F.coalesce("agent", F.lit("None")))
    return (
        F.when(~F.col("_known"), F.raise_error(unknown) if strict else unknown)
        .when(F.col("_denied"), fill(texts.deny_listed, "tool"))
        .when(F.col("_unlisted"), fill(texts.not_allow_listed, "tool"))
        .when(exhausted, fill(texts.quota_reached, "_max_calls"))
        .when(F.col("_traverses"), F.lit(texts.traversal))
        .when(F.col("_tag").isNotNull(), fill(texts.forbidden_tag, "_tag"))
    )


def decide(
    checked: DataFrame, order: list[str], strict: bool = True, settings: Settings = DEFAULT
) -> DataFrame:
    """Adds `allowed` and `reason` to checked calls that know the end of their quota."""
    return (
        checked.withColumn("_refusal", refusal(exhausted(order), strict, settings))
        .withColumns(
            {
                "allowed": F.col("_refusal").isNull(),
                "reason": F.coalesce("_refusal", F.lit(settings.messages.ok)),
            }
        )
        .drop(*CHECKS, "_last_allowed", "_refusal")
    )


def authorize(
    calls: DataFrame,
    policy: DataFrame,
    session: tuple[str, ...] = ("session_id", "agent"),
    order: tuple[str, ...] = ("seq",),
    strict: bool = True,
    settings: Settings = DEFAULT,
    store: bool = False,
) -> DataFrame:
    """Adds `allowed` and `reason` to each call.

    `order` must be unique within a session. An agent without a policy is an error if
    `strict`; otherwise its calls are refused, and `unknown_agents` lists them.

    With `store`, the sessions that use up their quota are written to the shared folder first.
    Spark then knows how many there are: few of them are broadcast and the calls are not
    shuffled at all. Otherwise, and if there are many, calls and sessions are shuffled, and
    adaptive execution splits a session that holds too many calls.
    """
    rules = prepare(policy)
    checked = check_calls(calls, rules)
    ends = quota_ends(checked, rules, list(session), list(order), store)
    with_ends = join_ends(checked, ends, {name: name for name in session})
    return decide(with_ends, list(order), strict, settings)


def unknown_agents(calls: DataFrame, policy: DataFrame) -> DataFrame:
    """Calls of agents without a policy."""
    return calls.join(prepare(policy).table.select("agent"), "agent", "left_anti")
