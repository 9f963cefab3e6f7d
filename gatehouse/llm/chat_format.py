"""Tool-call linking and canonical chat records, in DataFrame functions only.

Calls and results are joined by identifier, ordered topologically, their arguments validated
against the schema of their tool, and each message is written as canonical JSON: keys sorted,
no spaces, nulls left out. One row per message, so a conversation of any length is never
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.session import stored

#: Rows of the schema table that are collected per tool and broadcast; more is an error.
MAX_SCHEMA_ROWS = 10_000

#: The type names of schemas and what the type of a parsed value begins with.
JSON_TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DECIMAL|DOUBLE",
    "boolean": "BOOLEAN",
    "object": "OBJECT",
    "array": "ARRAY",
}


def _call_id(conv: Column, turn: Column) -> Column:
    return F.concat_ws(":", conv.cast("string"), turn.cast("string"))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): how many calls stand before each one in its chain of needs.

    Pointer doubling: each round doubles the length of the chain that is known, so the rounds
    grow with the logarithm of the longest chain. level is null for calls in or behind a circle.
    """
    known = calls.select("conv_id", "call_id")
    own = F.col("needs")
    here = known.withColumnRenamed("call_id", "needs").withColumn("there", F.lit(True))
    links = calls.select("conv_id", "call_id", "needs").join(here, ["conv_id", "needs"], "left")
    state = stored(
        links.select("conv_id", "call_id", F.when(F.col("there"), own).alias("next"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("level")),
        "levels",
    )
    left = state.filter("next IS NOT NULL").count()
    while left:
        ahead = state.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("beyond"), F.col("level").alias("more"))
        state = stored(
            state.join(ahead, ["conv_id", "next"], "left").select(
                "conv_id", "call_id", F.col("beyond").alias("next"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")
            ),
            "levels",
        )
        before, left = left, state.filter("next IS NOT NULL").count()
        if left == before:
            # Doubling always finishes the calls next to the open ones, unless these run in circles.
            break
    return state.select("conv_id", "call_id", F.when(F.col("next").isNull(), F.col("level")).alias("level"))


def _schema_table(schemas: DataFrame) -> DataFrame:
    """One row per tool: its parameters as an array sorted by name. Checked to be small."""
    rows = schemas.filter(F.col("name").isNotNull() & F.col("param").isNotNull())
    if rows.limit(MAX_SCHEMA_ROWS + 1).count() > MAX_SCHEMA_ROWS:
        raise ValueError(f"more than {MAX_SCHEMA_ROWS} schema rows")
    param = F.struct("param", F.lower("type").alias("type"), F.coalesce("required", F.lit(False)).alias("required"))
    return F.broadcast(rows.groupBy("name").agg(F.array_sort(F.collect_set(param)).alias("params")))


def _problems(params: Column, given: Column) -> Column:
    """What is wrong with the arguments, as a sorted list; empty if nothing is."""
    names = F.map_keys(given)
    missing = F.transform(
        F.filter(params, lambda p: p["required"] & ~F.array_contains(names, p["param"])), lambda p: F.concat(F.lit("missing:"), p["param"])
    )
    declared = F.transform(params, lambda p: p["param"])
    unknown = F.transform(F.filter(names, lambda n: ~F.array_contains(declared, n)), lambda n: F.concat(F.lit("unknown:"), n))

    def mismatched(p: Column) -> Column:
        kind = F.regexp_extract(F.schema_of_variant(F.element_at(given, p["param"])), "^[A-Z]+", 0)
        wanted = F.element_at(F.create_map(*[F.lit(x) for kv in JSON_TYPES.items() for x in kv]), p["type"])
        fits = F.array_contains(F.split(wanted, "\\|"), kind)
        return F.array_contains(names, p["param"]) & ~F.coalesce(fits, F.lit(False))

    wrong = F.transform(F.filter(params, mismatched), lambda p: F.concat(F.lit("type:"), p["param"]))
    return F.array_sort(F.concat(missing, unknown, wrong))


def linked_messages(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls and results as linked, ordered, validated messages.

    calls: conv_id, call_id, turn, name, arguments (JSON text), needs (identifier of a call that
    must come first, or null). results: conv_id, call_id, turn, content. schemas: name, param,
    type (a key of JSON_TYPES), required.

    Returns conv_id, call_id, kind ("call" or "result"), step, turn, status, problems, message.
    step orders a conversation topologically: a call stands at twice its level in the chain of
    needs, its result right behind, ties by turn and call_id. status is `linked`; for a call
    `unanswered` if there is no result, `circular` if its needs run in a circle (step null); for
    a result `orphan` if there is no such call (step null, it is kept). problems lists missing
    and unknown parameters, wrong types, `arguments` if these are no JSON object with distinct
    keys, and `tool` if the tool has no schema; it is empty for results.

    Of several calls, or results, with one identifier the first by turn, then by content, counts
    and the others are left out as repetitions. A row without call_id or conv_id cannot be linked: such calls
    are `unanswered`, such results orphans. Null arguments are an empty object, a null content
    an empty text. Other columns are not looked at. Empty tables give an empty result.
    """
    keys = ["conv_id", "call_id"]
    named = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    call = F.struct("turn", "name", "arguments", "needs")
    answer = F.struct("turn", "content")
    first_calls = calls.filter(named).groupBy(*keys).agg(F.min(call).alias("c")).select(*keys, "c.*")
    first_results = results.filter(named).groupBy(*keys).agg(F.min(answer).alias("r")).select(*keys, "r.*")
    loose_calls = calls.filter(~named).select(*keys, "turn", "name", "arguments", "needs")
    loose_results = results.filter(~named).select(*keys, "turn", "content")

    answered = first_results.select(*keys, F.lit(True).alias("answered"))
    levels = _levels(first_calls)
    all_calls = (
        first_calls.join(answered, keys, "left")
        .join(levels, keys, "left")
        .unionByName(loose_calls.withColumns({"answered": F.lit(None).cast("boolean"), "level": F.lit(0).cast("long")}))
    )
    params = F.coalesce("params", F.array().cast("array<struct<param:string,type:string,required:boolean>>"))
    parsed = F.try_parse_json(F.coalesce("arguments", F.lit("{}")))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    given = F.when(is_object, F.try_variant_get(parsed, "$", "map<string,variant>"))
    problems = (
        F.when(~is_object, F.array(F.lit("arguments")))
        .when(F.col("params").isNull(), F.array(F.lit("tool")))
        .otherwise(_problems(params, given))
    )
    status = F.when(F.col("level").isNull(), "circular").when(F.col("answered"), "linked").otherwise("unanswered")
    call_rows = all_calls.join(_schema_table(schemas), "name", "left").select(
        *keys,
        F.lit("call").alias("kind"),
        (F.col("level") * 2).alias("step"),
        "turn",
        status.alias("status"),
        problems.alias("problems"),
        F.to_json(
            F.struct(F.when(is_object, parsed).alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("call").alias("type"))
        ).alias("message"),
    )
    called = first_calls.select(*keys, F.lit(True).alias("called")).join(levels, keys, "left")
    linked = F.coalesce("called", F.lit(False))
    result_rows = (
        first_results.join(called, keys, "left")
        .unionByName(loose_results.withColumns({"called": F.lit(None).cast("boolean"), "level": F.lit(None).cast("long")}))
        .select(
            *keys,
            F.lit("result").alias("kind"),
            (F.col("level") * 2 + 1).alias("step"),
            "turn",
            F.when(linked, "linked").otherwise("orphan").alias("status"),
            F.array().cast("array<string>").alias("problems"),
            F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"), F.col("call_id").alias("id"), F.lit("result").alias("type"))).alias("message"),
        )
    )
    return call_rows.unionByName(result_rows)


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls and results that stand in a table of chat turns (conv_id, turn, role, text), and their schemas.

    A user turn is a call of the tool `answer` with the arguments prompt and turn, a system turn
    one of the tool `configure` with the argument instructions; a call needs the call of the
    turn before the one before it. An assistant turn, or any other, is the result of the call
    one turn earlier.
    """
    role, turn = F.lower(F.coalesce("role", F.lit(""))), F.col("turn").cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), F.col("text").alias("text"))
    is_call = F.col("role").isin("user", "system")
    asks = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn"))
    sets = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("instructions")))
    calls = rows.filter(is_call).select(
        "conv_id",
        F.when(F.col("turn").isNotNull(), _call_id(F.col("conv_id"), F.col("turn"))).alias("call_id"),
        "turn",
        F.when(F.col("role") == "user", "answer").otherwise("configure").alias("name"),
        F.when(F.col("role") == "user", asks).otherwise(sets).alias("arguments"),
        _call_id(F.col("conv_id"), F.col("turn") - 2).alias("needs"),
    )
    results = rows.filter(~is_call).select(
        "conv_id",
        F.when(F.col("turn").isNotNull(), _call_id(F.col("conv_id"), F.col("turn") - 1)).alias("call_id"),
        "turn",
        F.col("text").alias("content"),
    )
    schemas = turns.sparkSession.createDataFrame(
        [("answer", "prompt", "string", True), ("answer", "turn", "integer", True), ("configure", "instructions", "string", True)],
        "name string, param string, type string, required boolean",
    )
    return calls, results, schemas
