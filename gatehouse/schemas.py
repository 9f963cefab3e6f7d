"""Schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

ARGS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
)

POLICY = T.StructType(
    [
        T.StructField("agent", T.StringType()),
        T.StructField("allowed_tools", T.ArrayType(T.StringType())),
        T.StructField("denied_tools", T.ArrayType(T.StringType())),
        T.StructField("max_calls_per_session", T.IntegerType()),
        T.StructField("deny_path_tags", T.ArrayType(T.StringType())),
    ]
)

TOOL_CALLS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("agent", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("args", ARGS),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.StringType()),
    ]
)

# `kind` is tool_call, answer or llm_error. `ts` may be null (the request's is used then).
STEPS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("step_no", T.LongType()),
        T.StructField("call_no", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("args", ARGS),
        T.StructField("text", T.StringType()),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("ts", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("text", T.StringType())]
)

# The log keeps `ts` as text because the hash covers the text.
AUDIT_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("pii_redacted", T.IntegerType()),
        T.StructField("prev_hash", T.StringType()),
        T.StructField("hash", T.StringType()),
    ]
)
