"""Policy tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.schemas import POLICY

# The read-only policy shipped as default, and the wider one of the demo.
DEFAULT_POLICY = {
    "agents": {
        "summarizer": {
            "allowed_tools": [
                "list_allowed_directories",
                "list_directory",
                "list_directory_with_sizes",
                "directory_tree",
                "read_file",
                "read_text_file",
                "read_multiple_files",
                "search_files",
                "get_file_info",
            ],
            "denied_tools": ["write_file", "edit_file", "move_file", "create_directory"],
            "max_calls_per_session": 10,
            "deny_path_tags": ["confidential"],
        }
    }
}
DEMO_POLICY = {
    "agents": {
        "summarizer": {
            "allowed_tools": [
                "list_directory",
                "read_text_file",
                "read_multiple_files",
                "search_files",
                "get_file_info",
                "summarize",
                "create_task",
            ],
            "denied_tools": ["write_file", "edit_file", "move_file", "send_email", "delete_file"],
            "deny_path_tags": ["confidential", "secret"],
            "max_calls_per_session": 20,
        }
    }
}


def with_defaults(policy: DataFrame) -> DataFrame:
    """Missing lists become empty, tags lower-case; a missing quota stays null (no limit)."""

    def listed(name: str):
        return F.coalesce(F.col(name), F.array().cast("array<string>"))

    return policy.withColumns(
        {
            "allowed_tools": listed("allowed_tools"),
            "denied_tools": listed("denied_tools"),
            "deny_path_tags": F.transform(listed("deny_path_tags"), F.lower),
        }
    )


def policy_from_config(spark: SparkSession, config: Mapping) -> DataFrame:
    """A policy table from a parsed config: {"agents": {name: rules}}, every rule optional."""
    names = [field.name for field in POLICY.fields if field.name != "agent"]
    rows = [
        (agent, *[rules.get(name) for name in names])
        for agent, rules in config.get("agents", {}).items()
    ]
    return with_defaults(spark.createDataFrame(rows, POLICY))


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """A policy table from JSON lines, one agent per line."""
    return with_defaults(spark.read.schema(POLICY).json(path))
