"""Columns for the checks of a tool call that need only its own row and its policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a `..` path component at the start, in the middle or at the end.
TRAVERSAL = "(?:^|[\\\\/])\\.\\.(?:[\\\\/]|\\n?\\z)"


def deny_listed(tool: Column, denied_tools: Column) -> Column:
    return F.coalesce(F.array_contains(denied_tools, tool), F.lit(False))


def not_allow_listed(tool: Column, allowed_tools: Column) -> Column:
    listed = F.coalesce(F.array_contains(allowed_tools, tool), F.lit(False))
    return (F.size(allowed_tools) > 0) & ~listed


def elements(value: Column) -> Column:
    """A value as text and, if it is a JSON list, each of its elements as well."""
    parts = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    none = F.array().cast("array<string>")
    whole = F.array(F.coalesce(value, F.lit("None")))
    return F.concat(whole, F.coalesce(F.filter(parts, lambda p: p.isNotNull()), none))


def values(args: Column) -> Column:
    """Argument values as text, in argument order; lists are checked element by element too."""
    found = F.flatten(F.transform(args, lambda a: elements(a["value"])))
    return F.coalesce(found, F.array().cast("array<string>"))


def traverses(args: Column) -> Column:
    return F.exists(values(args), lambda v: v.rlike(TRAVERSAL))


def first_forbidden_tag(args: Column, tags: Column) -> Column:
    """The first tag found: by argument, then by the order of the tags. Null if none is."""
    found = F.transform(
        values(args), lambda v: F.filter(tags, lambda tag: F.contains(F.lower(v), tag))
    )
    return F.try_element_at(F.flatten(found), F.lit(1))


def argument(args: Column, name: str) -> Column:
    """The value of one named argument, null if it is missing."""
    return F.try_element_at(F.filter(args, lambda a: a["key"] == name), F.lit(1))["value"]
