"""Governance and audit analytics for AI-agent activity, as Spark jobs.

Tables of tool calls, documents, answers and audit events go in; decisions,
scan verdicts, masked texts, sealed audit logs and reports come out. Every job is
a function from DataFrames to a DataFrame (or a streaming query).
"""
