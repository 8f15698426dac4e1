"""Structured Streaming forms of the query-log operators."""
