"""Streaming of the report-volume engine."""
