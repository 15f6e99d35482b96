"""Operators of the report-volume engine."""
