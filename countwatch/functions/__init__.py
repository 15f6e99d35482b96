"""Functions of the report-volume engine."""
