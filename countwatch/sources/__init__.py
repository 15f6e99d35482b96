"""Sources of the report-volume engine."""
