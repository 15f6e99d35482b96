"""Plans of the report-volume engine."""
