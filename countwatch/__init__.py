"""countwatch: report-volume measurement, forecasting and review on PySpark."""
