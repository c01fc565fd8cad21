"""beaconry: OpenTelemetry ingestion analytics as PySpark DataFrames."""
