"""Telemetry leakage analytics and corpus preparation as plain Spark jobs."""
