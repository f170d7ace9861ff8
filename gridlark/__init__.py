"""Telemetry analytics and forecast evaluation as Spark DataFrame jobs."""
