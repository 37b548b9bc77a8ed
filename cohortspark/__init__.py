"""Spark-first analytics for longitudinal health and sensor data."""
