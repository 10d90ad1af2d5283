"""Observation streams from fixed sensor networks, on Spark."""
