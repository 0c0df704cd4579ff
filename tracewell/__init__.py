"""Operational-log analytics on Spark."""
