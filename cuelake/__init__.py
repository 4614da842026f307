"""Timed-text and interval analytics on Spark."""
