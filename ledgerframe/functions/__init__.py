"""Criteria text as Spark expressions."""
