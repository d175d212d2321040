"""Replication of change feeds by Structured Streaming."""
