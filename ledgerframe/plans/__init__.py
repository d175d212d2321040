"""Versioned plans: snapshots, compaction and replay of change feeds."""
