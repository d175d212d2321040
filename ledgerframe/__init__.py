"""Keyed tables on Spark: criteria reads, joins, keyed changes, snapshots and change logs."""
