"""Snapshots and compaction of change feeds.

A feed has version columns bp and seq, op ('I', 'M', 'D'), key columns and value
columns holding the row after the change (null for 'D'). All folds are
aggregations by key with partial sums, so a key with many changes costs a task
one running row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORDER = ["bp", "seq"]


def _version() -> Column:
    return F.struct(*_ORDER)


def _values(feed: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in feed.columns if c not in {*_ORDER, "op", *keys}]


def snapshot(feed: DataFrame, keys: list[str], as_of: int | None = None) -> DataFrame:
    """The rows as they stood at version as_of (the latest without)."""
    seen = feed if as_of is None else feed.filter(F.col("bp") <= as_of)
    values = _values(feed, keys)
    last = seen.groupBy(*keys).agg(F.max_by(F.struct("op", *values), _version()).alias("last"))
    return last.filter("last.op <> 'D'").select(*keys, *(F.col(f"last.`{v}`").alias(v) for v in values))


def compact(feed: DataFrame, keys: list[str]) -> DataFrame:
    """One change per key with the net effect; none where a row came and went.

    For legal histories the first and last operations decide: inserted and
    removed cancels out, inserted stays an insert, a last removal is one, and
    all else is a modification.
    """
    values = _values(feed, keys)
    ends = feed.groupBy(*keys).agg(F.min_by("op", _version()).alias("first"), F.max_by(F.struct(*_ORDER, "op", *values), _version()).alias("last"))
    first, last = F.col("first"), F.col("last.op")
    op = F.when((first == "I") & (last == "D"), None).when(first == "I", "I").when(last == "D", "D").otherwise("M")
    return ends.withColumn("op", op).filter("op is not null").select(*(F.col(f"last.{c}").alias(c) for c in _ORDER), "op", *keys, *(F.col(f"last.`{v}`").alias(v) for v in values))


def replay(base: DataFrame, feed: DataFrame, keys: list[str], last_applied: int) -> DataFrame:
    """base with all changes newer than last_applied."""
    values = _values(feed, keys)
    new = feed.filter(F.col("bp") > last_applied).groupBy(*keys).agg(F.max_by(F.struct("op", *values), _version()).alias("last"))
    kept = base.select(*keys, *values).join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.filter("last.op <> 'D'").select(*keys, *(F.col(f"last.`{v}`").alias(v) for v in values)))


def purge(base: DataFrame, feed: DataFrame, keys: list[str], oldest: int, last_applied: int) -> tuple[DataFrame, DataFrame]:
    """Folds changes up to oldest (the oldest version still read) into base."""
    return replay(base, feed.filter(F.col("bp") <= oldest), keys, last_applied), feed.filter(F.col("bp") > oldest)
