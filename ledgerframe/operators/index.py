"""Postings of a declared index, and compaction of index logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..errors import TableError


def postings(data: Dataset, index: str) -> DataFrame:
    """The index's columns and an entry for each key, to be written sorted by
    the columns; reads of a range then skip row groups."""
    if index not in data.indexes:
        raise TableError(505, index)
    columns = data.indexes[index]
    return data.data.select(*columns, *(k for k in data.keys if k not in columns)).repartitionByRange(*columns).sortWithinPartitions(*columns, *data.keys)


def posting_counts(data: Dataset, index: str) -> DataFrame:
    """Per indexed value: keys, and the first and last of them (first key column)."""
    columns, key = data.indexes[index], data.keys[0]
    return data.data.groupBy(*columns).agg(F.count("*").alias("n_keys"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def posting_lists(data: Dataset, index: str, longest: int = 100_000) -> DataFrame:
    """Per indexed value the sorted lists of its keys, piece by piece: a value with
    more keys than longest has several pieces (by a hash of the key) of about that."""
    columns = data.indexes[index]
    rows = data.data.select(*columns, F.struct(*data.keys).alias("key"))
    counts = rows.groupBy(*(F.col(f"`{c}`").alias(f"__{c}") for c in columns)).agg(F.ceil(F.count("*") / longest).alias("__pieces"))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in columns]
    dealt = rows.join(counts, same).select(*columns, F.pmod(F.xxhash64("key"), F.col("__pieces")).alias("piece"), "key")
    return dealt.groupBy(*columns, "piece").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def compact_index_log(log: DataFrame, columns: list[str]) -> DataFrame:
    """log(columns, sign: 1 inserted, -1 deleted) without what cancels out."""
    return log.groupBy(*columns).agg(F.sum("sign").alias("net")).filter("net <> 0")
