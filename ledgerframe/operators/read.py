"""Filtered reads, key reads, paging, counts, sizes and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Dataset
from ..errors import TableError
from ..functions.criteria import criteria_filter
from ..lineage import cut


def get(data: Dataset, criteria: str | None = None, select: list[str] | None = None) -> DataFrame:
    """Rows that meet the criteria (all without), with all or the named columns."""
    condition = criteria_filter(data, criteria)
    rows = data.data if condition is None else data.data.filter(condition)
    return rows if select is None else rows.select(*(F.col(f"`{data.column(c)}`") for c in select))


def point_get(data: Dataset, key: dict[str, object]) -> DataFrame:
    """The value columns of one key: no row or one."""
    named = [data.column(c) for c in key]
    if not key:
        raise TableError(207, data.name)
    if other := [c for c in named if c not in data.keys]:
        raise TableError(220, ", ".join(other))
    if len({*named}) != len(data.keys):
        raise TableError(219 if len(named) > len(data.keys) else 216, ", ".join(c for c in data.keys if c not in named))
    rows = data.data
    for name, value in key.items():
        rows = rows.filter(F.col(f"`{data.column(name)}`") == F.lit(value))
    return rows.select(*(F.col(f"`{c}`") for c in data.values))


def multi_get(data: Dataset, keys: DataFrame) -> DataFrame:
    """keys (key columns and others, such as a position) with each key's values,
    null where the key is missing."""
    return keys.join(data.data, list(data.keys), "left")


def key_of(data: Dataset, values: list[object]) -> dict[str, object]:
    """A key from its values in the order of the key columns."""
    if len(values) != len(data.keys):
        raise TableError(218, data.name)
    return dict(zip(data.keys, values, strict=True))


def in_key_order(data: Dataset) -> DataFrame:
    """All rows sorted by key, nulls first."""
    return data.data.orderBy(*(F.col(f"`{k}`").asc_nulls_first() for k in data.keys))


def fetch_batches(data: Dataset, size: int = 1000, select: list[str] | None = None) -> DataFrame:
    """All rows (or the named columns) with the batch, from 0, that a fetch in key
    order brings them in.

    One range shuffle sorts the rows by key, null keys first, and they are spooled
    to the shared folder as a cursor over one snapshot would be. Only then are they
    numbered, by place within their now fixed partition and the number of rows in
    those before it, so no second sampling of ranges can disagree with the first.
    """
    keys = [F.col(f"`{k}`").asc_nulls_first() for k in data.keys]
    named = data.data.columns if select is None else [data.column(c) for c in select]
    kept = list(dict.fromkeys([*named, *data.keys]))
    spooled = cut(data.data.select(*(F.col(f"`{c}`") for c in kept)).repartitionByRange(*keys).sortWithinPartitions(*keys))
    place = F.monotonically_increasing_id()  # partition, then 33 bits of place in it
    parts = spooled.withColumns({"__part": F.shiftright(place, 33), "__place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    starts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = parts.join(F.broadcast(starts), "__part")  # a row per partition
    return numbered.select(*(F.col(f"`{c}`") for c in named), F.floor((F.col("__before") + F.col("__place")) / size).alias("batch"))


def entry_count(data: Dataset) -> DataFrame:
    return data.data.agg(F.count("*").alias("entries"))


def metadata(data: Dataset) -> DataFrame:
    """id, name, type, key position (null for values) and nullability of every column."""
    required = {*data.keys, *data.not_null}
    rows = [(i, f.name, f.dataType.simpleString(), data.keys.index(f.name) if f.name in data.keys else None, f.name not in required) for i, f in enumerate(data.data.schema)]
    return data.data.sparkSession.createDataFrame(rows, "id int, name string, type string, key_position int, nullable boolean")


def _cells(names: list[str]) -> Column:
    """Bytes of a row's cells: four and the text's length for every non-null one."""
    cells = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")) + 4, F.lit(0)) for c in names]
    total = cells[0].cast("long")
    for cell in cells[1:]:
        total = total + cell
    return total


def dataset_size(data: Dataset, columns: list[str] | None = None) -> DataFrame:
    """Bytes of the stored cells, of all columns or those named."""
    names = [data.column(c) for c in columns] if columns else data.data.columns
    return data.data.agg(F.coalesce(F.sum(_cells(names)), F.lit(0)).alias("bytes")).select(F.lit(data.name).alias("dataset"), "bytes")


def size_parts(data: Dataset) -> DataFrame:
    """Bytes by part: cells, one row for each declared index (its columns and keys), and
    the metadata (names and types). One pass over the rows for all of them."""
    parts = {"cells": data.data.columns} | {f"index {n}": [*c, *(k for k in data.keys if k not in c)] for n, c in data.indexes.items()}
    sums = data.data.agg(*(F.coalesce(F.sum(_cells(c)), F.lit(0)).alias(n) for n, c in parts.items()))
    described = sum(8 + len(f.name.encode()) + len(f.dataType.simpleString()) for f in data.data.schema)
    rows = F.array(*(F.struct(F.lit(n).alias("part"), F.col(f"`{n}`").alias("bytes")) for n in parts), F.struct(F.lit("metadata").alias("part"), F.lit(described).cast("long").alias("bytes")))
    return sums.select(F.inline(rows)).select(F.lit(data.name).alias("dataset"), "part", "bytes")


def database_size(sets: list[Dataset], columns: dict[str, list[str]] | None = None) -> DataFrame:
    sizes = [dataset_size(d, (columns or {}).get(d.name)) for d in sets]
    rows = sizes[0]
    for more in sizes[1:]:
        rows = rows.union(more)
    return rows.agg(F.sum("bytes").alias("bytes"))


def dataset_list(spark: SparkSession, sets: list[Dataset]) -> DataFrame:
    rows = [(d.name, ",".join(d.keys), len(d.data.columns)) for d in sorted(sets, key=lambda d: d.name)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("dataset", T.StringType()), T.StructField("key_columns", T.StringType()), T.StructField("n_columns", T.IntegerType())]))
