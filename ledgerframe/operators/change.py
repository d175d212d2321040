"""Keyed changes: each returns the new dataset and its change rows.

Nothing is applied in part: all checks run before a result is built. A change
row is op ('I', 'M' or 'D'), the key, and structs before and after.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset, require_unique
from ..errors import TableError
from ..functions.criteria import criteria_filter, typed_literal


@dataclass(frozen=True)
class Change:
    dataset: Dataset
    log: DataFrame


def _row(data: Dataset, prefix: str = "") -> Column:
    return F.struct(*(F.col(f"`{prefix}{c}`").alias(c) for c in data.data.columns))


def _log(data: Dataset, rows: DataFrame, op: str, before: Column | None, after: Column | None) -> DataFrame:
    kind = data.data.schema.simpleString()
    keys = after if after is not None and before is None else before
    return rows.select(
        F.lit(op).alias("op"),
        *(keys[k].alias(k) for k in data.keys),
        (F.lit(None).cast(kind) if before is None else before).alias("before"),
        (F.lit(None).cast(kind) if after is None else after).alias("after"),
    )


def _fit(data: Dataset, rows: DataFrame) -> DataFrame:
    """rows with the dataset's columns and types; columns not given are null."""
    given = {data.column(c): c for c in rows.columns}
    if missing := [k for k in data.keys if k not in given]:
        raise TableError(216, ", ".join(missing))
    return rows.select(*((F.col(f"`{given[f.name]}`") if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in data.data.schema))


def row_of(data: Dataset, values: dict[str, object]) -> DataFrame:
    """One row to add, from literals typed as criteria type them."""
    names = [data.column(c) for c in values]
    if len({*names}) < len(names):
        raise TableError(213, ", ".join(values))
    return data.data.sparkSession.range(1).select(*(typed_value(data, c, v).alias(n) for n, (c, v) in zip(names, values.items(), strict=True)))


def _require_not_null(data: Dataset, rows: DataFrame) -> None:
    """One pass over the columns that must not be null."""
    codes = {**dict.fromkeys(data.not_null, 248), **dict.fromkeys(data.keys, 237)}
    found = rows.agg(*(F.max(F.col(f"`{c}`").isNull()).alias(c) for c in codes)).first()
    for c, code in codes.items():
        if found[c]:
            raise TableError(code, c)


def typed_value(data: Dataset, column: str, value: object) -> Column:
    """A new value of a column: a Column over the old row as it is, cast; text as a
    literal of criteria is, refused if it does not fit; other values by Spark's cast."""
    kind = data.type_of(column)
    if isinstance(value, Column):
        return value.cast(kind)
    if isinstance(value, str):
        literal = typed_literal(value, kind)
        if literal is None:
            raise TableError(215, f"{column}: {value}")
        return F.expr(literal)
    made = F.lit(value).try_cast(kind)
    if value is not None and data.data.sparkSession.range(1).select(made.alias("v")).first()["v"] is None:
        raise TableError(215, f"{column}: {value}")
    return made


def add(data: Dataset, rows: DataFrame) -> Change:
    """Adds rows; a key that exists, or occurs twice in rows, refuses them all."""
    new = _fit(data, rows)
    _require_not_null(data, new)
    require_unique(new, data.keys)
    if data.data.join(new.select(*data.keys), list(data.keys), "left_semi").limit(1).count():
        raise TableError(241, ", ".join(data.keys))
    return Change(data.with_data(data.data.unionByName(new)), _log(data, new, "I", None, _row(data)))


def _target(data: Dataset, criteria: str | None, keys: DataFrame | None) -> tuple[DataFrame, Column]:
    """The rows with a marker of those meant; by key set or by criteria."""
    if keys is not None:
        marks = keys.select(*(F.col(f"`{c}`").alias(data.column(c)) for c in keys.columns)).select(*data.keys).distinct().withColumn("__hit", F.lit(True))
        return data.data.join(marks, list(data.keys), "left").select(*data.data.columns, "__hit"), F.coalesce("__hit", F.lit(False))
    condition = criteria_filter(data, criteria)
    return data.data, F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def modify(data: Dataset, values: dict[str, object], criteria: str | None = None, keys: DataFrame | None = None) -> Change:
    """Sets columns of the rows meant; null clears one. Values are literals or
    Columns over the old row. New keys must not collide."""
    if not values:
        raise TableError(214, data.name)
    new = {data.column(c): typed_value(data, c, v) for c, v in values.items()}
    rows, hit = _target(data, criteria, keys)
    marked = rows.withColumn("__hit", hit)
    changed = marked.select(_row(data).alias("__old"), "__hit", *(F.when(F.col("__hit"), new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in data.data.columns))
    hits = changed.filter("__hit")
    if {*new} & {*data.keys, *data.not_null}:
        _require_not_null(data, hits)
    if {*new} & {*data.keys}:
        require_unique(changed.select(*data.keys), data.keys)
        kept = F.lit(True)
        for k in data.keys:
            kept = kept & F.col(f"__old.{k}").eqNullSafe(F.col(f"`{k}`"))
        moved = hits.filter(~kept)
        log = _log(data, hits.filter(kept), "M", F.col("__old"), _row(data)).union(_log(data, moved, "D", F.col("__old"), None)).union(_log(data, moved, "I", None, _row(data)))
    else:
        log = _log(data, hits, "M", F.col("__old"), _row(data))
    return Change(data.with_data(changed.select(*data.data.columns)), log)


def remove(data: Dataset, criteria: str | None = None, keys: DataFrame | None = None) -> Change:
    """Removes the rows meant; keys that do not exist are passed over. Rows for
    which criteria are null stay."""
    rows, hit = _target(data, criteria, keys)
    marked = rows.withColumn("__hit", hit)
    gone = marked.filter("__hit")
    return Change(data.with_data(marked.filter("not __hit").select(*data.data.columns)), _log(data, gone, "D", _row(data), None))
