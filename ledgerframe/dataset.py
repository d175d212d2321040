"""A keyed dataset: a DataFrame with a declared unique key."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TableError

_TYPES = (T.IntegerType, T.LongType, T.DoubleType, T.StringType, T.TimestampNTZType, T.TimestampType, T.BooleanType)
#: Column types that are read as another one.
_READ_AS = {T.ByteType: "int", T.ShortType: "int", T.FloatType: "double", T.DecimalType: "double", T.DateType: "timestamp_ntz"}


@dataclass(frozen=True)
class Dataset:
    """name, rows, key columns, columns that must not be null, and indexes
    (name to columns) over which postings can be built."""

    name: str
    data: DataFrame
    keys: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ordered: bool = False

    def column(self, name: str) -> str:
        """The column's own spelling, from its name in any case or its ordinal."""
        names = self.data.columns
        if name.isdecimal() and int(name) < len(names):
            return names[int(name)]
        found = {c.lower(): c for c in names}.get(name.lower())
        if found is None:
            raise TableError(505, f"{self.name}.{name}")
        return found

    def has(self, name: str) -> bool:
        return (name.isdecimal() and int(name) < len(self.data.columns)) or name.lower() in {c.lower() for c in self.data.columns}

    def type_of(self, name: str) -> T.DataType:
        return self.data.schema[self.column(name)].dataType

    def with_data(self, data: DataFrame) -> Dataset:
        return replace(self, data=data)

    @property
    def values(self) -> list[str]:
        return [c for c in self.data.columns if c not in self.keys]


def dataset(name: str, data: DataFrame, keys: list[str], not_null: list[str] | None = None, indexes: dict[str, list[str]] | None = None, ordered: bool = False, check: bool = True) -> Dataset:
    """Declares data as keyed. Columns of narrower or date types are widened,
    nested ones refused; unless check is off, keys must be unique and not null.

    ordered: range-partitions and sorts by key, for scans in key order and for
    row-group pruning of copies written from it.
    """
    if not keys:
        raise TableError(110, name)
    casts = {f.name: F.col(f"`{f.name}`").cast(_READ_AS[type(f.dataType)]) for f in data.schema if type(f.dataType) in _READ_AS}
    data = data.withColumns(casts) if casts else data
    for f in data.schema:
        if not isinstance(f.dataType, _TYPES):
            raise TableError(504, f"{name}.{f.name}: {f.dataType.simpleString()}")
    bare = Dataset(name, data, ())
    own = tuple(bare.column(k) for k in keys)
    if check:
        require_unique(data, own)
    if ordered:
        data = data.repartitionByRange(*own).sortWithinPartitions(*own)
    return Dataset(name, data, own, tuple(bare.column(c) for c in not_null or ()), {n: tuple(bare.column(c) for c in cs) for n, cs in (indexes or {}).items()}, ordered)


def require_unique(data: DataFrame, keys: tuple[str, ...] | list[str]) -> None:
    """Fails on null or repeated keys; one aggregation over the key columns."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(f"`{k}`").isNull()
    counted = data.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.count("*").alias("__n"))
    row = counted.filter((F.col("__n") > 1) | null).select(null.alias("null")).limit(1).collect()
    if row:
        raise TableError(237 if row[0]["null"] else 241, ", ".join(keys))
