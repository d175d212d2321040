"""JDBC tables: partitioned reads and write-back of changes.

Write-back puts changes into a staging table with Spark's own writer and then
applies them inside the database, in one transaction of set statements.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Dataset, dataset
from ..errors import TableError
from ..operators.change import Change

#: Driver classes of the database kinds a catalog can name.
DRIVERS = {
    "oracle": "oracle.jdbc.OracleDriver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "sybase": "com.sybase.jdbc4.jdbc.SybDriver",
    "db2": "com.ibm.db2.jcc.DB2Driver",
    "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver",
}
#: What names are quoted by, where it is not double quotes.
QUOTES = {"mysql": ("`", "`"), "mssql": ("[", "]"), "sybase": ("[", "]")}

#: The longest text key that write-back can match.
KEY_CHARS = 1000
#: Rows of a table that one task reads, about, and tasks at most.
TASK_ROWS, MAX_TASKS = 1_000_000, 500


def quoted(kind: str, name: str) -> str:
    """A name as the database kind quotes it."""
    left, right = QUOTES.get(kind, ('"', '"'))
    return left + name.replace(right, right * 2) + right


def _load(spark: SparkSession, url: str, source: str, kind: str, properties: dict[str, str] | None, **options: object) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=source, driver=DRIVERS[kind], **(properties or {}), **options).load()


def read_table(
    spark: SparkSession, name: str, url: str, table: str, keys: list[str], kind: str = "derby", where: str | None = None, properties: dict[str, str] | None = None, partition_column: str | None = None, tasks: int | None = None, **options: object
) -> Dataset:
    """A keyed dataset over a table; where is applied in the database, as are
    filters and column choices of later reads.

    The table is read in ranges of a whole-number column, the first such key column
    if none is named, over as many tasks as its rows need; the database gives the
    column's least and greatest value and the number of rows. Without such a column
    (or with tasks=1) one task reads the table.
    """
    source = f"(SELECT * FROM {table} WHERE {where}) t" if where else table
    rows = _load(spark, url, source, kind, properties)
    whole = {f.name for f in rows.schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0)}
    names = {c.lower(): c for c in rows.columns}
    column = names.get(partition_column.lower()) if partition_column else next((names[k.lower()] for k in keys if names.get(k.lower()) in whole), None)
    if partition_column and column not in whole:
        raise TableError(505, f"{name}.{partition_column}: no whole numbers")
    if column is not None and tasks != 1:
        c = quoted(kind, column)
        inside = f"(SELECT MIN({c}) AS low, MAX({c}) AS high, COUNT(*) AS n FROM {source}) b"
        low, high, n = _load(spark, url, inside, kind, properties).first()
        tasks = min(MAX_TASKS, -(-n // TASK_ROWS)) if tasks is None else tasks
        if tasks > 1 and low is not None and low < high:
            rows = _load(spark, url, source, kind, properties, partitionColumn=c, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=tasks)
    return dataset(name, rows, keys, **options)


def write_table(rows: DataFrame, url: str, table: str, kind: str = "derby", mode: str = "errorifexists", properties: dict[str, str] | None = None, keys: list[str] | tuple[str, ...] = ()) -> None:
    """Writes rows; text columns among keys are of a type that can be compared."""
    types = ", ".join(f"`{k}` VARCHAR({KEY_CHARS})" for k in keys if isinstance(rows.schema[k].dataType, T.StringType))
    rows.write.format("jdbc").options(url=url, dbtable=table, driver=DRIVERS[kind], **(properties or {}), **({"createTableColumnTypes": types} if types else {})).mode(mode).save()


@dataclass
class Statements:
    """The SQL that applies a staging table, for one kind of database.

    where restricts the rows of the table that may be removed or set, as the dataset's
    own filter does. Update and delete match keys null-safely.
    """

    kind: str
    table: str
    stage: str
    keys: tuple[str, ...]
    values: list[str]
    where: str | None = None
    _op: str = field(init=False, default="")

    def __post_init__(self) -> None:
        self._op = quoted(self.kind, "op")

    def same(self, a: str, b: str) -> str:
        return " AND ".join(f"({a}.{k} = {b}.{k} OR ({a}.{k} IS NULL AND {b}.{k} IS NULL))" for k in (quoted(self.kind, k) for k in self.keys))

    def _there(self, restrict: bool) -> str:
        extra = f" AND ({self.where})" if restrict and self.where else ""
        return f"EXISTS (SELECT 1 FROM {self.table} w WHERE {self.same('w', self.stage)}{extra})"

    def drop_failed(self, op: str) -> str:
        """Takes changes from the staging table that have no row to change, or that
        would insert a key again."""
        there = self._there(op != "I")
        return f"DELETE FROM {self.stage} WHERE {self._op} = '{op}' AND {there if op == 'I' else f'NOT {there}'}"

    def remove(self) -> str:
        return f"DELETE FROM {self.table} WHERE EXISTS (SELECT 1 FROM {self.stage} s WHERE s.{self._op} = 'D' AND {self.same('s', self.table)})"

    def update(self) -> str:
        sets = ", ".join(f"{'t.' if self.kind == 'mysql' else ''}{v} = s.{v}" for v in (quoted(self.kind, v) for v in self.values))
        on, meant = self.same("t", "s"), f"s.{self._op} = 'M'"
        if self.kind == "mysql":
            return f"UPDATE {self.table} t JOIN {self.stage} s ON {on} SET {sets} WHERE {meant}"
        if self.kind == "sybase":
            return f"UPDATE {self.table} SET {sets} FROM {self.table} t, {self.stage} s WHERE {on} AND {meant}"
        end = ";" if self.kind == "mssql" else ""
        if self.kind == "oracle":  # takes a condition after the assignments only
            return f"MERGE INTO {self.table} t USING (SELECT * FROM {self.stage} WHERE {self._op} = 'M') s ON ({on}) WHEN MATCHED THEN UPDATE SET {sets}"
        return f"MERGE INTO {self.table} {'AS ' if self.kind != 'derby' else ''}t USING {self.stage} {'AS ' if self.kind != 'derby' else ''}s ON {on} WHEN MATCHED AND {meant} THEN UPDATE SET {sets}{end}"

    def insert(self, columns: list[str]) -> str:
        names = ", ".join(quoted(self.kind, c) for c in columns)
        return f"INSERT INTO {self.table} ({names}) SELECT {names} FROM {self.stage} WHERE {self._op} = 'I'"


def changed_values(log: DataFrame, values: list[str]) -> list[str]:
    """The value columns that some modification of a log changes."""
    differs = [F.max(~F.col(f"before.`{v}`").eqNullSafe(F.col(f"after.`{v}`"))).alias(v) for v in values]
    row = log.filter("op = 'M'").agg(*differs).first() if values else None
    return [v for v in values if row[v]]


def write_back(spark: SparkSession, change: Change, url: str, table: str, kind: str = "derby", properties: dict[str, str] | None = None, where: str | None = None, ignore_fails: bool = False) -> dict[str, int]:
    """Applies a change to its table: rows removed (D), set (M) and inserted (I), and
    changes that failed, in one transaction.

    Only columns that some row changes are set. A change fails if its row is not in
    the table (or outside where), or its new key is already there. Failures undo the
    whole change, error 210; with ignore_fails the others are applied.
    """
    keys, values = change.dataset.keys, change.dataset.values
    rows = change.log.select("op", *keys, *(F.col(f"after.`{v}`").alias(v) for v in values))
    return apply_rows(spark, rows, keys, values, url, table, kind, properties, where, ignore_fails, changed_values(change.log, values))


def apply_rows(
    spark: SparkSession, rows: DataFrame, keys: tuple[str, ...], values: list[str], url: str, table: str, kind: str = "derby", properties: dict[str, str] | None = None, where: str | None = None, ignore_fails: bool = False, to_set: list[str] | None = None
) -> dict[str, int]:
    """As write_back, from rows(op, keys, values after the change)."""
    stage = f"{table}_CHANGES"
    write_table(rows.select("op", *keys, *values), url, stage, kind, "overwrite", properties, ("op", *keys))
    sql = Statements(kind, table, stage, tuple(keys), values if to_set is None else to_set, where)
    jvm = spark.sparkContext._jvm
    login = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        login.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, login)
    try:
        connection.setAutoCommit(False)
        run = connection.createStatement().executeUpdate
        failed = run(sql.drop_failed("D")) + run(sql.drop_failed("M"))
        done = {"D": run(sql.remove()), "M": run(sql.update()) if sql.values else 0}
        failed += run(sql.drop_failed("I"))  # after removals, which can make room for a key
        done["I"] = run(sql.insert([*keys, *values]))
        if failed and not ignore_fails:
            raise TableError(210, f"{table}: {failed}")
        run(f"DROP TABLE {stage}")
        connection.commit()
        return done | {"failed": failed}
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
