"""A session: reads and changes by dataset name, at once or in the background."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession

from .errors import TableError
from .operators import change, index, read
from .operators.join import join
from .sources.catalog import Catalog
from .sources.options import read_options


class Session:
    """One caller's view of a catalog. Changes replace the dataset's state; the
    last change's log is kept for write-back or shipping.

    Within a snapshot all reads see the versions of its start, both sides of a join
    alike, whatever this or other sessions of the catalog change meanwhile.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, options: dict[str, object] | None = None) -> None:
        self.spark = spark
        self.catalog = catalog or Catalog(spark)
        self.options = read_options(spark) | (options or {})
        self.last_error: Exception | None = None
        self.last_change: change.Change | None = None
        self._as_of: int | None = None
        self._pool = ThreadPoolExecutor(1)
        self._running: Future | None = None

    def _run(self, what: Callable, *args: object, **named: object):
        try:
            return what(*args, **named)
        except Exception as e:
            self.last_error = e
            raise

    def _get(self, name: str):
        return self.catalog.get(name, self._as_of)

    def _change(self, what: Callable, name: str, *args: object, **named: object) -> change.Change:
        made = self._run(what, self.catalog.get(name), *args, **named)
        self.last_change = change.Change(self.catalog.put(made.dataset), made.log)
        return self.last_change

    def begin_snapshot(self) -> int:
        """From now on reads see the present versions."""
        self.end_snapshot()
        self._as_of = self.catalog.open_snapshot()
        return self._as_of

    def end_snapshot(self) -> None:
        if self._as_of is not None:
            self.catalog.close_snapshot(self._as_of)
            self._as_of = None

    def search(self, name: str, criteria: str | None = None, select: list[str] | None = None) -> DataFrame:
        return self._run(lambda: read.get(self._get(name), criteria, select))

    def search_join(self, left: str, right: str, on: str | None = None, mode: str = "ON", **options: object) -> DataFrame:
        return self._run(lambda: join(self._get(left), self._get(right), on, mode, **options))

    def single_read(self, name: str, key: dict[str, object]) -> Row | None:
        return self._run(lambda: next(iter(read.point_get(self._get(name), key).take(1)), None))

    def multi_read(self, name: str, keys: DataFrame) -> DataFrame:
        return self._run(lambda: read.multi_get(self._get(name), keys))

    def fetch(self, name: str) -> DataFrame:
        """All rows with their batch of a fetch in key order, of the size that options set."""
        return self._run(lambda: read.fetch_batches(self._get(name), self.options["fetchBatchRows"]))

    def postings(self, name: str, index_name: str) -> DataFrame:
        return self._run(lambda: index.postings(self._get(name), index_name))

    def insert(self, name: str, rows: DataFrame) -> change.Change:
        return self._change(change.add, name, rows)

    def insert_row(self, name: str, values: dict[str, object]) -> change.Change:
        return self.insert(name, self._run(lambda: change.row_of(self.catalog.get(name), values)))

    def modify(self, name: str, values: dict[str, object], criteria: str | None = None, keys: DataFrame | None = None) -> change.Change:
        return self._change(change.modify, name, values, criteria, keys)

    def remove(self, name: str, criteria: str | None = None, keys: DataFrame | None = None) -> change.Change:
        return self._change(change.remove, name, criteria, keys)

    def submit(self, frame: DataFrame) -> Future:
        """Collects a result in the background, one at a time a session."""
        self._running = self._pool.submit(lambda: self._run(frame.collect))
        return self._running

    @property
    def async_state(self) -> str:
        """CLEAR, RUNNING, COMPLETED or FAILED: the state of the last submitted call."""
        if self._running is None:
            return "CLEAR"
        if not self._running.done():
            return "RUNNING"
        return "FAILED" if self._running.exception() else "COMPLETED"

    def async_result(self) -> list[Row] | None:
        """The result of the last submitted call, None while it runs; a fetched result
        or failure clears the state."""
        if self._running is None or not self._running.done():
            return None
        done, self._running = self._running, None
        return done.result()

    def close(self) -> None:
        """Waits for what runs, and gives up the snapshot. A failure that nobody fetched is raised."""
        self._pool.shutdown(wait=True)
        self.end_snapshot()
        if self._running is not None and self._running.exception():
            raise self._running.exception()


def open_session(spark: SparkSession, options_path: str, base_dir: str) -> Session:
    """A session by an options file: its catalog file, if there is one in base_dir, is loaded."""
    options = read_options(spark, options_path)
    session = Session(spark, options=options)
    path = f"{base_dir}/{options['catalogFile']}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        raise TableError(208, path)
    session.catalog.load_xml(path, base_dir)
    return session
