"""The catalog: datasets by name in any case, and the catalog file."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from ..dataset import Dataset
from ..errors import TableError
from ..lineage import cut
from ..operators.read import dataset_list
from . import files, jdbc


#: Changes of a dataset after which its rows are written out, so that plans stay short.
CUT_EVERY = 20
#: Kinds of index and of row order that a catalog file can name.
INDEX_KINDS = {"hashmap", "treemap", "sortedmap"}


class Catalog:
    """Registered datasets, how to read each anew, and their states by version.

    Every change makes a version. States are immutable, so a reader that opened a
    snapshot keeps seeing its version; states that no open snapshot needs are given up.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.version = 0
        self._states: dict[str, list[tuple[int, Dataset]]] = {}
        self._loaders: dict[str, Callable[[], Dataset]] = {}
        self._sources: dict[str, str] = {}
        self._open: Counter[int] = Counter()
        self._changes: Counter[str] = Counter()

    def register(self, load: Callable[[], Dataset], source: str | None = None) -> Dataset:
        """source names where the rows are; one source is registered once."""
        if source is not None and source.upper() in self._sources.values():
            raise TableError(249, source)
        found = load()
        key = found.name.upper()
        if key in self._states:
            raise TableError(205, found.name)
        self._states[key], self._loaders[key] = [(self.version, found)], load
        if source is not None:
            self._sources[key] = source.upper()
        return found

    def get(self, name: str, as_of: int | None = None) -> Dataset:
        """The latest state, or the one at a version."""
        key = name.upper()
        if key not in self._states:
            raise TableError(208 if key in self._loaders else 206, name)
        seen = [d for v, d in self._states[key] if as_of is None or v <= as_of]
        if not seen:
            raise TableError(208, f"{name} at {as_of}")
        return seen[-1]

    def put(self, data: Dataset) -> Dataset:
        """Replaces a dataset by its changed state, a new version."""
        self.get(data.name)
        key = data.name.upper()
        self._changes[key] += 1
        if self._changes[key] % CUT_EVERY == 0:
            data = data.with_data(cut(data.data))
        self.version += 1
        self._states[key].append((self.version, data))
        self.purge()
        return data

    def open_snapshot(self) -> int:
        """A version that stays readable until it is closed."""
        self._open[self.version] += 1
        return self.version

    def close_snapshot(self, version: int) -> None:
        self._open[version] -= 1
        self._open = +self._open
        self.purge()

    def purge(self) -> None:
        """Gives up the states that are older than any open snapshot sees."""
        oldest = min(self._open, default=self.version)
        for key, states in self._states.items():
            last = max((i for i, (v, _) in enumerate(states) if v <= oldest), default=0)
            self._states[key] = states[last:]

    def release(self, name: str) -> None:
        """Gives up a dataset's cached rows and the dataset; it can be loaded again."""
        self.get(name).data.unpersist()
        del self._states[name.upper()]

    def reload(self, name: str) -> Dataset:
        key = name.upper()
        if key not in self._loaders:
            raise TableError(206, name)
        found = self._loaders[key]()
        self.version += 1
        self._states.setdefault(key, []).append((self.version, found))
        self.purge()
        return found

    def all(self) -> list[Dataset]:
        return [self._states[k][-1][1] for k in sorted(self._states)]

    def listing(self) -> DataFrame:
        return dataset_list(self.spark, self.all())

    def load_xml(self, path: str, base_dir: str) -> list[Dataset]:
        """Registers what a catalog file declares. File datasets are Parquet
        folders named by table under base_dir, where database tables with storeLocal
        are mirrored to; unknown elements are passed over."""
        text = self.spark.read.text(path, wholetext=True).first()[0]
        return [self._load_node(node, base_dir) for node in ElementTree.fromstring(text).iter("dataSet")]

    def _load_node(self, node: ElementTree.Element, base_dir: str) -> Dataset:
        value = {e.tag: (e.text or "").strip() for e in node}
        table = value.get("tableName")
        keys = [(e.text or "").strip() for e in node.findall("keyColumns/column")]
        kind = (node.get("phyType") or "file").lower()
        wrong = [109] * (kind != "file" and kind not in jdbc.DRIVERS) + [111] * (not table) + [110] * (not keys)
        if kind != "file" and not wrong:
            needed = ((112, "connString"), *(((113, "dbUser"), (114, "dbPassword")) if kind != "derby" else ()))
            wrong = [code for code, name in needed if not value.get(name)]
        if wrong:
            raise TableError(wrong[0], table or "")
        indexes = {}
        for i, index in enumerate(node.findall("indexes/index"), start=1):
            if index.findtext("indexType", "HashMap").strip().lower() not in INDEX_KINDS:
                raise TableError(115, index.findtext("indexType"))
            indexes[index.get("name") or f"index{i}"] = [(e.text or "").strip() for e in index.findall("columns/column")]
        options = {"where": value.get("where") or None, "indexes": indexes, "ordered": "tree" in (node.get("memType") or "").lower()}
        if kind == "file":
            return self.register(lambda: files.read_parquet(self.spark, table, f"{base_dir}/{table}", keys, **options), table)
        login = {k: v for k, v in (("user", value.get("dbUser")), ("password", value.get("dbPassword"))) if v}
        url = value["connString"]
        found = self.register(lambda: jdbc.read_table(self.spark, table, url, table, keys, kind, properties=login, **options), f"{url}/{login.get('user', '')}/{table}")
        if value.get("storeLocal", "").lower() in ("true", "yes", "1"):
            files.mirror_to(self.spark, found, f"{base_dir}/{table}")
        return found
