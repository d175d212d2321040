"""A replica that follows a folder of change files, and periodic write-back of one.

The replica's rows are dealt over buckets by a hash of the key. A micro-batch
rewrites only the buckets that its changes touch, as files of a new version, and
then writes a manifest: the version that holds each bucket. Readers take the last
manifest, so they see whole versions only; it appears in one step, by a rename. A
batch that is run again writes the same version again. Versions that none of the
last KEEP manifests names are removed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.versions import compact, replay
from ..sources import jdbc
from ..sources.options import DEFAULTS

_NEVER = -(2**63)
#: Buckets of a new replica, files of a bucket, and manifests whose versions stay readable.
BUCKETS, FILES, KEEP = 32, 8, 3


class Folder:
    """A replica's folder: manifests and versions, by way of Spark's file systems."""

    def __init__(self, spark: SparkSession, target: str) -> None:
        self.spark, self.target = spark, target
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str, pattern: str) -> list[int]:
        path = self._path(f"{self.target}/{folder}")
        if not self._fs.exists(path):
            return []
        return sorted(int(m[1]) for m in (re.fullmatch(pattern, s.getPath().getName()) for s in self._fs.listStatus(path)) if m)

    def manifests(self) -> list[int]:
        return self._listed("manifests", r"(\d+)\.json")

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket to the version that holds it; BUCKETS entries at most."""
        text = self.spark.read.text(f"{self.target}/manifests/{version}.json", wholetext=True).first()[0]
        return {int(b): v for b, v in json.loads(text).items()}

    def write_manifest(self, version: int, buckets: dict[int, int]) -> None:
        part, done = (self._path(f"{self.target}/manifests/{version}.{end}") for end in ("part", "json"))
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(buckets).encode()))
        stream.close()
        self._fs.delete(done, False)  # there only if the batch is run again
        self._fs.rename(part, done)

    def bucket_path(self, version: int, bucket: int) -> str:
        return f"{self.target}/versions/{version}/__bucket={bucket}"

    def written(self, version: int, buckets: list[int]) -> list[int]:
        """Those of the buckets that a version has rows of."""
        return [b for b in buckets if self._fs.exists(self._path(self.bucket_path(version, b)))]

    def purge(self) -> None:
        kept = self.manifests()[-KEEP:]
        named = {v for m in kept for v in self.manifest(m).values()} | set(kept)
        for version in self._listed("versions", r"(\d+)"):
            if version not in named and version < kept[-1]:
                self._fs.delete(self._path(f"{self.target}/versions/{version}"), True)
        for version in self.manifests()[:-KEEP]:
            self._fs.delete(self._path(f"{self.target}/manifests/{version}.json"), False)

    def rows(self, buckets: dict[int, int], schema: T.StructType) -> DataFrame:
        paths = [self.bucket_path(v, b) for b, v in sorted(buckets.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def current(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The replica's latest whole version; no rows before the first batch."""
    folder = Folder(spark, target)
    done = folder.manifests()
    return folder.rows(folder.manifest(done[-1]) if done else {}, schema)


def append_changes(feed: DataFrame, feed_dir: str, keys: list[str]) -> None:
    """Ships a statement's changes, compacted first."""
    compact(feed, keys).write.mode("append").parquet(feed_dir)


def _values(feed_schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in feed_schema if f.name not in {"bp", "seq", "op"}])


def _start(spark: SparkSession, feed_dir: str, feed_schema: T.StructType, each, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = spark.readStream.schema(feed_schema).parquet(feed_dir).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def replicate(spark: SparkSession, feed_dir: str, feed_schema: T.StructType, keys: list[str], target: str, checkpoint: str, interval: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts following feed_dir; interval None takes what is there and stops. The
    number of buckets of a replica must stay as it was."""
    values = _values(feed_schema)

    def fold(batch: DataFrame, batch_id: int) -> None:
        folder = Folder(batch.sparkSession, target)
        done = [v for v in folder.manifests() if v < batch_id]
        held = folder.manifest(done[-1]) if done else {}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())
        base = folder.rows({b: v for b, v in held.items() if b in touched}, values)
        new = replay(base, batch, keys, _NEVER).withColumn("__bucket", bucket)
        parts = F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(FILES))  # no bucket is one task's alone
        new.repartition("__bucket", parts).write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/versions/{batch_id}")
        now = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(folder.written(batch_id, touched), batch_id)
        folder.write_manifest(batch_id, now)
        folder.purge()

    return _start(spark, feed_dir, feed_schema, fold, checkpoint, interval)


def follow_into_table(
    spark: SparkSession, feed_dir: str, feed_schema: T.StructType, keys: list[str], url: str, table: str, checkpoint: str, kind: str = "derby", properties: dict[str, str] | None = None, where: str | None = None, interval_ms: int | None = DEFAULTS["applyIntervalMs"], counts: list[dict[str, int]] | None = None
) -> StreamingQuery:
    """Writes changes shipped to feed_dir back to a table every interval_ms (None: once,
    what is there). Each interval's changes are compacted first. counts, if given, gets
    every batch's rows by operation and failures.

    Failures are counted, not raised, so a batch that is run again after a lost driver
    brings the table to the same state.
    """
    values = [f.name for f in _values(feed_schema) if f.name not in keys]

    def apply(batch: DataFrame, batch_id: int) -> None:
        done = jdbc.apply_rows(batch.sparkSession, compact(batch, keys), tuple(keys), values, url, table, kind, properties, where, ignore_fails=True)
        if counts is not None:
            counts.append(done)

    return _start(spark, feed_dir, feed_schema, apply, checkpoint, None if interval_ms is None else f"{interval_ms} milliseconds")


def feed_of(log: DataFrame, bp: int, keys: list[str]) -> DataFrame:
    """Change rows of one statement as a feed of version bp."""
    values = [c for c in log.schema["after"].dataType.names if c not in keys]
    return log.select(F.lit(bp).cast("long").alias("bp"), F.when(F.col("op") == "I", 1).otherwise(0).alias("seq"), "op", *keys, *(F.col(f"after.`{v}`").alias(v) for v in values))
