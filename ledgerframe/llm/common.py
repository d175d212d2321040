"""What the operators share: reading tables, cutting lineage, mapping batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import new_folder

#: Rows and bytes of a text table that cross to Python at once; bound a worker's memory.
TEXT_ROWS_PER_BATCH, TEXT_BYTES_PER_BATCH = 1000, "32m"

#: Fixed value: the words of the query contracts, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Text tables cross to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES_PER_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """df as written to the shared folder and read again, with its lineage cut.

    Unlike a checkpoint's, its size is known to the planner: estimates of joins over
    joins would else be multiplied in every round of a loop.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a settled df that nothing reads any more."""
    spark = df.sparkSession
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
