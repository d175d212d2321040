"""Reads at sizes where partitions, sampling and AQE come in."""

from pyspark.sql import functions as F

from ledgerframe.dataset import dataset
from ledgerframe.operators import read


def test_batches_of_a_wide_table_of_many_partitions(spark, capsys):
    n = 1_500_000
    key = (F.col("id") * 7_368_787) % n  # a permutation of 0..n-1
    rows = spark.range(0, n, 1, 40).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = read.fetch_batches(dataset("t", rows, ["k"], check=False))
        assert got.columns == ["k", "wide", "batch"]
        checked = got.select("k", "batch", "wide").join(rows.withColumnRenamed("wide", "was"), "k")
        assert checked.filter((F.col("batch") == F.floor(F.col("k") / 1000)) & (F.col("wide") == F.col("was"))).count() == n == got.count()
        got.explain("formatted")
        assert "rangepartitioning" not in capsys.readouterr().out  # the one range shuffle was spooled
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_batches_with_null_and_compound_keys(spark):
    rows = spark.createDataFrame([(i % 7 or None, f"v{i:03}") for i in range(300)], "a int, b string")
    got = read.fetch_batches(dataset("t", rows, ["a", "b"], check=False), 50, ["b"]).collect()
    order = sorted((i % 7, f"v{i:03}") for i in range(300))  # 0 stands for null
    assert {r["b"]: r["batch"] for r in got} == {b: n // 50 for n, (_, b) in enumerate(order)}
    empty = dataset("t", rows.limit(0), ["a", "b"], check=False)
    assert read.fetch_batches(empty).count() == 0


def test_ordered_scan_is_in_order(spark, sf_dir):
    events = dataset("e", spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn"], check=False)
    got = [(r["conv_id"], r["turn"]) for r in read.in_key_order(events).collect()]
    assert got == sorted(got) and len(got) > 50
