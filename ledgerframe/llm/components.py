"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, settle

_MAX_ROUNDS = 60
#: Parts that a vertex's edges are dealt over, so that a hub's go to many tasks.
_SALTS = 32


def with_group(rows: DataFrame, key: str, value: str, figures: dict[str, Column], at_least: int = 1) -> DataFrame:
    """rows with figures of their key's group added; only keys of at_least rows.

    The join is on key and a salt of the value. Each key's figures have a row
    for the salts it occurs with, so a key with many rows is split and one with
    few is not multiplied.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(_SALTS)).cast("int"))
    groups = salted.groupBy(key).agg(F.count("*").alias("n_rows"), F.collect_set("salt").alias("salts"), *(c.alias(name) for name, c in figures.items()))
    groups = groups.filter(F.col("n_rows") >= at_least).select(key, *figures, F.explode("salts").alias("salt"))
    return salted.join(groups, [key, "salt"]).drop("salt")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges between vertices of one ordered type, to one row (a, b) for every vertex a but the
    smallest of each component, which is its b.

    Every round joins edges with each vertex's smallest neighbour; neither a
    component nor a hub's edges are gathered in one task. No edges give no rows.
    """
    edges = settle(edges.select("a", "b").filter("a != b").distinct())
    before = _state(edges)
    for _ in range(_MAX_ROUNDS):
        if not before[0]:
            return edges
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_group(both, "a", "b", {"m": F.min("b")}).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        down = large.filter("a != b").distinct()
        small = with_group(down, "a", "b", {"m": F.min("b")})
        last, edges = edges, settle(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct())
        after = _state(edges)
        forget(last)
        if after == before:
            return edges
        before = after
    raise RuntimeError("components did not converge")
