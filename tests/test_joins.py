"""Joins whose groups of equal keys are split over tasks."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerframe.dataset import dataset
from ledgerframe.functions import criteria
from ledgerframe.operators import join as joins
from ledgerframe.plans import catalogue


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK_PAIRS", 40), ("BLOCK_ROWS", 4), ("TASK_ROWS", 100)):
        monkeypatch.setattr(joins, name, value, raising=False)


def most_in_a_task(df):
    """The largest task's rows, and all."""
    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count"), F.sum("count")).first()


def test_null_groups_are_split_over_tasks(spark, sf_dir, same_rows, small_blocks):
    most, rows = most_in_a_task(catalogue.QUERIES["join_null_safe"](spark, sf_dir))
    assert most < rows / 10
    same_rows(catalogue.QUERIES["join_null_safe"], catalogue.ORACLE_SQL["join_null_safe"])
    most, rows = most_in_a_task(catalogue.QUERIES["join_null_safe_whole"](spark, sf_dir))
    assert most < rows / 10
    same_rows(catalogue.QUERIES["join_null_safe_whole"], catalogue.ORACLE_SQL["join_null_safe_whole"])


def uneven(spark):
    """Two tables with a frequent key, a frequent one on each side only, null and zero."""

    def made(key, n, *frequent):
        rows = spark.range(n).withColumn("k", F.expr(f"CASE WHEN id < 60 THEN 'often' WHEN id < 100 THEN {frequent[0]} WHEN id < 120 THEN 'k' || id ELSE 'k' || (id % 9) END"))
        return dataset(key, rows.select(F.col("id").alias(key), "k", F.expr("IF(id % 3 = 0, -0.0D, 0.0D)").alias("z"), (F.col("id") * 37 % 50).cast("int").alias("v")), [key])

    return made("a", 150, "NULL"), made("b", 140, "'only'"), made("c", 170, "IF(id % 2 = 0, NULL, 'only')")


@pytest.mark.parametrize("mode", ["ON", "LEFTON", "RIGHTON", "OUTON"])
@pytest.mark.parametrize("on", ["k=k and v>v", "z=z and (K=k)", "k=k and (k=k or v=v)"])
def test_split_joins_equal_plain_ones(spark, small_blocks, mode, on):
    a, b, c = uneven(spark)
    for left, right in ((a, b), (a, c), (c, b)):
        got = joins.join(left, right, on, mode)
        condition = criteria.join_condition(left, right, on, ("l_", "r_"))
        sides = [d.data.select(*(F.col(x).alias(p + x) for x in d.data.columns)) for d, p in ((left, "l_"), (right, "r_"))]
        want = sides[0].join(sides[1], condition, joins.MODES[mode])
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        assert got.columns == want.columns


def test_tasks_by_pairs_and_keys_left_alone(spark, small_blocks, capsys):
    a, b, _ = uneven(spark)
    made = joins.join(a, b, "k=k")
    made.explain()
    plan = capsys.readouterr().out
    tasks = re.findall(r"Exchange hashpartitioning\(__block_[01]#\d+, (\d+)\), REPARTITION_BY_NUM", plan)
    assert len(tasks) == 2 and tasks[0] == tasks[1] and int(tasks[0]) > 100  # not dealt again over the default number
    joins.join(a, b, "a=b").explain()
    assert "REPARTITION_BY_NUM" not in capsys.readouterr().out  # a key: no group to count


def test_required_columns(spark):
    a, b, _ = uneven(spark)
    for on, want in (("k=k and v>v", ["k"]), ("k=k or v=v", []), ("k=k and (v=v or z=z)", ["k"]), ("((k=k) and (v=v and z=z))", ["k", "v", "z"]), ("k=k and v=v or z=z", []), ("(k=k or k=k) and a<b", []), (None, [])):
        assert criteria.equal_columns(a, b, on) == [(x, x) for x in want]


def test_few_keys_make_no_long_task(spark, small_blocks, duck, tmp_path):
    """A task's rows do not grow where a few keys' pairs do, four-fold."""
    largest = []
    for n in (1, 2):
        at = f"{tmp_path}/{n}"
        spark.range(600 * n).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"), (F.col("id") % 3).cast("int").alias("c_nationkey"), (F.col("id") * 7 % 100).cast("double").alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{at}/customer.parquet")
        spark.range(60 * n).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), "id").alias("s_name"), (F.col("id") % 3).cast("int").alias("s_nationkey"), (F.col("id") * 11 % 100).cast("double").alias("s_acctbal")).write.parquet(f"{at}/supplier.parquet")
        most, rows = most_in_a_task(catalogue.QUERIES["join_multi_key"](spark, at))
        assert rows == duck.execute(f"SELECT count(*) FROM '{at}/customer.parquet/*.parquet' JOIN '{at}/supplier.parquet/*.parquet' ON c_nationkey = s_nationkey AND c_acctbal >= s_acctbal").fetchone()[0]
        largest.append(most)
    assert largest[1] < 2 * largest[0] and largest[1] < rows / 10


@pytest.fixture
def huge_groups(monkeypatch):
    for name, value in (("BLOCK_PAIRS", 400), ("BLOCK_ROWS", 20), ("TASK_ROWS", 1000), ("HUGE_PAIRS", 1000), ("PACK_ROWS", 8)):
        monkeypatch.setattr(joins, name, value, raising=False)


def rows_shuffled(plan):
    """Rows written to shuffles by a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return rows_shuffled(plan.finalPhysicalPlan())
    if name.endswith("QueryStageExec"):
        return rows_shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(rows_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_shuffled_rows_of_huge_groups_grow_with_the_input(spark, huge_groups):
    """Twice the rows make four times the pairs, but not four times the shuffled rows."""
    shuffled = []
    for n in (200, 400):
        a, b = (dataset(x, spark.range(n).select(F.col("id").alias(x), F.expr("CASE WHEN id % 10 > 0 THEN NULL ELSE id END AS k")), [x]) for x in "ab")
        made = joins.join(a, b, "k=k")
        assert len(made.collect()) == (n * 9 // 10) ** 2 + n // 10
        shuffled.append(rows_shuffled(made._jdf.queryExecution().executedPlan()))
    assert shuffled[1] < 2.5 * shuffled[0] and shuffled[1] < 4 * 2 * 400


@pytest.mark.parametrize("on", ["k=k and v>v", "z=z and (K=k)", "k=k and (k=k or v=v)", "z=z"])
def test_packed_joins_equal_plain_ones(spark, huge_groups, on):
    a, b, c = uneven(spark)
    for left, right in ((a, b), (a, c), (c, b)):
        got = joins.join(left, right, on, right_select=["v", "k"])
        condition = criteria.join_condition(left, right, on, ("l_", "r_"))
        sides = [d.data.select(*(F.col(x).alias(p + x) for x in d.data.columns)) for d, p in ((left, "l_"), (right, "r_"))]
        want = sides[0].join(sides[1], condition).select(*sides[0].columns, "r_v", "r_k")
        assert Counter(map(repr, got.collect())) == Counter(map(repr, want.collect()))
        assert got.columns == want.columns and (on != "z=z" or most_in_a_task(got)[0] < most_in_a_task(got)[1] / 4)


@pytest.mark.parametrize("name", ["join_null_safe", "join_null_safe_whole", "join_multi_key"])
def test_packed_queries_equal_their_sql(spark, sf_dir, name, same_rows, huge_groups, monkeypatch, capsys):
    monkeypatch.setattr(joins, "HUGE_PAIRS", 1)
    catalogue.QUERIES[name](spark, sf_dir).explain()
    assert "__pack_0" in capsys.readouterr().out
    same_rows(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
