import pytest
from pyspark.sql import functions as F

from ledgerframe.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(name, same_rows):
    same_rows(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir, capsys):
    catalogue.QUERIES["get_select"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(o_totalprice,100000.0)" in plan
    assert "struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_null_safe_join_is_no_nested_loop(spark, sf_dir, capsys):
    catalogue.QUERIES["join_null_safe"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_null_joins_read_whole_tables(spark, sf_dir, capsys):
    read = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("nation", "orders")}
    theta = catalogue.QUERIES["join_theta_ne_null_whole"](spark, sf_dir)
    assert theta.select("l_n_nationkey").distinct().count() == read["nation"].count()
    assert theta.filter("l_n_regionkey IS NULL AND r_r_regionkey IS NULL").count() > 0
    safe = catalogue.QUERIES["join_null_safe_whole"](spark, sf_dir)
    whole = read["orders"].filter("o_orderkey % 7 = 0 OR o_custkey <> 1").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), (F.col("o_orderkey") % 7 == 0) | (F.col("o_custkey") == F.col("c_custkey")), "left_semi")
    assert safe.select("l_o_orderkey").distinct().count() == whole.count()
    safe.explain()
    assert "NestedLoop" not in capsys.readouterr().out
