import datetime
import operator
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerframe.console import Console
from ledgerframe.dataset import dataset
from ledgerframe.errors import TableError
from ledgerframe.operators import change, read
from ledgerframe.operators.join import join
from ledgerframe.plans import versions
from ledgerframe.session import Session
from ledgerframe.sources import files, jdbc
from ledgerframe.sources.catalog import Catalog

SCHEMA = "k long, n int, x double, s string, t timestamp_ntz, b boolean"
ROWS = [
    (1, 5, 1.5, "a", datetime.datetime(2024, 1, 2, 3, 4, 5), True),
    (2, None, -0.0, 'q"uote', None, False),
    (3, -7, float("inf"), None, datetime.datetime(2024, 1, 2), None),
    (4, 2**31 - 1, None, "back\\slash", datetime.datetime(1999, 12, 31, 23, 59, 59), True),
    (5, 0, 2.25, "Ünïcode it's", datetime.datetime(2024, 10, 2), False),
    (6, 5, 1e300, "", None, True),
]


@pytest.fixture(scope="module")
def small(spark):
    return dataset("small", spark.createDataFrame(ROWS, SCHEMA).repartition(2).cache(), ["k"])


OPS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
LITERALS = {"k": ["1", "3", "9", "x"], "n": ["5", "-7", "99999999999", "5.0"], "x": ["1.5", "0", "1e300", "nope"], "s": ["a", 'q"uote', "back\\slash", "Ünïcode it's", ""], "t": ["2024-1-2 3:4:5", "2024-01-02 00:00:00", "2024-13-01 00:00:00", "soon"], "b": ["true", "no"], "zz": ["zz", "a"]}


def _typed(column, text):
    try:
        if column in "kn":
            value = int(text)
            return value if column == "k" or value < 2**31 else None
        if column == "x":
            return float(text)
        if column == "t":
            return datetime.datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
        return text == "true" if column == "b" else text
    except ValueError:
        return None


def _holds(tree, row):
    if tree[0] in ("and", "or"):
        return (all if tree[0] == "and" else any)(_holds(t, row) for t in tree[1:])
    column, op, text = tree
    if column == "zz":
        return OPS[op](column, text)
    value, other = row["knxstb".index(column)], _typed(column, text)
    return value is not None and other is not None and OPS[op](value, other)


def _written(tree):
    if tree[0] in ("and", "or"):
        return f"({_written(tree[1])} {tree[0]} {_written(tree[2])})"
    escaped = tree[2].replace("\\", "\\\\").replace('"', '\\"')
    return f'{tree[0]} {tree[1]} "{escaped}"'


LEAF = st.sampled_from(sorted(LITERALS)).flatmap(lambda c: st.tuples(st.just(c), st.sampled_from(sorted(OPS)), st.sampled_from(LITERALS[c])))
TREE = st.recursive(LEAF, lambda t: st.tuples(st.sampled_from(["and", "or"]), t, t), max_leaves=5)


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(tree=TREE)
def test_criteria_equal_a_row_evaluator(small, tree):
    got = {r["k"] for r in read.get(small, _written(tree)).collect()}
    assert got == {r[0] for r in ROWS if _holds(tree, r)}


@pytest.mark.parametrize("text", ["k <> 1", "k = ", "(k=1", "k=1 or", "k=1 n=2", "and"])
def test_bad_criteria(small, text):
    with pytest.raises(TableError) as e:
        read.get(small, text).collect()
    assert e.value.code == 217


@pytest.mark.parametrize("text", ["", "  ", "()", None])
def test_empty_criteria(small, text):
    assert read.get(small, text).count() == len(ROWS)


def test_registration_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    for data, keys, code in ((rows, ["k"], 241), (rows, [], 110), (rows, ["zz"], 505), (rows.withColumn("k", F.lit(None).cast("int")), ["k"], 237), (rows.withColumn("a", F.array("k")), ["v"], 504)):
        with pytest.raises(TableError) as e:
            dataset("d", data, keys)
        assert e.value.code == code
    wide = dataset("d", spark.range(1).select("id", F.lit(1.5).cast("decimal(5,2)").alias("d"), F.current_date().alias("day")), ["id"])
    assert [t for _, t in wide.data.dtypes] == ["bigint", "double", "timestamp_ntz"]


def test_joins_refuse_other_types_and_names(small):
    for on, code in (("k=s", 254), ("k=none", 505)):
        with pytest.raises(TableError) as e:
            join(small, small, on)
        assert e.value.code == code


def test_join_nulls_match_under_every_operator(spark, small):
    got = join(small, small, "s>s", left_criteria="k=3", right_criteria="k>=1").select("r_k").collect()
    assert [r[0] for r in got] == [3]


def test_changes_are_all_or_nothing(spark, small):
    for rows, code in ((spark.createDataFrame([(7, 1), (1, 1)], "k long, n int"), 241), (spark.createDataFrame([(7, 1), (7, 2)], "k long, n int"), 241), (spark.createDataFrame([(None, 1)], "k long, n int"), 237), (spark.createDataFrame([(1,)], "n int"), 216)):
        with pytest.raises(TableError) as e:
            change.add(small, rows)
        assert e.value.code == code
    with pytest.raises(TableError) as e:
        change.modify(small, {"k": 1}, "n=5")
    assert e.value.code == 241
    with pytest.raises(TableError) as e:
        change.modify(dataset("d", small.data.filter("n is not null"), ["k"], not_null=["n"]), {"n": None}, "k=1")
    assert e.value.code == 248


def test_key_change_moves_rows(small):
    made = change.modify(small, {"k": F.col("k") + 10}, "b=true")
    assert sorted(r["k"] for r in made.dataset.data.collect()) == [2, 3, 5, 11, 14, 16]
    assert Counter(r["op"] for r in made.log.collect()) == {"D": 3, "I": 3}


def test_batch_remove_passes_over_missing_keys(spark, small):
    made = change.remove(small, keys=spark.createDataFrame([(1,), (1,), (99,)], "k long"))
    assert made.dataset.data.count() == len(ROWS) - 1 and made.log.count() == 1


def _legal_histories(n):
    out = [[]]
    for _ in range(n):
        out += [h + [op] for h in out for op in (("M", "D") if h and h[-1] != "D" else ("I",))]
    return {tuple(h) for h in out if h} | {("M",), ("D",), ("M", "D"), ("D", "I"), ("M", "M")}


def _fold(history):
    net = None
    for op in history:
        net = {(None, "I"): "I", (None, "M"): "M", (None, "D"): "D", ("I", "M"): "I", ("I", "D"): None, ("M", "M"): "M", ("M", "D"): "D", ("D", "I"): "M"}[net, op]
    return net


def test_compaction_equals_the_step_by_step_fold(spark):
    histories = sorted(_legal_histories(5))
    rows = [(i, 0, op, k, i) for k, h in enumerate(histories) for i, op in enumerate(h)]
    feed = spark.createDataFrame(rows, "bp long, seq int, op string, key long, value long")
    got = {r["key"]: r["op"] for r in versions.compact(feed, ["key"]).collect()}
    assert got == {k: net for k, h in enumerate(histories) if (net := _fold(h))}


def test_session_console_and_catalog(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(str(tmp_path / "NATION"))
    xml = "<dataSets><dataSet phyType='file'><tableName>NATION</tableName><keyColumns><column>n_nationkey</column></keyColumns><indexes><index><columns><column>n_name</column></columns></index></indexes><unknown/></dataSet></dataSets>"
    (tmp_path / "sets.xml").write_text(xml)
    catalog = Catalog(spark)
    catalog.load_xml(str(tmp_path / "sets.xml"), str(tmp_path))
    assert catalog.get("nation").indexes == {"index1": ("n_name",)}
    with pytest.raises(TableError):
        catalog.load_xml(str(tmp_path / "sets.xml"), str(tmp_path))
    session = Session(spark, catalog)
    console = Console(session)
    assert session.single_read("NATION", {"n_nationkey": 3})["n_name"] is not None
    assert len(session.submit(session.search("nation", "n_nationkey<5")).result()) == 5
    console.run("add {n_nationkey:77;n_name:SEVENTY;n_regionkey} to NATION")
    assert console.run('get @value from nation with {n_name="SEVENTY"}').count() == 1
    assert console.run("size").first()["bytes"] > 0
    console.run(f"copy nation {tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 26
    with pytest.raises(TableError):
        console.run("fetch everything")
    assert "217" in console.run("show @error")
    console.run("reload nation")
    assert console.run("get @value from NATION").count() == 25
    console.run("release nation")
    with pytest.raises(TableError):
        console.run("get @metadata from nation")
    session.close()


def test_mirror_keeps_the_last_copy(spark, small, tmp_path):
    path = str(tmp_path / "m")
    files.mirror_to(spark, small, path)
    files.mirror_to(spark, small.with_data(small.data.limit(2)), path)
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(path + ".bak").count() == len(ROWS)


def test_write_back_reports_rows(spark):
    url = "jdbc:derby:memory:writeback;create=true"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    jdbc.write_table(rows, url, "T", keys=["k"])
    data = dataset("T", rows, ["k"])
    assert jdbc.write_back(spark, change.modify(data, {"v": 9}, "v>=2"), url, "T") == {"D": 0, "M": 2, "I": 0, "failed": 0}
    assert jdbc.write_back(spark, change.modify(data, {"k": F.concat("k", F.lit("2"))}, "v=1"), url, "T") == {"D": 1, "M": 0, "I": 1, "failed": 0}
    left = jdbc.read_table(spark, "T", url, "T", ["k"], where='"v" > 0')
    assert sorted(map(tuple, left.data.collect())) == [("a2", 1), ("b", 9), ("c", 9)]


def test_options_file(spark, tmp_path):
    from ledgerframe.sources.options import DEFAULTS, read_options

    (tmp_path / "p.ini").write_text("# comment\nAPPLYINTERVALMS = 500 # ms\nbuddyServers=a:1, b:2,\nother = x=y\nnothing\n")
    got = read_options(spark, str(tmp_path / "p.ini"))
    assert got == DEFAULTS | {"applyIntervalMs": 500, "buddyServers": ["a:1", "b:2"], "other": "x=y"}
    assert read_options(spark) == DEFAULTS
