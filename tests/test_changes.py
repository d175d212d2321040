"""Changes that cannot harm a dataset, versions of a session, the console, write-back and replicas."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerframe.console import Console, _assignments
from ledgerframe.dataset import dataset
from ledgerframe.errors import TableError
from ledgerframe.operators import change, index, read
from ledgerframe.session import Session, open_session
from ledgerframe.sources import jdbc
from ledgerframe.sources.catalog import CUT_EVERY
from ledgerframe.streaming import replicate as rep


def code_of(what):
    with pytest.raises(TableError) as e:
        what()
    return e.value.code


@pytest.fixture
def session(spark):
    rows = spark.createDataFrame([(i, f"n{i}", i % 3, float(i)) for i in range(12)], "k long, s string, n int, x double").repartition(3)
    made = Session(spark)
    made.catalog.register(lambda: dataset("T", rows, ["k"], not_null=["n"], indexes={"by_n": ["n"]}))
    made.catalog.register(lambda: dataset("U", rows, ["k"]))
    return made


def test_a_bad_value_changes_nothing(session):
    for values in ({"n": "abc"}, {"n": "5.0"}, {"n": str(2**40)}, {"x": "much"}, {"n": "x", "s": "fine"}, {"n": 2**40}):
        assert code_of(lambda v=values: session.modify("T", v, "k=1")) == 215
    assert code_of(lambda: session.modify("T", {}, "k=1")) == 214
    assert code_of(lambda: session.insert_row("T", {"k": "new", "n": "1"})) == 215
    assert code_of(lambda: session.insert_row("T", {"k": "1", "K": "2"})) == 213
    assert session.search("T").count() == 12 and session.catalog.version == 0
    session.modify("T", {"n": "7", "x": 2, "s": None}, "k=1")
    assert tuple(session.search("T", "k=1").first()) == (1, None, 7, 2.0)


def test_keys_are_checked(session):
    data = session.catalog.get("T")
    for key, code in (({}, 207), ({"s": 1}, 220), ({"k": 1, "n": 2}, 220), ({"zz": 1}, 505)):
        assert code_of(lambda k=key: read.point_get(data, k)) == code
    two = dataset("two", data.data, ["k", "n"])
    assert code_of(lambda: read.point_get(two, {"k": 1})) == 216 and code_of(lambda: read.key_of(two, [1])) == 218
    assert read.point_get(two, read.key_of(two, [4, 1])).count() == 1


def test_a_snapshot_sees_its_version_on_both_sides(session):
    session.begin_snapshot()
    session.modify("T", {"s": "new"}, "k<6")
    session.remove("U", "k>=3")
    assert session.search("T", 's="new"').count() == 0 and session.search("U").count() == 12
    assert session.search_join("T", "U", "k=k").count() == 12
    assert session.postings("T", "by_n").count() == 12
    session.end_snapshot()
    assert session.search("T", 's="new"').count() == 6 and session.search_join("T", "U", "k=k").count() == 3
    assert all(len(states) == 1 for states in session.catalog._states.values())  # old states are given up


def test_many_changes_keep_plans_short(session):
    for i in range(2 * CUT_EVERY + 1):
        session.modify("T", {"x": F.col("x") + 1}, f"k={i % 12}")
    plan = session.search("T")._jdf.queryExecution().analyzed().toString()
    assert plan.count("Project") <= 2 * CUT_EVERY
    assert session.search("T").agg(F.sum("x")).first()[0] == sum(range(12)) + 2 * CUT_EVERY + 1


def test_background_calls_have_a_state(session, spark):
    assert session.async_state == "CLEAR" and session.async_result() is None
    session.submit(session.search("T", "k<5"))
    while session.async_state == "RUNNING":
        time.sleep(0.05)
    assert session.async_state == "COMPLETED" and len(session.async_result()) == 5 and session.async_state == "CLEAR"
    session.submit(spark.range(1).select(F.raise_error(F.lit("no"))))
    while session.async_state == "RUNNING":
        time.sleep(0.05)
    assert session.async_state == "FAILED"
    with pytest.raises(Exception, match="no"):
        session.close()


def test_assignments_hold_any_character():
    assert _assignments('a:1; b : "x;y:}z\\"" ;c;d:') == {"a": "1", "b": 'x;y:}z"', "c": None, "d": ""}
    assert code_of(lambda: _assignments('a:"open')) == 217


def test_console_quotes_short_forms_and_tables(session):
    console, lines = Console(session), []
    console.run('modify {s:"x;y}"} in T with {k=3 or s="}"}')
    assert session.single_read("t", {"k": 3})["s"] == "x;y}"
    console.run("add {k:99;s:it's;n:1} to T")
    assert console.show('get @value from T with {k="99"}', lines.append) == 1
    assert lines == ["k\ts\tn\tx", "-\t-\t-\t-", "99\tit's\t1\tnull", "1 datas found."]
    lines.clear()
    assert console.show("join @value from T with {k=99} U with {} LEFTON {k=k}", lines.append) == 1
    assert lines[2] == "99\tit's\t1\tnull\t\t\t\t"
    assert code_of(lambda: console.run("modify {n:abc} in T")) == 215 and "215" in console.run("show @error")
    assert console.run("H get").startswith("get ") and "join" in console.run("help join") and console.run("conn here 1 x") == "connected"
    assert {r["part"] for r in console.run("size T").collect()} == {"cells", "index by_n", "metadata"}
    console.run("release T")
    assert code_of(lambda: console.run("get @value from T")) == 208 and code_of(lambda: console.run("get @value from V")) == 206
    console.run("reload T")
    assert console.run("get @value from T").count() == 12 and console.run("disc") == "disconnected" and console.run("e") == "closed"


def test_posting_lists_come_in_pieces(session):
    data = session.catalog.get("T")
    got = index.posting_lists(data, "by_n", longest=2).collect()
    assert len(got) > 3 and sorted(k["k"] for r in got for k in r["keys"]) == list(range(12))
    assert sorted(len(r["keys"]) for r in index.posting_lists(data, "by_n").collect()) == [4, 4, 4]


# --- tables in databases


def test_partitioned_read(spark):
    url = "jdbc:derby:memory:parts;create=true"
    rows = spark.range(1000).select((F.col("id") * 3).alias("k"), F.col("id").cast("string").alias("s"))
    jdbc.write_table(rows, url, "P", keys=["k"])
    data = jdbc.read_table(spark, "P", url, "P", ["k"], tasks=5, where='"k" < 2700').data
    assert data.rdd.getNumPartitions() == 5 and data.count() == 900 and data.agg(F.sum("k")).first()[0] == sum(range(0, 2700, 3))
    sizes = [r["n"] for r in data.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 200
    assert jdbc.read_table(spark, "P", url, "P", ["k"]).data.rdd.getNumPartitions() == 1  # small
    assert jdbc.read_table(spark, "P", url, "P", ["s"], tasks=4).data.rdd.getNumPartitions() == 1  # no whole numbers
    assert code_of(lambda: jdbc.read_table(spark, "P", url, "P", ["k"], partition_column="s")) == 505


def test_write_back_within_where_counts_failures(spark):
    url = "jdbc:derby:memory:fails;create=true"
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x"), ("d", 4, "x")], "k string, v int, other string")
    jdbc.write_table(rows, url, "T", keys=["k"])
    data = dataset("T", rows, ["k"])
    made = change.modify(data, {"v": 9})
    assert jdbc.changed_values(made.log, ["v", "other"]) == ["v"]
    assert code_of(lambda: jdbc.write_back(spark, made, url, "T", where='"v" < 3')) == 210

    def table():
        return sorted(map(tuple, jdbc.read_table(spark, "T", url, "T", ["k"]).data.collect()))

    assert table() == sorted(map(tuple, rows.collect()))  # undone as a whole
    assert jdbc.write_back(spark, made, url, "T", where='"v" < 3', ignore_fails=True) == {"D": 0, "M": 2, "I": 0, "failed": 2}
    assert [v for _, v, _ in table()] == [9, 9, 3, 4]
    gone = change.remove(data, 'k="c" or k="d"')
    assert jdbc.write_back(spark, gone, url, "T", where='"v" > 3', ignore_fails=True)["failed"] == 1
    again = change.add(data.with_data(rows.limit(0)), spark.createDataFrame([("a", 5), ("z", 5)], "k string, v int"))
    assert jdbc.write_back(spark, again, url, "T", ignore_fails=True) == {"D": 0, "M": 0, "I": 1, "failed": 1}
    assert [k for k, *_ in table()] == ["a", "b", "c", "z"]


def test_statements_quote_as_their_database_does():
    made = {kind: jdbc.Statements(kind, "T", "S", ("k",), ["v"]) for kind in jdbc.DRIVERS}
    assert "`k` = s.`k`" in made["mysql"].update() and made["mysql"].update().startswith("UPDATE T t JOIN S s")
    assert "[k]" in made["mssql"].remove() and made["mssql"].update().endswith(";") and '"' not in made["sybase"].update()
    assert made["oracle"].update().startswith("MERGE INTO T t USING (SELECT") and 'UPDATE SET "v" = s."v"' in made["db2"].update()
    assert jdbc.quoted("mysql", "a`b") == "`a``b`" and jdbc.quoted("derby", 'a"b') == '"a""b"'


# --- replicas and periodic write-back

FEED = "bp long, seq int, op string, k long, v string"


def changes(spark, feed_dir, rows):
    spark.createDataFrame(rows, FEED).write.mode("append").parquet(feed_dir)


def test_replica_rewrites_touched_buckets_only(spark, tmp_path):
    feed, target, schema = str(tmp_path / "feed"), str(tmp_path / "replica"), spark.createDataFrame([], FEED).schema
    state = {}

    def run():
        rep.replicate(spark, feed, schema, ["k"], target, str(tmp_path / "check"), buckets=8).awaitTermination()
        got = {r["k"]: r["v"] for r in rep.current(spark, target, rep._values(schema)).collect()}
        assert got == state

    run_rows = [(i, 0, "I", i, "a") for i in range(200)]
    changes(spark, feed, run_rows)
    state |= {i: "a" for i in range(200)}
    run()
    folder = rep.Folder(spark, target)
    first = folder.manifest(folder.manifests()[-1])
    changes(spark, feed, [(300, 0, "M", 5, "b")])
    state[5] = "b"
    run()
    second = folder.manifest(folder.manifests()[-1])
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    (tmp_path / "replica" / "versions" / "99").mkdir()  # a version that is being written is not seen
    for n in range(4):
        changes(spark, feed, [(400 + n, 0, "D", 10 + n, None)])
        del state[10 + n]
        run()
    assert len(folder.manifests()) == rep.KEEP
    changes(spark, feed, [(500 + i, 0, "D", i, None) for i in state])
    state.clear()
    run()


def test_changes_are_applied_to_a_table_every_interval(spark, tmp_path):
    url, feed, schema = "jdbc:derby:memory:follow;create=true", str(tmp_path / "feed"), spark.createDataFrame([], FEED).schema
    jdbc.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), url, "F", keys=["k"])
    changes(spark, feed, [(1, 0, "M", 1, "x"), (2, 0, "D", 2, None), (3, 0, "I", 3, "c"), (4, 0, "M", 3, "d"), (5, 0, "M", 77, "none")])
    counts = []
    query = rep.follow_into_table(spark, feed, schema, ["k"], url, "F", str(tmp_path / "check"), interval_ms=200, counts=counts)
    try:
        query.processAllAvailable()
        changes(spark, feed, [(9, 0, "I", 9, "n")])
        query.processAllAvailable()
    finally:
        query.stop()
    assert counts == [{"D": 1, "M": 1, "I": 1, "failed": 1}, {"D": 0, "M": 0, "I": 1, "failed": 0}]
    assert sorted(map(tuple, jdbc.read_table(spark, "F", url, "F", ["k"]).data.collect())) == [(1, "x"), (3, "d"), (9, "n")]


# --- catalog and options


def test_catalog_file_is_checked(spark, tmp_path):
    spark.range(5).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "A"))

    def load(inner, attributes="phyType='file'"):
        (tmp_path / "c.xml").write_text(f"<d><dataSet {attributes}>{inner}</dataSet></d>")
        return lambda: Session(spark).catalog.load_xml(str(tmp_path / "c.xml"), str(tmp_path))

    table, keys = "<tableName>A</tableName>", "<keyColumns><column>k</column></keyColumns>"
    mysql = "phyType='mysql'"
    for inner, attributes, code in (("", "phyType='odd'", 109), (keys, "phyType='file'", 111), (table, "phyType='file'", 110), (table + keys, mysql, 112), (table + keys + "<connString>u</connString>", mysql, 113), (table + keys + "<connString>u</connString><dbUser>u</dbUser>", mysql, 114), (table + keys + "<indexes><index><indexType>Odd</indexType></index></indexes>", "phyType='file'", 115)):
        assert code_of(load(inner, attributes)) == code
    named = "<indexes><index name='own'><indexType>TreeMap</indexType><columns><column>k</column></columns></index></indexes>"
    (only,) = load(table + keys + named)()
    assert only.indexes == {"own": ("k",)}
    (tmp_path / "c.xml").write_text(f"<d><dataSet>{table}{keys}</dataSet><dataSet>{table}{keys}</dataSet></d>")
    assert code_of(lambda: Session(spark).catalog.load_xml(str(tmp_path / "c.xml"), str(tmp_path))) == 249


def test_local_mirror_and_options_act(spark, tmp_path):
    url = "jdbc:derby:memory:mirror;create=true"
    jdbc.write_table(spark.range(2500).withColumnRenamed("id", "k"), url, "M", keys=["k"])
    (tmp_path / "sets.xml").write_text(f"<d><dataSet phyType='derby'><tableName>M</tableName><connString>{url}</connString><storeLocal>true</storeLocal><keyColumns><column>k</column></keyColumns></dataSet></d>")
    (tmp_path / "p.ini").write_text("catalogFile = sets.xml\nfetchBatchRows = 500\n")
    session = open_session(spark, str(tmp_path / "p.ini"), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "M")).count() == 2500
    assert session.fetch("M").agg(F.max("batch")).first()[0] == 4
    (tmp_path / "q.ini").write_text("catalogFile = none.xml\n")
    assert code_of(lambda: open_session(spark, str(tmp_path / "q.ini"), str(tmp_path))) == 208
