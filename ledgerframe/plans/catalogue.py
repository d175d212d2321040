"""Named queries over the test tables, each with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..console import Console
from ..dataset import Dataset, dataset
from ..lineage import new_folder
from ..operators import change, index, read
from ..operators.join import join
from ..session import Session
from ..sources import files, jdbc
from ..streaming.replicate import append_changes, current, replicate
from . import versions

Query = Callable[[SparkSession, str], DataFrame]

#: Key columns of the test tables.
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "conversations": ["conv_id", "turn"],
}
INDEXES = {"events": {"by_type": ["event_type"], "by_user_time": ["user_id", "ts"]}, "orders": {"by_date": ["o_orderdate", "o_orderstatus"]}}

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def keyed(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    """A test table as a dataset; its key is checked where it is registered in
    a session, not in each query."""
    return dataset(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name], indexes=INDEXES.get(name), check=False)


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _get(name: str, table: str, criteria: str | None, where: str, select: list[str] | None = None) -> None:
    columns = ", ".join(select) if select else "*"
    _add(name, lambda spark, d: read.get(keyed(spark, d, table), criteria, select), f"SELECT {columns} FROM {table} WHERE {where}")


_get("get_full", "nation", None, "true")
_get("get_eq_string", "orders", 'o_orderstatus="F"', "o_orderstatus = 'F'")
_get("get_neq", "orders", 'o_orderstatus!="F"', "o_orderstatus <> 'F'")
_get("get_gt", "orders", 'o_totalprice>"300000"', "o_totalprice > 300000")
_get("get_lt", "orders", "o_totalprice < 5000.5", "o_totalprice < 5000.5")
_get("get_ge", "customer", "c_nationkey>=20", "c_nationkey >= 20")
_get("get_le", "customer", "c_acctbal<=0", "c_acctbal <= 0")
_get("get_int_compare", "part", 'p_size >= "20"', "p_size >= 20")
_get("get_long_key", "orders", 'o_orderkey="7"', "o_orderkey = 7")
_get("get_double", "customer", 'c_acctbal > "9000.0" and c_acctbal<"9100"', "c_acctbal > 9000 AND c_acctbal < 9100")
_get("get_timestamp", "orders", 'o_orderdate >= "1998-1-01 00:00:00"', "o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
_get("get_timestamp_range", "events", 'ts > "2024-1-10 00:00:00" and ts <= "2024-01-12 00:00:00"', "ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
_get("get_and", "orders", 'o_orderstatus="F" and o_totalprice>200000', "o_orderstatus = 'F' AND o_totalprice > 200000")
_get("get_or", "orders", 'o_orderstatus="P" OR o_totalprice>300000', "o_orderstatus = 'P' OR o_totalprice > 300000")
_get("get_nested", "orders", '(o_orderstatus="F" and (o_totalprice>200000 or o_orderpriority="5-LOW")) or o_orderpriority="1-URGENT"', "(o_orderstatus = 'F' AND (o_totalprice > 200000 OR o_orderpriority = '5-LOW')) OR o_orderpriority = '1-URGENT'")
_get("get_precedence", "orders", 'o_orderpriority="1-URGENT" or o_orderstatus="F" and o_totalprice>200000', "o_orderpriority = '1-URGENT' OR (o_orderstatus = 'F' AND o_totalprice > 200000)")
_get("get_ordinal_column", "orders", '2="F"', "o_orderstatus = 'F'")
_get("get_case_insensitive_column", "orders", 'O_ORDERSTATUS="F"', "o_orderstatus = 'F'")
_get("get_constant_true", "orders", 'x="x" and o_orderstatus="F"', "o_orderstatus = 'F'")
_get("get_constant_false", "orders", 'x="y"', "false")
_get("get_bad_literal", "orders", 'o_orderkey="abc" or o_orderstatus="F"', "o_orderstatus = 'F'")
_get("get_select", "orders", "o_totalprice>100000", "o_totalprice > 100000", ["o_orderkey", "o_totalprice"])
_get("index_range_scan", "events", 'user_id="3" and ts>="2024-01-05 00:00:00" and ts<"2024-01-25 00:00:00"', "user_id = 3 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'")
_get("full_key_scan_neq", "nation", 'n_nationkey!="3" and n_regionkey>"1"', "n_nationkey <> 3 AND n_regionkey > 1")

#: orders with nulls, for the null rules.
_NULLS_SQL = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_totalprice FROM orders)"


def orders_nulls(spark: SparkSession, sf_dir: str) -> Dataset:
    orders = keyed(spark, sf_dir, "orders")
    return orders.with_data(
        orders.data.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"), "o_totalprice")
    )


_add("get_null_neq", lambda s, d: read.get(orders_nulls(s, d), 'o_orderpriority!="1-URGENT"'), f"SELECT * FROM {_NULLS_SQL} WHERE o_orderpriority <> '1-URGENT'")
_add("get_null_eq", lambda s, d: read.get(orders_nulls(s, d), 'o_custkey="5" or o_orderpriority="2-HIGH"'), f"SELECT * FROM {_NULLS_SQL} WHERE o_custkey = 5 OR o_orderpriority = '2-HIGH'")
_add("point_get", lambda s, d: read.point_get(keyed(s, d, "orders"), {"O_ORDERKEY": 7}), "SELECT * EXCLUDE (o_orderkey) FROM orders WHERE o_orderkey = 7")
_add(
    "multi_get",
    lambda s, d: read.multi_get(keyed(s, d, "customer"), s.range(60).select(F.col("id").alias("position"), (F.col("id") * 40).alias("c_custkey"))),
    "SELECT k.position, k.c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT range AS position, range * 40 AS c_custkey FROM range(60)) k LEFT JOIN customer c ON k.c_custkey = c.c_custkey",
)
_add("index_postings_hash", lambda s, d: index.posting_counts(keyed(s, d, "events"), "by_type"), "SELECT event_type, count(*) AS n_keys, min(event_id) AS first_key, max(event_id) AS last_key FROM events GROUP BY event_type")
_add(
    "index_postings_tree",
    lambda s, d: index.posting_lists(keyed(s, d, "events"), "by_user_time").select("user_id", "ts", F.array_join(F.transform("keys", lambda k: k["event_id"].cast("string")), ",").alias("event_ids")),
    "SELECT user_id, ts, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS event_ids FROM events GROUP BY user_id, ts",
)
_add("index_only_scan", lambda s, d: index.postings(keyed(s, d, "orders"), "by_date"), "SELECT o_orderdate, o_orderstatus, o_orderkey FROM orders")


def _join(name: str, tables: tuple[str, str], on: str | None, mode: str, sql_on: str, criteria: tuple[str | None, str | None] = (None, None), where: tuple[str, str] = ("true", "true"), select: tuple[list[str] | None, list[str] | None] = (None, None), sources: tuple | None = None) -> None:
    kind = {"ON": "JOIN", "LEFTON": "LEFT JOIN", "RIGHTON": "RIGHT JOIN", "OUTON": "FULL JOIN"}[mode]

    def query(spark: SparkSession, d: str) -> DataFrame:
        a, b = (sources[i](spark, d) if sources and sources[i] else keyed(spark, d, tables[i]) for i in (0, 1))
        return join(a, b, on, mode, *criteria, *select)

    def side(i: int, prefix: str) -> str:
        source = _NULLS_SQL if sources and sources[i] else tables[i]
        columns = ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"] if sources and sources[i] else COLUMNS[tables[i]]
        return f"(SELECT {', '.join(f'{c} AS {prefix}{c}' for c in columns)} FROM {source} WHERE {where[i]})"

    names = ", ".join([*(f"l_{c}" for c in select[0] or ["*"]), *(f"r_{c}" for c in select[1] or [])]) if select[0] else "*"
    _add(name, query, f"SELECT {names} FROM {side(0, 'l_')} a {kind} {side(1, 'r_')} b ON {sql_on}")


#: Columns of the joined test tables, as given.
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}
_CO, _ON = ("customer", "orders"), ("c_custkey=o_custkey", "l_c_custkey = r_o_custkey")
_PRE, _PRE_SQL = ('c_acctbal>"5000"', 'o_totalprice>"250000"'), ("c_acctbal > 5000", "o_totalprice > 250000")
for _name, _mode in (("join_inner", "ON"), ("join_left", "LEFTON"), ("join_right", "RIGHTON"), ("join_full", "OUTON")):
    _join(_name, _CO, _ON[0], _mode, _ON[1], _PRE, _PRE_SQL)
_join("join_prefilter_outer", _CO, _ON[0], "LEFTON", _ON[1], (None, 'o_orderpriority="1-URGENT" and o_totalprice>300000'), ("true", "o_orderpriority = '1-URGENT' AND o_totalprice > 300000"))
_join("join_null_safe", ("orders", "orders"), "o_custkey=o_custkey and o_orderpriority=o_orderpriority", "ON", "l_o_custkey IS NOT DISTINCT FROM r_o_custkey AND l_o_orderpriority IS NOT DISTINCT FROM r_o_orderpriority", ('o_totalprice>"280000"', 'o_totalprice>"280000"'), ("o_totalprice > 280000",) * 2, sources=(orders_nulls, orders_nulls))
_join("join_theta_lt", ("nation", "region"), "n_regionkey<r_regionkey", "ON", "l_n_regionkey < r_r_regionkey")
_join("join_full_theta", ("nation", "region"), "n_regionkey<r_regionkey", "OUTON", "l_n_regionkey < r_r_regionkey")
_join("join_or_condition", ("nation", "supplier"), "n_nationkey=s_nationkey or n_regionkey=s_nationkey", "ON", "l_n_nationkey = r_s_nationkey OR l_n_regionkey = r_s_nationkey")
_join("join_multi_key", ("customer", "supplier"), "c_nationkey=s_nationkey and c_acctbal>=s_acctbal", "ON", "l_c_nationkey = r_s_nationkey AND l_c_acctbal >= r_s_acctbal", ('c_mktsegment="BUILDING"', None), ("c_mktsegment = 'BUILDING'", "true"))
_join("join_cross", ("nation", "region"), None, "ON", "true")
_join("join_self", ("nation", "nation"), "n_regionkey=n_regionkey", "ON", "l_n_regionkey = r_n_regionkey")
_join("join_select", _CO, _ON[0], "ON", _ON[1], (None, 'o_orderstatus="P"'), ("true", "o_orderstatus = 'P'"), (["c_name"], ["o_orderkey", "o_totalprice"]))
_join("join_ordinals", ("nation", "region"), "2=0", "ON", "l_n_regionkey = r_r_regionkey")


#: Whole tables with nulls for joins without criteria on a side. One customer's key is
#: null, so that null orders meet one row each and the join stays in proportion to them.
_NATION_NULLS_SQL = "(SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey END AS n_regionkey FROM nation)"
_REGION_NULLS_SQL = "(SELECT nullif(r_regionkey, 0) AS r_regionkey, r_name FROM region)"
_CUSTOMER_NULLS_SQL = "(SELECT nullif(c_custkey, 1) AS c_custkey, c_name FROM customer)"


def _join_whole_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = keyed(spark, sf_dir, "nation").data, keyed(spark, sf_dir, "region").data
    left = nation.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("n_regionkey"))
    right = region.select(F.when(F.col("r_regionkey") != 0, F.col("r_regionkey")).alias("r_regionkey"), "r_name")
    return join(dataset("nation", left, ["n_nationkey"], check=False), dataset("region", right, ["r_name"], check=False), "n_regionkey!=r_regionkey")


def _join_whole_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = keyed(spark, sf_dir, "customer").data.select(F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("c_custkey"), "c_name")
    return join(orders_nulls(spark, sf_dir), dataset("customer", customer, ["c_name"], check=False), "o_custkey=c_custkey")


_add(
    "join_theta_ne_null_whole",
    _join_whole_theta,
    f"SELECT a.n_nationkey AS l_n_nationkey, a.n_name AS l_n_name, a.n_regionkey AS l_n_regionkey, b.r_regionkey AS r_r_regionkey, b.r_name AS r_r_name FROM {_NATION_NULLS_SQL} a JOIN {_REGION_NULLS_SQL} b ON a.n_regionkey <> b.r_regionkey OR (a.n_regionkey IS NULL AND b.r_regionkey IS NULL)",
)
_SUPPLIER_NULLS_SQL = "(SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS s_nationkey FROM supplier)"


def _join_theta_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables: nation has 25 rows, so the nested loop grows with suppliers alone."""
    supplier = keyed(spark, sf_dir, "supplier").data.select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("s_nationkey"))
    nation = keyed(spark, sf_dir, "nation").data.select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("n_regionkey"))
    return join(dataset("supplier", supplier, ["s_suppkey"], check=False), dataset("nation", nation, ["n_nationkey"], check=False), "s_nationkey!=n_regionkey")


_add(
    "join_theta_ne_null",
    _join_theta_suppliers,
    f"SELECT a.s_suppkey AS l_s_suppkey, a.s_nationkey AS l_s_nationkey, b.n_nationkey AS r_n_nationkey, b.n_regionkey AS r_n_regionkey FROM {_SUPPLIER_NULLS_SQL} a JOIN {_NATION_NULLS_SQL} b ON a.s_nationkey <> b.n_regionkey OR (a.s_nationkey IS NULL AND b.n_regionkey IS NULL)",
)
_add(
    "join_null_safe_whole",
    _join_whole_null_safe,
    f"SELECT a.o_orderkey AS l_o_orderkey, a.o_custkey AS l_o_custkey, a.o_orderpriority AS l_o_orderpriority, a.o_totalprice AS l_o_totalprice, b.c_custkey AS r_c_custkey, b.c_name AS r_c_name FROM {_NULLS_SQL} a JOIN {_CUSTOMER_NULLS_SQL} b ON a.o_custkey IS NOT DISTINCT FROM b.c_custkey",
)


def _new_nations(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select((F.col("id") + 100).cast("int").alias("n_nationkey"), F.concat(F.lit("NEW"), F.col("id").cast("string")).alias("N_NAME"))


def _changed(name: str, table: str, what: Callable[[SparkSession, Dataset], change.Change], sql: str) -> None:
    _add(name, lambda spark, d: what(spark, keyed(spark, d, table)).dataset.data, sql)


def _some_keys(spark: SparkSession) -> DataFrame:
    return spark.range(0, 4000, 3).select(F.col("id").alias("c_custkey"))


_KEY_SET = "(SELECT range FROM range(0, 4000, 3))"
_changed("add_row", "nation", lambda s, d: change.add(d, _new_nations(s, 1)), "SELECT * FROM nation UNION ALL SELECT 100, 'NEW0', NULL")
_changed("batch_add", "nation", lambda s, d: change.add(d, _new_nations(s, 5)), "SELECT * FROM nation UNION ALL SELECT 100 + range, 'NEW' || range, NULL FROM range(5)")
_changed("modify_by_key", "customer", lambda s, d: change.modify(d, {"c_mktsegment": "NONE", "c_acctbal": 1.5}, keys=_some_keys(s)), f"SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey IN {_KEY_SET} THEN 1.5 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey IN {_KEY_SET} THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
_changed("modify_by_pred", "customer", lambda s, d: change.modify(d, {"C_MKTSEGMENT": "RICH"}, "c_acctbal>8000"), "SELECT * REPLACE (CASE WHEN c_acctbal > 8000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment) FROM customer")
_changed("modify_set_null", "customer", lambda s, d: change.modify(d, {"c_name": None}, 'c_mktsegment="BUILDING"'), "SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS c_name) FROM customer")
_changed("modify_key_change", "customer", lambda s, d: change.modify(d, {"c_custkey": F.col("c_custkey") + 1_000_000_000}, "c_acctbal<0"), "SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey) FROM customer")
_changed("remove_by_key", "orders", lambda s, d: change.remove(d, "o_orderkey=7"), "SELECT * FROM orders WHERE o_orderkey <> 7")
_changed("batch_remove", "customer", lambda s, d: change.remove(d, keys=_some_keys(s)), f"SELECT * FROM customer WHERE c_custkey NOT IN {_KEY_SET}")
_changed("remove_by_pred", "orders", lambda s, d: change.remove(d, 'o_orderstatus="F" or o_totalprice<50000'), "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)")
_add("remove_null_keeps", lambda s, d: change.remove(orders_nulls(s, d), 'o_orderpriority!="1-URGENT"').dataset.data, f"SELECT * FROM {_NULLS_SQL} WHERE NOT coalesce(o_orderpriority <> '1-URGENT', false)")
_add("remove_all", lambda s, d: change.remove(keyed(s, d, "nation")).dataset.data, "SELECT * FROM nation WHERE false")
_add(
    "modify_change_rows",
    lambda s, d: change.modify(keyed(s, d, "customer"), {"c_acctbal": 0.0}, "c_acctbal<0").log.select("op", "c_custkey", F.col("before.c_acctbal").alias("old"), F.col("after.c_acctbal").alias("new")),
    "SELECT 'M' AS op, c_custkey, c_acctbal AS old, CAST(0 AS DOUBLE) AS new FROM customer WHERE c_acctbal < 0",
)

#: events as a change feed: one key per user, removed if its last event is an error.
_FEED_SQL = """(SELECT event_id AS bp, 0 AS seq, user_id,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'I'
       WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type = 'error' THEN 'D' ELSE 'M' END AS op,
  value FROM events)"""


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = events.groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    op = F.when(F.col("event_id") == F.col("first"), "I").when((F.col("event_id") == F.col("last")) & (F.col("event_type") == "error"), "D").otherwise("M")
    return events.join(ends, "user_id").select(F.col("event_id").alias("bp"), F.lit(0).alias("seq"), op.alias("op"), "user_id", "value")


def _snapshot_sql(where: str, then: str = "true") -> str:
    return f"SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bp DESC, seq DESC) AS rn FROM {_FEED_SQL} f WHERE {where}) WHERE rn = 1 AND op <> 'D' AND {then}"


_add("snapshot_as_of", lambda s, d: versions.snapshot(change_feed(s, d), ["user_id"], 500), _snapshot_sql("bp <= 500"))
_add("snapshot_with_deletes", lambda s, d: versions.snapshot(change_feed(s, d), ["user_id"]), _snapshot_sql("true"))
_add("snapshot_filtered", lambda s, d: read.get(dataset("users", versions.snapshot(change_feed(s, d), ["user_id"], 700), ["user_id"], check=False), "value>20"), _snapshot_sql("bp <= 700", "value > 20"))
_NET = "(SELECT user_id, arg_min(op, bp) AS first, arg_max(op, bp) AS last, max(bp) AS bp, arg_max(value, bp) AS value FROM " + _FEED_SQL + " f GROUP BY user_id)"
_add(
    "log_compact",
    lambda s, d: versions.compact(change_feed(s, d), ["user_id"]),
    f"SELECT bp, 0 AS seq, CASE WHEN first = 'I' THEN 'I' WHEN last = 'D' THEN 'D' ELSE 'M' END AS op, user_id, value FROM {_NET} WHERE NOT (first = 'I' AND last = 'D')",
)
_add(
    "index_log_compact",
    lambda s, d: index.compact_index_log(s.read.parquet(f"{d}/events.parquet").select("event_type", "user_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("sign")), ["event_type", "user_id"]),
    "SELECT event_type, user_id, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS net FROM events GROUP BY ALL HAVING net <> 0",
)


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = change_feed(spark, sf_dir)
    return versions.replay(versions.snapshot(feed, ["user_id"], 400), feed, ["user_id"], 400)


_add("replay_recovery", _replay, _snapshot_sql("true"))


def _purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = change_feed(spark, sf_dir)
    base, rest = versions.purge(versions.snapshot(feed, ["user_id"], 200), feed, ["user_id"], 600, 200)
    return versions.replay(base, rest, ["user_id"], 600)


_add("purge_horizon", _purged, _snapshot_sql("true"))
_add("fetch_batches", lambda s, d: read.fetch_batches(keyed(s, d, "orders"), select=["o_orderkey"]), "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders")
_add("ordered_scan", lambda s, d: read.in_key_order(keyed(s, d, "conversations")), "SELECT * FROM conversations")
_add(
    "metadata",
    lambda s, d: read.metadata(keyed(s, d, "nation")),
    "SELECT * FROM (VALUES (0, 'n_nationkey', 'int', 0, false), (1, 'n_name', 'string', NULL, true), (2, 'n_regionkey', 'int', NULL, true)) t(id, name, type, key_position, nullable)",
)
_add("dataset_list", lambda s, d: read.dataset_list(s, [keyed(s, d, n) for n in ("region", "nation")]), "SELECT * FROM (VALUES ('nation', 'n_nationkey', 3), ('region', 'r_regionkey', 2)) t(dataset, key_columns, n_columns)")
_SIZE_SQL = "CAST(sum(coalesce(4 + strlen(CAST({} AS VARCHAR)), 0)) AS BIGINT)"
_add("dataset_size", lambda s, d: read.dataset_size(keyed(s, d, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"]), "SELECT 'orders' AS dataset, " + " + ".join(_SIZE_SQL.format(c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")) + " AS bytes FROM orders")
_add(
    "db_size",
    lambda s, d: read.database_size([keyed(s, d, n) for n in ("region", "nation")]),
    "SELECT CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT " + " + ".join(_SIZE_SQL.format(c) for c in COLUMNS["region"]) + " AS bytes FROM region UNION ALL SELECT " + " + ".join(_SIZE_SQL.format(c) for c in COLUMNS["nation"]) + " FROM nation)",
)
_add("entry_count", lambda s, d: read.entry_count(keyed(s, d, "events")), "SELECT count(*) AS entries FROM events")


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark) + "/customer"
    files.copy_to(keyed(spark, sf_dir, "customer"), path)
    return files.read_parquet(spark, "copy", path, ["c_custkey"]).data


_add("copy_roundtrip", _copied, "SELECT * FROM customer")


def _jdbc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = f"jdbc:derby:memory:t{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString().replace('-', '')};create=true"
    jdbc.write_table(keyed(spark, sf_dir, "nation").data, url, "NATION")
    loaded = jdbc.read_table(spark, "NATION", url, "NATION", ["n_nationkey"])
    for made in (lambda d: change.modify(d, {"n_name": "X"}, "n_regionkey=1"), lambda d: change.remove(d, "n_regionkey=2"), lambda d: change.add(d, _new_nations(spark, 2))):
        jdbc.write_back(spark, made(jdbc.read_table(spark, "NATION", url, "NATION", ["n_nationkey"])), url, "NATION")
    return loaded.data


_add("jdbc_roundtrip", _jdbc_roundtrip, "SELECT * REPLACE (CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name) FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100 + range, 'NEW' || range, NULL FROM range(2)")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark)
    feed = change_feed(spark, sf_dir)
    target = feed.select("user_id", "value").schema
    for low, high in ((0, 300), (300, 2**62)):
        append_changes(feed.filter((F.col("bp") >= low) & (F.col("bp") < high)), f"{at}/feed", ["user_id"])
        replicate(spark, f"{at}/feed", feed.select("bp", "seq", "op", "user_id", "value").schema, ["user_id"], f"{at}/replica", f"{at}/checkpoint").awaitTermination()
    return current(spark, f"{at}/replica", target)


_add("stream_replicate", _streamed, _snapshot_sql("true"))


def _by_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark)
    for name in ("customer", "orders"):
        session.catalog.register(lambda n=name: keyed(spark, sf_dir, n))
    console = Console(session)
    console.run('remove from ORDERS with {o_orderstatus="F"}')
    console.run("modify {o_orderpriority:NONE} in orders with {o_totalprice>300000}")
    return console.run('join @value from customer with {c_acctbal>"9000"} orders with {} LEFTON {c_custkey=o_custkey}')


_add(
    "console_commands",
    _by_command,
    "SELECT * FROM (SELECT " + ", ".join(f"{c} AS l_{c}" for c in COLUMNS["customer"]) + " FROM customer WHERE c_acctbal > 9000) a LEFT JOIN (SELECT " + ", ".join(f"{c} AS r_{c}" for c in COLUMNS["orders"][:5]) + ", CASE WHEN o_totalprice > 300000 THEN 'NONE' ELSE o_orderpriority END AS r_o_orderpriority FROM orders WHERE o_orderstatus <> 'F') b ON l_c_custkey = r_o_custkey",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent or large finished orders."""
    return read.get(keyed(spark, sf_dir, "orders"), '(o_orderstatus="F" and o_totalprice>200000) or o_orderpriority="1-URGENT"')


_add("flagship", flagship, "SELECT * FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR o_orderpriority = '1-URGENT'")
