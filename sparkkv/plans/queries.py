"""The engine's own queries and, where SQL can say the same, that SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as X
from ..operators import aggregate, joins, stats
from ..operators.geoindex import GeoIndex, GeoManager
from ..operators.secindex import Catalog, Index, add_entries, remove_entries
from ..operators.store import Bound, KVStore
from ..sources import oplog
from ..sources.adapters import StoreSpec, TextKey, read_table
from ..streaming import feed
from . import predicates as P
from .sqlfront import SqlError, SqlSession

ORDER_KEY = TextKey("o_orderkey", "order:", 7)
#: Milliseconds at which the deadline of event 0 is reached.
FIRST_MS = 1704067200000 + 600000
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def orders(s: SparkSession, d: str, value: str = "o_totalprice") -> KVStore:
    return KVStore.over(read_table(s, d, "orders"), StoreSpec("o_orderkey", value))


def text_orders(s: SparkSession, d: str, value: str = "o_orderstatus") -> KVStore:
    return KVStore.over(read_table(s, d, "orders"), StoreSpec(ORDER_KEY, value))


def customers(s: SparkSession, d: str, value: str = "c_mktsegment") -> KVStore:
    return KVStore.over(read_table(s, d, "customer"), StoreSpec("c_name", value))


def parts(s: SparkSession, d: str) -> KVStore:
    return KVStore.over(read_table(s, d, "part"), StoreSpec(TextKey("p_partkey", "", 7), "p_name"))


def sql_session(s: SparkSession, d: str) -> SqlSession:
    numeric = read_table(s, d, "orders").withColumn("cust", F.col("o_custkey").cast("string"))
    return SqlSession(s, {"orders": text_orders(s, d), "order_cust": KVStore.over(numeric, StoreSpec(ORDER_KEY, "cust")), "customer": customers(s, d), "part": parts(s, d)})


def ops(s: SparkSession, d: str) -> DataFrame:
    """The events as a log of operations."""
    kind = F.col("event_type")
    op = F.when(kind == "error", "delete").when(kind == "signup", "ttl_set").when(kind == "view", "tag").when((kind == "click") & (F.col("event_id") % 5 == 0), "untag").otherwise("put")
    value = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return read_table(s, d, "events").select(
        F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), value.alias("value"), (F.col("event_id") % 7).alias("tag"), (F.col("event_id") * 1000 + 1704067200000 + 600000).alias("expires_at_ms")
    )


def clock(s: SparkSession, d: str) -> int:
    """A time between the deadlines that are set at the end: some are reached, others are not, at every scale."""
    return FIRST_MS + read_table(s, d, "events").agg(F.max("event_id")).first()[0] * 97 // 100 * 1000


CLOCK = f"(SELECT CAST({FIRST_MS} + max(event_id) * 97 // 100 * 1000 AS BIGINT) FROM events)"
OPS = """ops AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'ttl_set' WHEN event_type = 'view' THEN 'tag'
  WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'untag' ELSE 'put' END AS op, 'user:' || CAST(user_id AS VARCHAR) AS key, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value,
  event_id % 7 AS tag, 1704067200000 + event_id * 1000 + 600000 AS expires_at_ms FROM events),
entries AS (SELECT key, arg_max(value, seq) AS value FROM ops WHERE op IN ('put', 'delete') GROUP BY key HAVING arg_max(op, seq) = 'put'),
died AS (SELECT key, max(CASE WHEN op = 'delete' THEN seq ELSE -1 END) AS died FROM ops WHERE op IN ('put', 'delete') GROUP BY key),
born AS (SELECT o.key, min(o.seq) AS born FROM ops o JOIN died d ON o.key = d.key JOIN entries e ON e.key = o.key WHERE o.op = 'put' AND o.seq > d.died GROUP BY o.key),
tags AS (SELECT o.key, o.tag FROM ops o JOIN born b ON o.key = b.key WHERE o.op IN ('tag', 'untag') AND o.seq > b.born GROUP BY o.key, o.tag HAVING arg_max(o.op, o.seq) = 'tag'),
ttls AS (SELECT o.key, arg_max(o.expires_at_ms, o.seq) AS expires_at_ms FROM ops o JOIN born b ON o.key = b.key WHERE o.op IN ('ttl_set', 'ttl_remove') AND o.seq > b.born GROUP BY o.key HAVING arg_max(o.op, o.seq) = 'ttl_set')"""
KEY_SQL = "'order:' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')"
LAT, LON = "(((c_custkey * 7919) % 18001) / 100.0 - 90)", "(((c_custkey * 104729) % 36001) / 100.0 - 180)"


def points(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return read_table(s, d, "customer").select(c.alias("key"), ((c * 7919 % 18001) / 100.0 - 90).alias("lat"), ((c * 104729 % 36001) / 100.0 - 180).alias("lon"))


def distance_sql(lat: float, lon: float) -> str:
    a = f"(pow(sin((radians({LAT}) - radians({lat})) / 2), 2) + cos(radians({lat})) * cos(radians({LAT})) * pow(sin(radians({LON} - ({lon})) / 2), 2))"
    return f"(12742000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


# lookups and scans


@query("kv_point_get", "SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey = 42")
def _(s, d):
    return orders(s, d).get(42)


MGET = "(VALUES (0, 7), (1, 3), (2, 99999999), (3, 7), (4, 12)) AS k(pos, key)"


def asked(s):
    return s.createDataFrame([(0, 7), (1, 3), (2, 99999999), (3, 7), (4, 12)], "pos int, key bigint")


@query("kv_multi_get", f"SELECT pos, key, o_totalprice AS value FROM {MGET} LEFT JOIN orders ON o_orderkey = key")
def _(s, d):
    return orders(s, d).multi_get(asked(s))


@query("kv_exists_count", f"SELECT count(*) AS found FROM {MGET} JOIN orders ON o_orderkey = key")
def _(s, d):
    return orders(s, d).exists_count(asked(s))


@query("kv_range_inclusive", "SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def _(s, d):
    return orders(s, d).range(Bound(100), Bound(200))


@query("kv_range_exclusive", "SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey > 100 AND o_orderkey < 200")
def _(s, d):
    return orders(s, d).range(Bound(100, False), Bound(200, False))


@query("kv_range_unbounded", "SELECT o_orderkey AS key, o_totalprice AS value FROM orders")
def _(s, d):
    return orders(s, d).scan()


@query("kv_range_unordered", "SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 500")
def _(s, d):
    return orders(s, d).range_unordered(Bound(500)).pairs()


@query("kv_range_text_key", f"SELECT {KEY_SQL} AS key, o_orderstatus AS value FROM orders WHERE {KEY_SQL} >= 'order:0000100' AND {KEY_SQL} < 'order:0000300'")
def _(s, d):
    return text_orders(s, d).range(Bound("order:0000100"), Bound("order:0000300", False))


@query("kv_range_filter_limit", "SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey BETWEEN 1000 AND 20000 AND o_orderkey % 3 = 0 ORDER BY 1 LIMIT 128")
def _(s, d):
    return orders(s, d).range_unordered(Bound(1000), Bound(20000)).filter(F.col("key") % 3 == 0).limit(128)


@query("kv_python_predicate", "SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 7 = 1")
def _(s, d):
    return orders(s, d).filter(lambda k, v: k % 7 == 1).pairs()


@query("kv_find_by_value", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(s, d):
    return customers(s, d).find_by_value("BUILDING")


@query("kv_value_like", "SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS key, p_name AS value FROM part WHERE p_name LIKE '%a_%e%'")
def _(s, d):
    return parts(s, d).find_by_value_like("%a_%e%")


@query("kv_value_in", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(s, d):
    return customers(s, d).filter(P.In("value", ("BUILDING", "MACHINERY", "BUILDING"))).pairs()


@query("kv_key_like", f"SELECT {KEY_SQL} AS key, o_orderstatus AS value FROM orders WHERE {KEY_SQL} LIKE 'order:0000_1%'")
def _(s, d):
    return text_orders(s, d).filter(P.Like("key", "order:0000_1%")).pairs()


@query("kv_where_and_or_not", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_mktsegment > 'HOUSE') AND NOT c_name LIKE '%3' AND c_mktsegment <> 'MACHINERY'")
def _(s, d):
    c = (P.Compare("value", "=", "BUILDING") | P.Compare("value", ">", "HOUSE")) & ~P.Like("key", "%3") & P.Compare("value", "!=", "MACHINERY")
    return customers(s, d).filter(c).pairs()


@query("kv_between_reversed_empty", f"SELECT {KEY_SQL} AS key, o_orderstatus AS value FROM orders WHERE {KEY_SQL} BETWEEN 'z' AND 'a' OR o_orderkey <= 3")
def _(s, d):
    return text_orders(s, d).filter(P.Between("key", "z", "a") | P.Compare("key", "<=", "order:0000003")).pairs()


@query("kv_glob_keys", f"SELECT {KEY_SQL} AS key FROM orders WHERE regexp_full_match({KEY_SQL}, 'order:00.01.*')")
def _(s, d):
    return text_orders(s, d).keys("order:00?01*")


@query("kv_json_contains", "SELECT event_id AS key FROM events WHERE contains(json_extract_string(json_object('username', event_type, 'k', event_id), '$.username'), 'ic')")
def _(s, d):
    doc = F.to_json(F.struct(F.col("event_type").alias("username"), F.col("event_id").alias("k")))
    return read_table(s, d, "events").where(X.json_field_contains(doc, "ic")).select(F.col("event_id").alias("key"))


@query("kv_json_number_is_no_string", "SELECT count(*) AS n FROM events WHERE false")
def _(s, d):
    return read_table(s, d, "events").where(X.json_field_contains(F.col("props"), "1", "$.k")).agg(F.count("*").alias("n"))


@query("kv_page", "SELECT o_orderkey AS key, o_orderstatus AS value, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN 50 AND 900) AS total FROM orders WHERE o_orderkey BETWEEN 50 AND 900 ORDER BY 1 LIMIT 20")
def _(s, d):
    results, total = orders(s, d, "o_orderstatus").page(50, 900, 20)
    return results.join(F.broadcast(total))


@query("kv_count", "SELECT count(*) AS n FROM orders")
def _(s, d):
    return orders(s, d).count()


@query("text_display", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'plain ' || event_type END AS shown FROM events")
def _(s, d):
    stored = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(F.concat(F.lit("plain "), F.col("event_type")))
    return read_table(s, d, "events").select("user_id", X.display_text(stored).alias("shown"))


@query("text_numbers", "SELECT p_partkey, coalesce(TRY_CAST(CASE WHEN regexp_full_match(p_brand[7:], '[0-9]+') THEN p_brand[7:] END AS DOUBLE), 0.0) AS n FROM part")
def _(s, d):
    return read_table(s, d, "part").select("p_partkey", X.number(F.expr("substring(p_brand, 7)")).alias("n"))


@query("binary_round_trip", "SELECT doc_id, text AS back FROM documents")
def _(s, d):
    wrapped = X.wrap_binary(F.col("text").cast("binary"))
    return read_table(s, d, "documents").select("doc_id", X.unwrap_binary(wrapped).cast("string").alias("back"))


# the SQL dialect


def dialect(name: str, text: str, oracle: str):
    @query(name, oracle)
    def _(s, d):
        return sql_session(s, d).execute(text).df


dialect("sql_count", "SELECT COUNT(*) AS n FROM order_cust WHERE key > 'order:0000500'", f"SELECT count(*) AS n FROM orders WHERE {KEY_SQL} > 'order:0000500'")
dialect("sql_sum", "SELECT SUM(value) AS total FROM order_cust", "SELECT CAST(sum(o_custkey) AS DOUBLE) AS total FROM orders")
dialect("sql_avg", "SELECT AVG(value) AS mean FROM order_cust WHERE key <= 'order:0000999'", f"SELECT avg(CAST(o_custkey AS DOUBLE)) AS mean FROM orders WHERE {KEY_SQL} <= 'order:0000999'")
dialect("sql_min_max", "SELECT MIN(value) AS low, MAX(value) AS high FROM order_cust", "SELECT CAST(min(o_custkey) AS DOUBLE) AS low, CAST(max(o_custkey) AS DOUBLE) AS high FROM orders")
dialect("sql_sum_nonnumeric_zero", "SELECT SUM(value) AS total, AVG(value) AS mean, MIN(value) AS low FROM customer", "SELECT 0.0::DOUBLE AS total, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS low")
dialect("sql_empty_aggregates", "SELECT SUM(value) AS total, AVG(value) AS mean, COUNT(*) AS n FROM customer WHERE key = 'nobody'", "SELECT 0.0::DOUBLE AS total, NULL::DOUBLE AS mean, 0::BIGINT AS n")
dialect("sql_distinct", "SELECT DISTINCT value FROM customer", "SELECT DISTINCT c_mktsegment AS value FROM customer")
dialect("sql_order_limit_offset", "SELECT key, value FROM orders ORDER BY value DESC, key LIMIT 25 OFFSET 10", f"SELECT {KEY_SQL} AS key, o_orderstatus AS value FROM orders ORDER BY 2 DESC, 1 LIMIT 25 OFFSET 10")
dialect("sql_offset_only", "SELECT key FROM orders ORDER BY key OFFSET 1200", f"SELECT {KEY_SQL} AS key FROM orders ORDER BY 1 OFFSET 1200")
dialect("sql_top", "SELECT TOP (7) key FROM orders ORDER BY key DESC LIMIT 9", f"SELECT {KEY_SQL} AS key FROM orders ORDER BY 1 DESC LIMIT 7")
dialect("sql_where", "SELECT * FROM customer WHERE 'BUILDING' = value OR value NOT IN ('BUILDING', 'MACHINERY') AND NOT (key LIKE '%1' OR key BETWEEN 'Customer#000000100' AND 'Customer#000000300')", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND NOT (c_name LIKE '%1' OR c_name BETWEEN 'Customer#000000100' AND 'Customer#000000300')")
dialect("sql_join", "SELECT a.key, a.value AS status, b.value AS cust FROM orders a JOIN order_cust b ON a.key = b.key WHERE a.value = 'F' ORDER BY a.key LIMIT 200", f"SELECT {KEY_SQL} AS key, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS cust FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 200")
SQL["sql_join"] = f'SELECT {KEY_SQL} AS "a.key", o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS cust FROM orders WHERE o_orderstatus = \'F\' ORDER BY 1 LIMIT 200'
dialect("sql_group_ext", "SELECT value, COUNT(*) AS n FROM orders GROUP BY value HAVING COUNT(*) > 1 ORDER BY n DESC, value", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")


@query("sql_mutations", f"SELECT key, value FROM (SELECT {KEY_SQL} AS key, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey <> 5 AND NOT (o_orderstatus = 'P' AND {KEY_SQL} > 'order:0000700')) UNION ALL SELECT * FROM (VALUES ('order:0000005', 'two'), ('order:x', 'new'))")
def _(s, d):
    session = sql_session(s, d)
    session.execute("INSERT INTO orders (key, value) VALUES ('order:0000005', 'one'), ('order:x', 'new'), ('order:0000005', 'two')")
    session.execute("UPDATE orders SET value = 'done' WHERE value = 'F'")
    session.execute("DELETE FROM orders WHERE value = 'P' AND key > 'order:0000700'")
    return session.execute("SELECT * FROM orders").df


# aggregates


@query("range_count", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 10 AND 2000 AND l_quantity > 25")
def _(s, d):
    items = KVStore.over(read_table(s, d, "lineitem"), StoreSpec("l_orderkey", "l_quantity"))
    return items.range_unordered(Bound(10), Bound(2000)).filter(F.col("value") > 25).aggregate_count()


@query("range_sum", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem WHERE l_orderkey BETWEEN 10 AND 2000")
def _(s, d):
    items = KVStore.over(read_table(s, d, "lineitem"), StoreSpec("l_orderkey", "l_extendedprice"))
    return items.range_unordered(Bound(10), Bound(2000)).aggregate_sum(F.col("value").cast("decimal(18,2)")).select(F.col("total").cast("double").alias("total"))


@query("group_aggregates", "SELECT l_returnflag AS \"group\", count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, round(avg(l_quantity), 6) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def _(s, d):
    qty = F.col("l_quantity")
    return aggregate.Aggregator(read_table(s, d, "lineitem"), "l_returnflag").agg(n=F.count("*"), total=F.sum(qty.cast("decimal(18,2)")).cast("double"), mean=F.round(F.avg(qty), 6), low=F.min("l_extendedprice"), high=F.max("l_extendedprice"))


@query("group_collect", "SELECT event_type AS \"group\", string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY 1")
def _(s, d):
    rows = aggregate.Aggregator(read_table(s, d, "events"), "event_type").groups("event_id")
    return rows.select("group", F.concat_ws(",", F.transform("rows", lambda r: r["event_id"].cast("string"))).alias("ids"))


@query("group_custom_agg", "SELECT user_id AS \"group\", CAST(max(event_id) - min(event_id) AS BIGINT) AS result FROM events GROUP BY 1")
def _(s, d):
    return aggregate.Aggregator(read_table(s, d, "events"), "user_id").aggregate(lambda v: int(v.max() - v.min()), "bigint", F.col("event_id"))


@query("selectivity", "SELECT round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 9) AS selectivity FROM lineitem")
def _(s, d):
    return aggregate.selectivity(read_table(s, d, "lineitem"), F.col("l_discount") > 0.05).select(F.round("selectivity", 9).alias("selectivity"))


# joins


@query("hash_join_engines", "SELECT c_custkey AS join_key, c_custkey AS left_key, c_mktsegment AS left_value, o_orderkey AS right_key, o_custkey AS right_value FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey <= 1000 AND o_orderkey > 100")
def _(s, d):
    left = KVStore.over(read_table(s, d, "customer"), StoreSpec("c_custkey", "c_mktsegment"))
    return joins.hash_join(left, orders(s, d, "o_custkey"), F.col("key"), F.col("value"), (Bound(), Bound(1000)), (Bound(100, False), Bound()))


@query("build_probe_join", "SELECT n_nationkey AS key, n_name AS \"left\", s_suppkey AS \"right\" FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def _(s, d):
    return joins.build_probe(read_table(s, d, "nation").selectExpr("n_nationkey key", "n_name `left`"), read_table(s, d, "supplier").selectExpr("s_nationkey key", "s_suppkey `right`"))


@query("self_join_on_key", "SELECT a.n_nationkey AS a_key, a.n_name AS a_value, b.n_nationkey AS b_key, b.n_name AS b_value FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
def _(s, d):
    return joins.self_join(KVStore.over(read_table(s, d, "nation"), StoreSpec("n_nationkey", "n_name")))


@query("tag_semi_join", "SELECT o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey % 7 = 3")
def _(s, d):
    tags = read_table(s, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 7).alias("tag"))
    return joins.tag_semi_join(orders(s, d, "o_orderstatus"), tags, 3)


@query("tagged_values", "SELECT o_orderstatus AS value FROM orders WHERE o_orderkey % 7 = 3")
def _(s, d):
    tags = read_table(s, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 7).alias("tag"))
    return orders(s, d, "o_orderstatus").tagged(tags, 3)


# the log of operations


def fold(name: str, sql: str, timed: bool = False):
    """A query over the log; ``timed`` gives it the clock too."""

    def add(fn):
        query(name, f"WITH {OPS} {sql}")(lambda s, d: fn(ops(s, d), clock(s, d)) if timed else fn(ops(s, d)))
        return fn

    return add


fold("upsert_latest", "SELECT key, value FROM entries")(oplog.entries)
fold("tag_fold", "SELECT key, tag FROM tags")(oplog.tags)
fold("ttl_fold", "SELECT key, expires_at_ms FROM ttls")(oplog.ttls)
fold("ttl_visible", f"SELECT key, value FROM entries WHERE key NOT IN (SELECT key FROM ttls WHERE expires_at_ms <= {CLOCK})", True)(lambda o, now: oplog.visible(o, now))
fold("entries_as_of", "SELECT key, arg_max(value, seq) AS value FROM ops WHERE op IN ('put', 'delete') AND seq <= 700 GROUP BY key HAVING arg_max(op, seq) = 'put'")(lambda o: oplog.entries(o, 700))
fold("ttl_read", f"SELECT k.key, CAST(CASE WHEN e.key IS NULL OR t.expires_at_ms <= {CLOCK} THEN -2 WHEN t.key IS NULL THEN -1 ELSE floor((t.expires_at_ms - {CLOCK}) / 1000.0) END AS BIGINT) AS ttl FROM (SELECT DISTINCT key FROM ops) k LEFT JOIN entries e ON k.key = e.key LEFT JOIN ttls t ON k.key = t.key", True)(
    lambda o, now: oplog.ttl_read(o.select("key").distinct(), o, now)
)
fold("ttl_sweep", f"SELECT key FROM ttls WHERE expires_at_ms <= {CLOCK}", True)(lambda o, now: oplog.sweep(o, now, 1 << 40).select("key"))
fold("ttl_stats", f"SELECT count(*) AS keys_with_ttl, greatest(min(expires_at_ms) - {CLOCK}, 0) AS next_expiry_ms FROM ttls WHERE expires_at_ms > {CLOCK}", True)(lambda o, now: stats.ttl_stats(oplog.rearmed(o, now), now))
fold("replication_since", "SELECT seq, op, key FROM ops WHERE seq >= 900")(lambda o: oplog.changes(o, 900).select("seq", "op", "key"))
fold("replication_apply", "SELECT seq, op, key FROM ops")(lambda o: oplog.apply_changes(o.where("seq < 500"), o.where("seq >= 300")).select("seq", "op", "key"))
fold("recovery_stats", "SELECT op, count(*) AS n FROM ops GROUP BY op")(stats.recovery_stats)
fold("put_previous", "SELECT DISTINCT o.key, e.value AS previous FROM ops o LEFT JOIN entries e ON o.key = e.key")(lambda o: oplog.put_returning(o, o.select("key", "value")))
fold("delete_count", "SELECT count(*) AS removed FROM entries WHERE key < 'user:2'")(lambda o: oplog.delete_count(o, o.select("key").where("key < 'user:2'")))
fold("incr_fold", "SELECT o.key, CAST(CAST(coalesce(any_value(e.value), '0') AS BIGINT) + count(*) AS VARCHAR) AS value FROM (SELECT DISTINCT key, seq FROM ops WHERE op = 'tag') o LEFT JOIN (SELECT key, arg_max(value, seq) AS value, max(seq) AS at FROM ops WHERE op = 'put' GROUP BY key) e ON o.key = e.key WHERE o.seq > coalesce(e.at, -1) GROUP BY o.key")(
    lambda o: oplog.entries(o.where("op in ('put', 'tag')").selectExpr("seq", "if(op = 'tag', 'incr', op) op", "key", "if(op = 'tag', '1', value) value")).join(o.where("op in ('put', 'tag')").groupBy("key").agg(F.max_by("op", "seq").alias("op")).where("op = 'tag'"), "key", "left_semi")
)
fold("lru_victims", "SELECT key, row_number() OVER (ORDER BY last, key) AS rank FROM (SELECT key, max(seq) AS last FROM ops GROUP BY key) ORDER BY rank LIMIT 10")(lambda o: stats.victims(o, "lru", 10))
fold("lfu_victims", "SELECT key, row_number() OVER (ORDER BY uses, last, key) AS rank FROM (SELECT key, count(*) AS uses, max(seq) AS last FROM ops GROUP BY key) ORDER BY rank LIMIT 10")(lambda o: stats.victims(o, "lfu", 10))
fold("volatile_lru_victims", "SELECT o.key, row_number() OVER (ORDER BY max(o.seq), o.key) AS rank FROM ops o JOIN ttls t ON o.key = t.key GROUP BY o.key ORDER BY rank LIMIT 10")(lambda o: stats.victims(o, "volatile_lru", 10, oplog.ttls(o)))
fold("metrics", "SELECT count(*) FILTER (op = 'tag') AS gets, count(*) FILTER (op = 'put') AS puts, count(*) FILTER (op = 'delete') AS deletes, count(*) FILTER (op = 'tag' AND tag <> 0) / count(*) FILTER (op = 'tag') AS hit_rate, sum(seq) FILTER (op = 'tag') // count(*) FILTER (op = 'tag') AS get_nanos, sum(seq) FILTER (op = 'put') // count(*) FILTER (op = 'put') AS put_nanos, sum(seq) FILTER (op = 'delete') // count(*) FILTER (op = 'delete') AS delete_nanos FROM ops")(
    lambda o: stats.metrics(o.select(F.when(F.col("op") == "tag", "get").otherwise(F.col("op")).alias("op"), (F.col("tag") != 0).alias("hit"), F.col("seq").alias("nanos")))
)
SQL["metrics"] = SQL["metrics"].replace("sum(seq) FILTER", "CAST(sum(seq) FILTER").replace(") // count", ") AS BIGINT) // count")


def shared_folder(s: SparkSession) -> str:
    """A new folder that executors share: under spark.checkpoint.dir, or one of this process where none is named (tests). It goes when the session's process ends; until then a result may read it."""
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not s.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "root" not in _own:
            _own["root"] = tempfile.mkdtemp(prefix="store-")
            atexit.register(shutil.rmtree, _own["root"], True)
        root = f"file://{_own['root']}"
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/store-{uuid.uuid4().hex}")
    fs = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return str(path.toString())


_own: dict[str, str] = {}


@query("recover_equals_fold", f"WITH {OPS} SELECT e.key, e.value, t.expires_at_ms, (SELECT count(*) FROM tags g WHERE g.key = e.key) AS n_tags FROM entries e LEFT JOIN ttls t ON e.key = t.key")
def _(s, d):
    log, all_ops = oplog.OpLog(s, shared_folder(s)), ops(s, d)
    middle = all_ops.agg((F.max("seq") / 2).cast("bigint")).first()[0]
    log.append(all_ops.where(F.col("seq") <= middle))
    log.snapshot()
    log.append(all_ops.where(F.col("seq") > middle))
    state = log.state()
    n = oplog.tags(state).groupBy("key").agg(F.count("*").alias("n_tags"))
    return oplog.entries(state).join(oplog.ttls(state), "key", "left").join(n, "key", "left").select("key", "value", "expires_at_ms", F.coalesce("n_tags", F.lit(0)).alias("n_tags"))


@query("update_by_value", "SELECT c_name AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS value, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS affected FROM customer")
def _(s, d):
    new, n = customers(s, d).update_by_value("BUILDING", "HOUSES")
    return new.pairs().join(F.broadcast(n))


@query("delete_by_value", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(s, d):
    return customers(s, d).delete_by_value("BUILDING")[0].pairs()


@query("bulk_upsert", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS value FROM orders UNION ALL SELECT -1, 'neg'")
def _(s, d):
    store = orders(s, d, "o_orderstatus")
    batch = store.pairs().where("key % 5 = 0").selectExpr("1 seq", "key", "'old' value").unionByName(store.pairs().where("key % 5 = 0").selectExpr("2 seq", "key", "'new' value")).unionByName(s.createDataFrame([(1, -1, "neg")], "seq int, key bigint, value string"))
    return store.upsert(batch).pairs()


# space


@query("geo_haversine", f"SELECT c_custkey AS key, round({distance_sql(40.7128, -74.006)}, 3) AS metres FROM customer")
def _(s, d):
    return points(s, d).select("key", F.round(geo.haversine(F.lit(40.7128), F.lit(-74.006), F.col("lat"), F.col("lon")), 3).alias("metres"))


def _geohash_sql(precision: int) -> str:
    bits = 5 * precision
    a, b = (bits + 1) // 2, bits // 2
    x = f"least(CAST(floor(({LON} + 180) / 360.0 * {1 << a}) AS BIGINT), {(1 << a) - 1})"
    y = f"least(CAST(floor(({LAT} + 90) / 180.0 * {1 << b}) AS BIGINT), {(1 << b) - 1})"
    chars = []
    for c in range(precision):
        place = " + ".join(f"((({x if i % 2 == 0 else y}) >> {(a if i % 2 == 0 else b) - 1 - i // 2}) & 1) * {16 >> k}" for k, i in enumerate(range(5 * c, 5 * c + 5)))
        chars.append(f"substr('{geo.ALPHABET}', CAST({place} AS BIGINT) + 1, 1)")
    return " || ".join(chars)


@query("geo_geohash", f"SELECT c_custkey AS key, {_geohash_sql(6)} AS cell FROM customer")
def _(s, d):
    return GeoIndex(points(s, d)).cells()


@query("geo_radius", f"SELECT c_custkey AS key, round({distance_sql(51.5074, -0.1278)}, 3) AS metres FROM customer WHERE {distance_sql(51.5074, -0.1278)} <= 2500000")
def _(s, d):
    return GeoIndex(points(s, d)).radius(51.5074, -0.1278, 2_500_000).select("key", F.round("metres", 3).alias("metres"))


@query("geo_bbox", f"SELECT c_custkey AS key FROM customer WHERE {LAT} BETWEEN 10 AND 60 AND {LON} BETWEEN -30 AND 45")
def _(s, d):
    return GeoIndex(points(s, d)).box(10, -30, 60, 45)


@query("geo_knn", f"SELECT c_custkey AS key, round({distance_sql(42.3601, -71.0589)}, 3) AS metres FROM customer ORDER BY {distance_sql(42.3601, -71.0589)}, 1 LIMIT 15")
def _(s, d):
    return GeoIndex(points(s, d)).nearest(42.3601, -71.0589, 15).select("key", F.round("metres", 3).alias("metres"))


@query("geo_stats", f"SELECT count(*) AS points, count(DISTINCT {_geohash_sql(3)}) AS cells, 3 AS precision FROM customer")
def _(s, d):
    return GeoIndex(points(s, d), 3).stats()


# secondary indexes


def part_index(s: SparkSession, d: str, kind: str = "hash", length: int = 0) -> Catalog:
    c = Catalog()
    c.create(Index("by", kind, F.col("p_partkey"), F.col("p_brand") if kind != "range" else F.col("p_size"), length), read_table(s, d, "part"))
    return c


@query("idx_exact", "SELECT p_partkey AS key FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def _(s, d):
    first = read_table(s, d, "part").agg(F.min("p_brand")).first()[0]
    return part_index(s, d).exact("by", first)


@query("idx_range_text", "SELECT CAST(p_size AS VARCHAR) AS indexed_value, p_partkey AS key FROM part WHERE CAST(p_size AS VARCHAR) BETWEEN '25' AND '4'")
def _(s, d):
    return part_index(s, d, "range").range("by", "25", "4")


@query("idx_prefix", "SELECT p_partkey AS key FROM part WHERE starts_with(p_brand, 'Brand#1')")
def _(s, d):
    return part_index(s, d, "prefix", 7).prefix("by", "Brand#1")


@query("idx_stats", "SELECT count(DISTINCT p_brand) AS distinct_values, count(*) AS total_keys FROM part")
def _(s, d):
    return part_index(s, d).stats("by")


# messages and streams


def messages(s: SparkSession, d: str) -> DataFrame:
    topic = F.concat(F.col("event_type"), F.lit("."), (F.col("user_id") % 5).cast("string"))
    return read_table(s, d, "events").select(topic.alias("topic"), F.col("props").alias("payload"), F.col("event_id").alias("timestamp"))


SUBS = [("a", "click.*"), ("b", "*.3"), ("c", "*.*"), ("d", "view.1"), ("e", "view"), ("f", "*")]


@query("pubsub_delivery", f"SELECT event_type || '.' || CAST(user_id % 5 AS VARCHAR) AS topic, count(*) AS delivered FROM events JOIN (VALUES {', '.join(map(str, SUBS))}) s(subscriber, pattern) ON regexp_full_match(event_type || '.' || CAST(user_id % 5 AS VARCHAR), replace(replace(pattern, '.', '[.]'), '*', '[^.]*')) GROUP BY 1")
def _(s, d):
    return feed.delivered_counts(messages(s, d), s.createDataFrame(SUBS, "subscriber string, pattern string"))


FEED_SQL = f"WITH {OPS} SELECT seq, CASE op WHEN 'put' THEN 'update' ELSE op END AS event, key, CASE WHEN op = 'put' THEN value END AS value FROM ops WHERE op IN ('put', 'delete', 'tag', 'untag') AND (key LIKE 'user:1%' OR key LIKE 'user:_')"


@query("change_feed", FEED_SQL)
def _(s, d):
    return feed.change_feed(ops(s, d), "user:1*", "user:?")


@query("change_feed_stream", FEED_SQL)
def _(s, d):
    folder = shared_folder(s)
    log = oplog.OpLog(s, f"{folder}/log")
    log.append(ops(s, d))
    stream = feed.read_log(s, log.log_path)
    return feed.to_table(feed.change_feed(stream, "user:1*", "user:?"), f"{folder}/checkpoint", f"{folder}/out")


@query("change_delivery", f"WITH {OPS} SELECT client, seq, key FROM ops JOIN (VALUES ('x', 'user:1%'), ('y', '%3')) c(client, pattern) ON key LIKE pattern WHERE op IN ('put', 'delete', 'tag', 'untag')")
def _(s, d):
    subs = s.createDataFrame([("x", "user:1*"), ("y", "*3"), ("y", "*3")], "client string, pattern string")
    return feed.deliver_changes(feed.change_feed(ops(s, d)), subs).select("client", "seq", "key")


RATE_SQL = """WITH RECURSIVE r AS (SELECT CAST(user_id % 10 AS VARCHAR) AS client, epoch_ms(ts) AS at_ms, event_id AS seq, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_ms(ts), event_id) AS n FROM events),
b AS (SELECT client, n, at_ms, seq, CAST(5 AS DOUBLE) AS had, at_ms AS last FROM r WHERE n = 1 UNION ALL
  SELECT r.client, r.n, r.at_ms, r.seq, least(CAST(5 AS DOUBLE), b.had - CASE WHEN b.had >= 1 THEN 1 ELSE 0 END + greatest(0, r.at_ms - b.last) * CAST(0.001 AS DOUBLE) / CAST(1000 AS DOUBLE)), greatest(b.last, r.at_ms)
  FROM b JOIN r ON r.client = b.client AND r.n = b.n + 1)
SELECT client, at_ms, seq, had >= 1 AS allowed FROM b"""


@query("rate_limit", RATE_SQL)
def _(s, d):
    requests = read_table(s, d, "events").select((F.col("user_id") % 10).cast("string").alias("client"), X.epoch_ms(F.col("ts")).alias("at_ms"), F.col("event_id").alias("seq"))
    return feed.rate_limit(requests, 0.001, 5.0)


# results of operations, recovery, feeds across snapshots


def variant(s: SparkSession, d: str) -> DataFrame:
    """The log with purchases of every third event as removals of deadlines."""
    rows, kind = ops(s, d), read_table(s, d, "events").where("event_type = 'purchase' AND event_id % 3 = 0").select(F.col("event_id").alias("seq"), F.lit("ttl_remove").alias("changed"))
    return rows.join(kind, "seq", "left").select("seq", F.coalesce("changed", "op").alias("op"), "key", "value", "tag", "expires_at_ms")


VARIANT = OPS.replace("WHEN event_type = 'view'", "WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'ttl_remove' WHEN event_type = 'view'")
SEEN = f"seen AS (SELECT key, value FROM entries WHERE key NOT IN (SELECT key FROM ttls WHERE expires_at_ms <= {CLOCK}))"


@query("ttl_persist_fold", f"WITH {VARIANT} SELECT key, expires_at_ms FROM ttls")
def _(s, d):
    return oplog.ttls(variant(s, d))


@query("ttl_persist_result", f"WITH {VARIANT}, {SEEN} SELECT DISTINCT o.key, o.key IN (SELECT key FROM ttls) AND o.key IN (SELECT key FROM seen) AS done FROM ops o")
def _(s, d):
    log = variant(s, d)
    return oplog.persist_returning(log, log.select("key"), clock(s, d))


@query("ttl_expire_result", f"WITH {OPS}, {SEEN} SELECT DISTINCT o.key, o.key IN (SELECT key FROM seen) AS done FROM ops o")
def _(s, d):
    log = ops(s, d)
    return oplog.expire_returning(log, log.select("key", "expires_at_ms"), clock(s, d))


@query("ttl_restore", f"WITH {OPS} SELECT key, expires_at_ms FROM ttls WHERE expires_at_ms > {CLOCK}")
def _(s, d):
    log = oplog.OpLog(s, shared_folder(s))
    log.append(ops(s, d))
    log.snapshot()
    return oplog.rearmed(oplog.OpLog(s, log.path).state(), clock(s, d))


@query("expire_events", f"WITH {OPS} SELECT 'delete' AS event, key, 1::BIGINT AS times, 0::BIGINT AS again FROM ttls WHERE expires_at_ms <= {CLOCK}")
def _(s, d):
    """A key that expires gives one delete; a second sweep finds nothing."""
    log, now = oplog.OpLog(s, shared_folder(s)), clock(s, d)
    log.append(ops(s, d))
    before = log.last_seq()
    log.append(oplog.sweep(log.state(), now, before + 1))
    again = oplog.sweep(log.state(), now, log.last_seq() + 1).agg(F.count("*").alias("again"))
    events = feed.change_feed(log.ops().where(F.col("seq") > before)).groupBy("event", "key").agg(F.count("*").alias("times"))
    return events.join(F.broadcast(again))  # one row


STEPS = "steps AS (SELECT event_id AS seq, 'user:' || CAST(user_id AS VARCHAR) AS key, user_id % 3 + 1 AS step FROM events WHERE event_type = 'view')"


@query(
    "incr_after_snapshot",
    f"WITH {OPS}, {STEPS}, kept AS (SELECT key, max(seq) AS at, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM ops WHERE op IN ('put', 'delete') GROUP BY key) "
    "SELECT u.key, CASE WHEN sum(t.step) IS NULL THEN any_value(k.value) ELSE CAST(CAST(CASE WHEN any_value(k.op) = 'put' THEN any_value(k.value) ELSE '0' END AS BIGINT) + sum(t.step) AS VARCHAR) END AS value "
    "FROM (SELECT DISTINCT key FROM ops) u LEFT JOIN kept k ON u.key = k.key LEFT JOIN steps t ON t.key = u.key AND t.seq > coalesce(k.at, -1) GROUP BY u.key HAVING any_value(k.op) = 'put' OR sum(t.step) IS NOT NULL",
)
def _(s, d):
    """Increments before and after a snapshot, in the state that is recovered."""
    rows = ops(s, d).where("op in ('put', 'delete', 'tag')")
    step = (F.substring("key", 6, 20).cast("bigint") % 3 + 1).cast("string")
    rows = rows.withColumn("value", F.when(F.col("op") == "tag", step).otherwise(F.col("value"))).withColumn("op", F.when(F.col("op") == "tag", "incr").otherwise(F.col("op")))
    top = rows.agg(F.max("seq")).first()[0]
    log = oplog.OpLog(s, shared_folder(s))
    log.append(rows.where(F.col("seq") <= top // 2))
    log.snapshot()
    log.append(rows.where(F.col("seq") > top // 2))
    log.snapshot()
    return oplog.entries(oplog.OpLog(s, log.path).state())


@query("feed_across_snapshot", FEED_SQL)
def _(s, d):
    """A stream of the log that is stopped and goes on, with snapshots and a vacuum between."""
    folder, rows = shared_folder(s), ops(s, d)
    log, top = oplog.OpLog(s, f"{folder}/log"), rows.agg(F.max("seq")).first()[0]
    for i in range(3):
        log.append(rows.where((F.col("seq") > top * i // 3 - (i == 0)) & (F.col("seq") <= top * (i + 1) // 3)))
        stream = feed.change_feed(feed.read_log(s, log.log_path), "user:1*", "user:?")
        out = feed.to_table(stream, f"{folder}/checkpoint", f"{folder}/out")
        log.snapshot()
        log.vacuum()
    return out


@query("background_snapshot", f"WITH {OPS} SELECT key, value, 2::BIGINT AS snapshots FROM entries")
def _(s, d):
    """A stream that takes a snapshot for what was appended; run twice, with nothing new the third time."""
    folder, rows = shared_folder(s), ops(s, d)
    log, top = oplog.OpLog(s, f"{folder}/log"), rows.agg(F.max("seq")).first()[0]
    for part in (rows.where(F.col("seq") <= top // 2), rows.where(F.col("seq") > top // 2), rows.limit(0)):
        log.append(part)
        feed.snapshot_every(feed.read_log(s, log.log_path), log, f"{folder}/checkpoint")
    taken = log.manifest()["generation"]
    return oplog.entries(log.state()).withColumn("snapshots", F.lit(taken).cast("bigint"))


@query("feed_back_pressure", f"WITH {OPS} SELECT count(*) AS n, true AS in_steps FROM ops")
def _(s, d):
    """One file in each batch of the stream."""
    folder, sizes = shared_folder(s), []
    log = oplog.OpLog(s, f"{folder}/log")
    log.append(ops(s, d))
    feed.collect_stream(feed.read_log(s, log.log_path, 1), f"{folder}/checkpoint", lambda df, n: sizes.append(df.count()))
    return s.createDataFrame([(sum(sizes), len(sizes) > 1 and max(sizes) < sum(sizes))], "n bigint, in_steps boolean")


@query("flush_all", f"WITH {OPS}, late AS (SELECT * FROM ops WHERE seq > (SELECT max(seq) // 2 FROM ops)) SELECT key, arg_max(value, seq) AS value FROM late WHERE op IN ('put', 'delete') GROUP BY key HAVING arg_max(op, seq) = 'put'")
def _(s, d):
    log, rows = oplog.OpLog(s, shared_folder(s)), ops(s, d)
    top = rows.agg(F.max("seq")).first()[0]
    log.append(rows.where(F.col("seq") <= top // 2))
    log.flush_all()
    log.append(rows.where(F.col("seq") > top // 2))
    return oplog.entries(log.state())


@query(
    "transaction_batch",
    f"WITH {OPS}, early AS (SELECT key, arg_max(value, seq) AS value FROM ops WHERE op IN ('put', 'delete') AND seq <= 300 GROUP BY key HAVING arg_max(op, seq) = 'put') "
    "SELECT key, value, true AS conflict, 2 AS written, 1 AS removed FROM early WHERE key NOT IN ('user:1', 'user:2', 'new') UNION ALL SELECT * FROM (VALUES ('user:1', '7', true, 2, 1), ('new', '8', true, 2, 1))",
)
def _(s, d):
    """A batch that puts two keys and deletes one; a second, which read one of them before, conflicts and changes nothing."""
    log = oplog.OpLog(s, shared_folder(s))
    log.append(ops(s, d).where("seq <= 300"))
    one, two = (oplog.Batch.begin(log.last_seq()) for _ in range(2))
    for op, key, value in (("put", "user:1", "7"), ("put", "new", "8"), ("delete", "user:2", None)):
        one.add(op, key, value)
    two.touch("user:1")
    two.add("put", "user:3", "9")
    written, removed = one.write_set()
    one.commit(log)
    try:
        two.commit(log)
        conflict = False
    except RuntimeError:
        conflict = True
    return oplog.entries(log.state()).select("key", "value", F.lit(conflict).alias("conflict"), F.lit(len(written)).alias("written"), F.lit(len(removed)).alias("removed"))


# edits of indexes and points, settings, and what is refused


@query("kv_stream_range", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
def _(s, d):
    """The rows as they come, one partition at a time, with their place."""
    rows = orders(s, d).stream_range(Bound(100), Bound(300))
    return s.createDataFrame([(i, r.key, r.value) for i, r in enumerate(rows)], "pos bigint, key bigint, value double")


@query("kv_keys_cap", f"SELECT count(*) AS n, count(*) > 5 AS refused FROM orders WHERE {KEY_SQL} LIKE 'order:00000%'")
def _(s, d):
    """More keys than the cap are an error, as many as the cap are not."""
    store, n = text_orders(s, d), text_orders(s, d).where(F.startswith("key", F.lit("order:00000"))).count().first().n
    assert store.keys("order:00000*", n).count() == n
    try:
        store.keys("order:00000*", 5).collect()
        refused = False
    except Exception as e:
        if "keys match" not in str(e):
            raise
        refused = True
    return s.createDataFrame([(n, refused)], "n bigint, refused boolean")


REFUSED = ("SELECT * FROM orders WHERE value ILIKE 'a'", "SELECT * FROM orders WHERE value", "SELECT * FROM orders WHERE EXISTS (SELECT 1)", "SELECT * FROM orders WHERE colour = 'red'", "SELECT key, COUNT(*) FROM orders", "DELETE FROM orders", "SELECT * FROM nowhere")


@query("sql_refused", f"SELECT * FROM (VALUES {', '.join(f'({i}, true)' for i in range(len(REFUSED)))}) AS t(n, refused)")
def _(s, d):
    """Statements with conditions that are not understood are errors, and never match every row."""
    session, out = sql_session(s, d), []
    for i, text in enumerate(REFUSED):
        try:
            session.execute(text)
            out.append((i, False))
        except SqlError:
            out.append((i, True))
    return s.createDataFrame(out, "n int, refused boolean")


@query("sql_mixed_strict", "SELECT 'N/A' AS key, CAST(count(*) AS BIGINT) AS n FROM customer")
def _(s, d):
    return SqlSession(s, {"customer": customers(s, d)}, strict=True).execute("SELECT key, COUNT(*) AS n FROM customer").df


dialect("sql_avg_distinct", "SELECT AVG(DISTINCT value) AS mean, SUM(DISTINCT value) AS total FROM order_cust WHERE key <= 'order:0000999'", f"SELECT avg(DISTINCT CAST(o_custkey AS DOUBLE)) AS mean, sum(DISTINCT CAST(o_custkey AS DOUBLE)) AS total FROM orders WHERE {KEY_SQL} <= 'order:0000999'")


@query("join_order_hint", "SELECT (SELECT count(*) FROM customer) <= (SELECT count(*) FROM orders) AS build_left, (SELECT count(*) FROM orders) <= (SELECT count(*) FROM nation) AS orders_first, true AS tie_left")
def _(s, d):
    n = {t: read_table(s, d, t).count() for t in ("customer", "orders", "nation")}
    sides = [joins.join_order(a, b)[0] for a, b in ((n["customer"], n["orders"]), (n["orders"], n["nation"]), (5, 5))]
    return s.createDataFrame([tuple(sides)], "build_left boolean, orders_first boolean, tie_left boolean")


fold("replication_lag", "SELECT max((SELECT max(seq) FROM ops) - synced) AS max_lag, min(synced) AS min_synced FROM (SELECT key, max(seq) AS synced FROM ops GROUP BY key)")(
    lambda o: stats.replication_stats(o.groupBy(F.col("key").alias("replica")).agg(F.max("seq").alias("synced")), o.agg(F.max("seq")).first()[0])
)
fold("random_victims", "SELECT key, row_number() OVER (ORDER BY md5(key), key) AS rank FROM (SELECT DISTINCT key FROM ops) ORDER BY rank LIMIT 10")(lambda o: stats.victims(o, "random", 10))
LIMITS = [(p, k, mk, u, mb, pc) for p in ("none", "lru") for k, mk in ((5, 0), (5, 5), (5, 9)) for u, mb, pc in ((100, 0, 5), (99, 100, 5), (100, 100, 5), (250, 100, 30))]


@query(
    "eviction_limits",
    f"SELECT n, policy = 'none' AND ((most > 0 AND keys >= most) OR (max_bytes > 0 AND used >= max_bytes)) AS refuse, CAST(CASE WHEN used < max_bytes OR max_bytes = 0 THEN 0 ELSE used - max_bytes * (100 - percent) // 100 END AS BIGINT) AS evict "
    f"FROM (VALUES {', '.join(str((i, *x)) for i, x in enumerate(LIMITS))}) AS t(n, policy, keys, most, used, max_bytes, percent)",
)
def _(s, d):
    rows = [(i, stats.must_refuse(p, k, mk, u, mb), stats.bytes_to_evict(u, mb, pc)) for i, (p, k, mk, u, mb, pc) in enumerate(LIMITS)]
    return s.createDataFrame(rows, "n int, refuse boolean, evict bigint")


@query("store_memory", "SELECT count(*) AS keys, CAST(sum(strlen(c_name) + strlen(c_mktsegment) + 48) AS BIGINT) AS bytes FROM customer")
def _(s, d):
    return stats.memory(customers(s, d).pairs())


@query("memory_strings", "SELECT t AS text, CAST(regexp_extract(t, '[0-9]+') AS BIGINT) * CASE WHEN t ILIKE '%gb%' THEN 1073741824 WHEN t ILIKE '%mb%' THEN 1048576 WHEN t ILIKE '%kb%' THEN 1024 ELSE 1 END AS bytes FROM (VALUES ('2GB'), ('512 MB'), ('1024kb'), ('10B'), ('77')) AS v(t)")
def _(s, d):
    return s.createDataFrame([(t, X.memory_bytes(t)) for t in ("2GB", "512 MB", "1024kb", "10B", "77")], "text string, bytes bigint")


@query("epoch_stamps", "SELECT event_id, epoch_ms(ts) AS ms, CAST(floor(epoch_ms(ts) / 1000.0) AS BIGINT) AS seconds FROM events")
def _(s, d):
    return read_table(s, d, "events").select("event_id", X.epoch_ms(F.col("ts")).alias("ms"), X.epoch_seconds(F.col("ts")).alias("seconds"))


@query("idx_catalog", "SELECT true AS created, false AS again, 'prefix' AS kind, 'by,size' AS names, true AS dropped, false AS dropped_again, 'by' AS names_left")
def _(s, d):
    c = Catalog()
    made = [c.create(Index(n, k, F.col("p_partkey"), F.col("p_brand"), 7), read_table(s, d, "part")) for n, k in (("size", "prefix"), ("by", "hash"), ("by", "range"))]
    row = (made[0] and made[1], made[2], c.kind("size"), ",".join(c.names()), c.drop("size"), c.drop("size"), ",".join(c.names()))
    return s.createDataFrame([row], "created boolean, again boolean, kind string, names string, dropped boolean, dropped_again boolean, names_left string")


@query("idx_entries", "SELECT 'brand' AS index_name, p_brand AS indexed_value, p_partkey AS key FROM part WHERE p_partkey % 4 <> 1 UNION ALL SELECT 'brand', p_brand, p_partkey FROM part WHERE p_partkey % 4 = 2")
def _(s, d):
    """Entries added by hand, some twice, and some removed; a removal from an index that is not there does nothing."""
    rows = read_table(s, d, "part").select(F.lit("brand").alias("index_name"), F.col("p_brand").alias("indexed_value"), F.col("p_partkey").alias("key"))
    more = add_entries(rows, rows.where("key % 4 = 2"))
    gone = rows.where("key % 4 = 1").unionByName(rows.where("key % 4 = 3").withColumn("index_name", F.lit("other")))
    return remove_entries(more, gone)


@query("geo_edit", f"SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 10.0 ELSE {LAT} END AS lat, CASE WHEN c_custkey % 5 = 0 THEN 20.0 ELSE {LON} END AS lon FROM customer WHERE c_custkey % 3 <> 1")
def _(s, d):
    """Points put again at a new place, and points removed."""
    moved = points(s, d).where("key % 5 = 0").select("key", F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"))
    return GeoIndex(points(s, d)).add(moved).remove(points(s, d).where("key % 3 = 1").select("key")).points.select("key", "lat", "lon")


@query("geo_manager", f"SELECT c_custkey AS key, 'east,west' AS names, true AS missing, true AS dropped FROM customer WHERE {LON} >= 0 AND {LAT} BETWEEN 10 AND 60 AND {LON} BETWEEN -30 AND 45")
def _(s, d):
    """Named indexes: a second creation replaces the first, a missing one finds nothing."""
    m = GeoManager()
    m.create("east", points(s, d))
    m.create("west", points(s, d).where("lon < 0"))
    m.create("east", points(s, d).where("lon >= 0"))
    names, missing, dropped = ",".join(m.names()), m.box("north", 10, -30, 60, 45) is None, m.drop("west") and not m.drop("west")
    return m.box("east", 10, -30, 60, 45).select("key", F.lit(names).alias("names"), F.lit(missing).alias("missing"), F.lit(dropped).alias("dropped"))


# beyond the dialect: what Spark brings


@query("set_ops_ext", "(SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL (SELECT o_custkey FROM orders WHERE o_orderkey < 100 INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(s, d):
    o, c = read_table(s, d, "orders"), read_table(s, d, "customer").where("c_custkey % 2 = 0").select("c_custkey")
    return o.select(F.col("o_custkey").alias("key")).distinct().subtract(c).unionAll(o.where("o_orderkey < 100").select("o_custkey").intersect(c))


@query("window_latest_ext", "SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def _(s, d):
    last = read_table(s, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("x"))
    return last.select("x.event_id", "user_id", "x.value")


@query("tumbling_window_ext", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    rows = feed.windowed(read_table(s, d, "events"), "ts", "1 hour", "1 day", "event_type")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def queries():
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
