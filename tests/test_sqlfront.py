"""The SQL dialect on literal stores, and the strict mode's oddities."""

import pytest

from sparkkv.operators.store import KVStore
from sparkkv.plans.sqlfront import SqlError, SqlSession, parse


def session(spark, rows, strict=False, **more):
    make = lambda r: KVStore(spark.createDataFrame(r, "key string, value string"))
    return SqlSession(spark, {"kv": make(rows)} | {k: make(v) for k, v in more.items()}, strict=strict)


USERS = [("user:1", "Alice"), ("user:2", "Bob"), ("user:3", "Charlie"), ("user:5", "Charlie"), ("admin:1", "Charlie")]
ABCD = [("a", "First"), ("b", "Second"), ("c", "Third"), ("d", "Fourth")]


def rows(s, sql):
    return [tuple(r) for r in s.execute(sql).df.collect()]


@pytest.mark.parametrize(
    "where,keys",
    [
        ("key = 'user:1'", ["user:1"]),
        ("value = 'Charlie' AND key LIKE 'user:%'", ["user:3", "user:5"]),
        ("'Bob' = value", ["user:2"]),
        ("'user:2' < key", ["user:3", "user:5"]),
        ("value <> 'Charlie'", ["user:1", "user:2"]),
        ("key BETWEEN 'user:1' AND 'user:3'", ["user:1", "user:2", "user:3"]),
        ("key BETWEEN 'z' AND 'a'", []),
        ("key NOT BETWEEN 'b' AND 'user:4'", ["admin:1", "user:5"]),
        ("value IN ('Alice', 'Bob', 'Bob')", ["user:1", "user:2"]),
        ("NOT (value IN ('Alice') OR key LIKE 'admin%')", ["user:2", "user:3", "user:5"]),
        ("key >= 'user:3' AND key <= 'user:5'", ["user:3", "user:5"]),
        ("1 = 1", sorted(k for k, _ in USERS)),
        ("value IS NULL", []),
        ("value NOT LIKE '_o%' AND value IS NOT NULL", ["admin:1", "user:1", "user:3", "user:5"]),
        ("UPPER(value) = 'BOB'", ["user:2"]),
    ],
)
def test_where(spark, where, keys):
    assert sorted(r[0] for r in rows(session(spark, USERS), f"SELECT key FROM kv WHERE {where}")) == keys


def test_order_limit_offset_top_distinct(spark):
    s = session(spark, ABCD)
    assert rows(s, "SELECT key FROM kv ORDER BY value DESC LIMIT 2 OFFSET 1") == [("b",), ("d",)]
    assert rows(s, "SELECT * FROM kv ORDER BY key OFFSET 3") == [("d", "Fourth")] and rows(s, "SELECT key FROM kv ORDER BY key OFFSET 9") == []
    assert rows(s, "SELECT TOP 2 key FROM kv ORDER BY 1 LIMIT 3") == [("a",), ("b",)] and rows(s, "SELECT key FROM kv LIMIT 0") == []
    d = session(spark, [("user:1", "Alice"), ("user:2", "Alice"), ("user:3", "Bob")])
    assert rows(d, "SELECT DISTINCT value FROM kv ORDER BY value") == [("Alice",), ("Bob",)]
    assert s.execute("SELECT value, key, value AS v FROM kv").df.columns == ["value", "key", "v"]


def test_aggregates(spark):
    s = session(spark, [("1", "10"), ("2", "x"), ("3", "2.5")])
    assert rows(s, "SELECT COUNT(*) n, SUM(value) s, AVG(value) a, MIN(value) lo, MAX(value) hi, SUM(key) k FROM kv") == [(3, 12.5, 12.5 / 3, 0.0, 10.0, 6.0)]
    assert rows(s, "SELECT COUNT(*) n, SUM(value) s, AVG(value) a, MIN(value) lo FROM kv WHERE key = '9'") == [(0, 0.0, None, None)]
    assert rows(session(spark, USERS), "SELECT value, COUNT(*) AS n, COUNT(DISTINCT key) AS d FROM kv GROUP BY value HAVING COUNT(*) > 1") == [("Charlie", 3, 3)]
    with pytest.raises(SqlError, match="GROUP BY"):
        s.execute("SELECT key, COUNT(*) FROM kv")


def test_joins(spark):
    s = session(spark, USERS, roles=[("user:1", "admin"), ("user:9", "guest")])
    assert rows(s, "SELECT a.value, b.value AS role FROM kv a JOIN roles b ON a.key = b.key") == [("Alice", "admin")]
    assert len(rows(s, "SELECT * FROM kv a LEFT JOIN roles b ON a.key = b.key")) == 5 and len(rows(s, "SELECT * FROM kv a FULL OUTER JOIN roles b ON a.key = b.key")) == 6
    assert rows(s, "SELECT key FROM kv a LEFT SEMI JOIN roles b ON a.key = b.key") == [("user:1",)]
    plan = s.execute("SELECT a.value FROM kv a JOIN roles b ON a.key = b.key").df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_mutations(spark):
    s = session(spark, USERS)
    assert s.execute("INSERT INTO kv (key, value) VALUES ('x', 'it''s \"so\"'), ('user:1', 'A')").affected.first()[0] == 2
    assert rows(s, "SELECT value FROM kv WHERE key = 'x'") == [("it's \"so\"",)]
    assert s.execute("UPDATE kv SET value = 'C' WHERE value IN ('Charlie', 'C')").affected.first()[0] == 3
    assert s.execute("UPDATE kv SET value = 'C' WHERE key = 'missing'").affected.first()[0] == 0
    assert s.execute("DELETE FROM kv WHERE value = 'C' AND key < 'b'").affected.first()[0] == 1
    assert rows(s, "SELECT COUNT(*) n FROM kv") == [(5,)]
    assert s.execute("DELETE FROM kv WHERE 1 = 1").affected.first()[0] == 5 and rows(s, "SELECT * FROM kv") == []


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1", "SELECT * FROM kv; SELECT * FROM kv", "SELECT * FROM other", "SELECT name FROM kv", "SELECT * FROM kv WHERE name = 'x'", "DROP TABLE kv", "SELECT DISTINCT ON (key) key FROM kv", "SELECT * FROM kv LIMIT 1 + 1", "UPDATE kv SET value = 'x'", "DELETE FROM kv",
        "INSERT INTO kv VALUES ('a', 'b')", "SELECT * FROM kv, kv", "SELECT * FROM kv UNION SELECT * FROM kv", "SELECT * FROM kv WHERE EXISTS (SELECT 1)", "SELECT * FROM kv WHERE value", "SELECT SECRET(value) FROM kv", "UPDATE kv SET key = 'x' WHERE key = 'y'", "SELECT * FROM kv WHERE key = ?", "SELECT key FROM kv a JOIN kv a ON a.key = a.key", "SELECT key FROM kv ORDER BY 4",
    ],
)
def test_errors(spark, sql):
    with pytest.raises(SqlError):
        session(spark, ABCD).execute(sql)


def test_strict(spark):
    s = session(spark, [("a", "3"), ("b", '"Alice"'), ("c", "1.5")], strict=True)
    assert rows(s, "SELECT * FROM any_name WHERE value = 'Alice'") == [] and len(rows(s, "SELECT * FROM t WHERE value = 'Alice' AND key = 'b'")) == 1
    df = s.execute("SELECT COUNT(*), SUM(value), MAX(value) AS top, key FROM t").df
    assert df.columns == ["COUNT(value)", "SUM(value)", "top", "key"] and tuple(df.first()) == (3, "4.5", "3", "N/A")
    assert [r[0] for r in rows(s, "SELECT * FROM t ORDER BY value DESC, key")] == ["c", "b", "a"]
    joined = s.execute("SELECT x.key FROM t x LEFT JOIN u y ON x.key <> y.value WHERE x.key = 'a' LIMIT 1").df
    assert joined.columns == ["a.key", "a.value", "b.key", "b.value"] and joined.count() == 3
    assert s.execute("UPDATE t SET value = 'new' WHERE key = 'zz'").affected.first()[0] == 1 and ("zz", "new") in rows(s, "SELECT * FROM t")


def test_parse_keeps_precedence():
    w = parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND NOT c = 3 -- tail").where
    assert w.op == "or" and w.args[1].op == "and" and w.args[1].args[1].op == "not"


def test_key_bounds_reach_the_scan_before_and_after_changes(spark, data):
    from sparkkv.operators.store import Bound, KVStore
    from sparkkv.plans import predicates as P
    from sparkkv.sources.adapters import StoreSpec, TextKey

    table = spark.read.parquet(f"{data}/orders.parquet")
    session = SqlSession(spark, {"orders": KVStore.over(table, StoreSpec(TextKey("o_orderkey", "order:", 7), "o_orderstatus"))})
    between = "SELECT key FROM orders WHERE key BETWEEN 'order:0000010' AND 'order:0000020'"

    def pushed(df):
        return [x for x in df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1:] if "o_orderkey,10)" in x.split("]")[0]]

    want = [f"order:{i:07d}" for i in range(10, 21)]
    assert pushed(session.execute(between).df) and sorted(r.key for r in session.execute(between).df.collect()) == want
    session.execute("INSERT INTO orders (key, value) VALUES ('order:0000015', 'new'), ('order:0000010x', 'odd')")
    session.execute("DELETE FROM orders WHERE key = 'order:0000012'")
    after = session.execute(between).df
    changed = sorted({*want, "order:0000010x"} - {"order:0000012"})
    assert pushed(after) and sorted(r.key for r in after.collect()) == changed
    store = session.stores["orders"]
    assert pushed(store.range(Bound("order:0000010"), Bound("order:0000020"))) and store.get("order:0000015").first().value == "new"
    assert pushed(store.filter(P.Between("key", "order:0000010", "order:0000020")).pairs())
    assert {r.key for r in store.filter(P.Between("key", "order:0000010", "order:0000020")).pairs().collect()} == set(changed)
