"""The folds against a small sequential model, and the log's files."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkkv.sources import oplog

OP = st.tuples(st.sampled_from(["put", "put", "delete", "expire", "incr", "tag", "untag", "ttl_set", "ttl_remove"]), st.sampled_from("abc"), st.integers(0, 9), st.integers(0, 2), st.integers(0, 100))


class Model:
    """One operation after the other, as a plain dictionary store would do it."""

    def __init__(self):
        self.value, self.tags, self.ttl = {}, {}, {}

    def run(self, op, key, value, tag, at):
        if op == "put":
            self.value[key] = value
        elif op == "incr":
            self.value[key] = self.value.get(key, 0) + value
        elif op in ("delete", "expire"):
            for d in (self.value, self.tags, self.ttl):
                d.pop(key, None)
        elif key in self.value:
            if op == "tag":
                self.tags.setdefault(key, set()).add(tag)
            elif op == "untag":
                self.tags.get(key, set()).discard(tag)
            elif op == "ttl_set":
                self.ttl[key] = at
            else:
                self.ttl.pop(key, None)

    def state(self):
        return {(k, str(v)) for k, v in self.value.items()}, {(k, t) for k, ts in self.tags.items() for t in ts}, set(self.ttl.items())


def log(spark, ops):
    return spark.createDataFrame([(i, o, k, str(v), t, at) for i, (o, k, v, t, at) in enumerate(ops)], oplog.SCHEMA)


def folded(df):
    return tuple({tuple(r) for r in f(df).collect()} for f in (oplog.entries, oplog.tags, oplog.ttls))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(OP, min_size=1, max_size=30))
def test_folds_equal_the_model(spark, ops):
    m = Model()
    for o in ops:
        m.run(*o)
    df = log(spark, ops)
    assert folded(df) == m.state()
    gone = {k for k, at in m.ttl.items() if at <= 50}
    assert {tuple(r) for r in oplog.visible(df, 50).collect()} == {x for x in m.state()[0] if x[0] not in gone}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(OP, min_size=4, max_size=24), st.integers(1, 3))
def test_recovery_equals_the_model(spark, tmp_path_factory, ops, cut):
    path = f"file://{tmp_path_factory.mktemp('log')}/l"
    store, m = oplog.OpLog(spark, path), Model()
    for o in ops:
        m.run(*o)
    rows = [(o, k, str(v), t, at) for o, k, v, t, at in ops]
    store.append_rows(rows[:cut])
    store.snapshot()
    store.append_rows(rows[cut:])
    assert folded(oplog.OpLog(spark, path).state()) == m.state()
    store.snapshot()
    assert folded(store.state()) == m.state() and store.vacuum() == 2 and store.last_seq() == len(ops) - 1
    store.append_rows([("incr", "a", "5", None, None), ("incr", "n", "-2", None, None)])
    m.run("incr", "a", 5, None, None), m.run("incr", "n", -2, None, None)
    assert folded(store.state()) == m.state()
    store.snapshot()
    assert folded(oplog.OpLog(spark, path).state()) == m.state()
    assert {r.kind for r in store.report().collect()} == {"snapshot entries", "snapshot tags", "snapshot ttls"}
    store.flush_all()
    assert folded(store.state()) == (set(), set(), set())


def test_counters(spark):
    rows = [("put", "a", "5"), ("incr", "a", "2"), ("incr", "b", "-3"), ("put", "c", "x"), ("incr", "a", "1"), ("put", "d", "9"), ("incr", "d", "1"), ("delete", "d", None), ("incr", "d", "4")]
    df = spark.createDataFrame([(i, o, k, v, None, None) for i, (o, k, v) in enumerate(rows)], oplog.SCHEMA)
    assert {tuple(r) for r in oplog.entries(df).collect()} == {("a", "8"), ("b", "-3"), ("c", "x"), ("d", "4")}
    bad = df.union(spark.createDataFrame([(99, "incr", "c", "1", None, None)], oplog.SCHEMA))
    with pytest.raises(Exception, match="not an integer"):
        oplog.entries(bad).collect()
    for step in ("abc", None, "1.5"):
        worse = df.union(spark.createDataFrame([(99, "incr", "a", step, None, None)], oplog.SCHEMA))
        with pytest.raises(Exception, match="not an integer"):
            oplog.entries(worse).collect()
    over = spark.createDataFrame([(0, "put", "a", str(2**63 - 1), None, None), (1, "incr", "a", "1", None, None)], oplog.SCHEMA)
    with pytest.raises(Exception, match="(?i)overflow"):
        oplog.entries(over).collect()
    marked = df.union(spark.createDataFrame([(9, "tag", "b", None, 3, None), (10, "ttl_set", "d", None, None, 7)], oplog.SCHEMA))
    assert folded(marked)[1:] == ({("b", 3)}, {("d", 7)})  # a counted key is there


def test_folds_split_a_hot_key(spark, tmp_path):
    """A key with most of the log: the joins of the folds are ones that adaptive execution splits."""
    rows = spark.range(60_000).selectExpr("id seq", "case when id % 50 = 0 then 'put' when id % 7 = 0 then 'incr' else 'tag' end op", "if(id % 4 < 3, 'hot', concat('k', id % 4000 - id % 50)) key", "'1' value", "id % 9 tag", "cast(null as bigint) expires_at_ms")
    rows.write.parquet(f"{tmp_path}/ops")
    ops = spark.read.parquet(f"{tmp_path}/ops")
    plain = folded(spark.createDataFrame(ops.collect(), oplog.SCHEMA))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        ops = spark.read.option("maxPartitionBytes", "64k").parquet(f"{tmp_path}/ops").repartition(24)
        for f, want in ((oplog.entries, plain[0]), (oplog.tags, plain[1])):
            df = f(ops)
            assert {tuple(r) for r in df.collect()} == want
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_settings_reach_the_log(spark, tmp_path):
    from sparkkv.config import StoreConfig

    store = oplog.OpLog(spark, f"file://{tmp_path}/l", StoreConfig(shards=2, max_keys=2, snapshot_seconds=60))
    put = lambda k: ("put", k, "v", None, None)
    store.append_rows([put("a"), put("b")])
    assert len(list((tmp_path / "l/log/generation=0").glob("shard=*"))) <= 2
    with pytest.raises(MemoryError):
        store.append_rows([put("c")])
    assert store.append_rows([("delete", "a", None, None, None)]) == 1 and store.append_rows([put("c")]) == 1
    again = oplog.OpLog(spark, store.path, StoreConfig(shards=8))
    assert again.config == store.config and again.last_seq() == 3
    store.snapshot(now_ms=1_000_000)
    assert not store.snapshot_due(1_059_999) and store.snapshot_due(1_060_000)
    lru = oplog.OpLog(spark, f"file://{tmp_path}/m", StoreConfig(eviction="lru", max_memory="100B", evict_percent=10))
    lru.append_rows([put("a"), put("b"), put("c")])
    assert lru.pressure() == {"keys": 3, "bytes": 150, "refuse": False, "evict": 60}


def test_deadlines(spark):
    rows = [("put", "a", None), ("ttl_set", "a", 100), ("put", "b", None), ("ttl_set", "c", 100), ("put", "d", None), ("ttl_set", "d", 5600), ("put", "a", None)]
    df = spark.createDataFrame([(i, o, k, "v", None, at) for i, (o, k, at) in enumerate(rows)], oplog.SCHEMA)
    keys = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    at = lambda ms: {r.key: r.ttl for r in oplog.ttl_read(keys, df, ms).collect()}
    assert at(99) == {"a": 0, "b": -1, "c": -2, "d": 5} and at(100) == {"a": -2, "b": -1, "c": -2, "d": 5}
    assert [(r.op, r.key) for r in oplog.sweep(df, 100, 50).collect()] == [("expire", "a")]
    assert folded(df.unionByName(oplog.sweep(df, 100, 50)))[0] == {("b", "v"), ("d", "v")}


def test_transactions_and_replicas(spark, tmp_path):
    store = oplog.OpLog(spark, f"file://{tmp_path}/l")
    store.append_rows([("put", "a", "1", None, None), ("put", "b", "2", None, None)])
    one, two = oplog.Batch.begin(store.last_seq()), oplog.Batch.begin(store.last_seq())
    one.touch("a")
    one.add("put", "c", "3")
    one.add("delete", "b")
    two.add("put", "a", "9")
    assert one.write_set() == ([("c", "3")], ["b"])
    assert two.commit(store) == 1
    with pytest.raises(RuntimeError, match="conflict"):
        one.commit(store)
    with pytest.raises(ValueError):
        one.add("rename", "a")
    assert folded(store.state())[0] == {("a", "9"), ("b", "2")}
    ops = store.ops()
    assert oplog.truncate(ops, 2).count() == 1 and oplog.changes(ops, 1).count() == 2
    assert oplog.apply_changes(ops.where("seq < 1"), ops).count() == 3 and oplog.apply_changes(ops.limit(0), ops).count() == 3
    assert oplog.delete_count(ops, spark.createDataFrame([("a",), ("a",), ("z",)], "key string")).first().removed == 1
    assert {tuple(r) for r in oplog.put_returning(ops, spark.createDataFrame([("a", "x"), ("n", "y")], "key string, value string")).collect()} == {("a", "9"), ("n", None)}
