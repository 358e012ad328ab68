"""Literal cases for stores, patterns, predicates, indexes, points, streams and statistics."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkkv.functions import geo
from sparkkv.functions import text as X
from sparkkv.operators import aggregate, joins, secindex, stats
from sparkkv.operators.geoindex import GeoIndex, GeoManager
from sparkkv.operators.store import Bound, KVStore
from sparkkv.plans import predicates as P
from sparkkv.sources.adapters import StoreSpec, TextKey, read_pairs, write_pairs
from sparkkv.streaming import feed


def frame(spark, rows, schema="key string, value string"):
    return spark.createDataFrame(rows, schema)


def values(spark, column, cases, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, " + schema).orderBy("i").select(column).collect()]


USERS = [("user:1", "Alice"), ("user:2", "Bob"), ("user:3", "Charlie"), ("user:5", "Charlie"), ("admin:1", "Charlie")]


def test_shown_text(spark):
    cases = {'"Alice"': "Alice", "007": "007", '{"b":1,"a":2}': '{"a":2,"b":1}', "-5": "-5", "12": "12", '"open': '"open', "[1, 2]": "[1,2]", "plain": "plain", "": "", "1 x": "1 x", "[1] [2]": "[1] [2]", "[1],[2]": "[1],[2]", "{}": "{}", "1e3": "1000.0"}
    assert values(spark, X.display_text(F.col("x")), cases) == list(cases.values())


def test_numbers(spark):
    cases = {"1d": 0.0, " 5 ": 0.0, ".5": 0.5, "5.": 5.0, "+5": 5.0, "1e3": 1000.0, '"42"': 0.0, "x": 0.0, "-inf": float("-inf"), None: 0.0, "0x1": 0.0}
    assert values(spark, X.number(F.col("x")), cases) == list(cases.values())
    assert values(spark, X.integer(F.col("x")), ["7", "-3", "1.0", "", "99999999999999999999"]) == [7, -3, None, None, None]


def test_index_text(spark):
    df = spark.createDataFrame([(1, 2.5, True, [1, 2], None)], "i int, d double, b boolean, a array<int>, s string")
    got = df.select(*[X.index_text(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert tuple(got) == ("1", "2.5", "true", "[1,2]", "null")


@pytest.mark.parametrize("pattern,key,hit", [("user:*", "user:1", True), ("user:*", "session:1", False), ("user:?23", "user:123", True), ("user:?23", "user:1123", False), ("a.c", "abc", False), ("*", "a\nb", True), ("a[1]", "a[1]", True), ("u*1", "u", False)])
def test_globs(spark, pattern, key, hit):
    assert values(spark, X.glob(F.col("x"), pattern), [key]) == [hit]


@pytest.mark.parametrize("pattern,topic,hit", [("a.b", "a.b", True), ("a.*", "a.b", True), ("a.*", "a.b.c", False), ("*.b", "a.b", True), ("*", "a", True), ("*", "a.b", False), ("a.*.c", "a.x.c", True), ("a.b", "a.c", False), ("a.b*", "a.bc", False)])
def test_topics(spark, pattern, topic, hit):
    assert values(spark, X.topic_matches(F.lit(pattern), F.col("x")), [topic]) == [hit]


def test_like_and_json(spark):
    assert values(spark, X.like(F.col("x"), r"a\_%"), ["a\\b", "a_b", r"a\x1"]) == [True, False, True]
    assert values(spark, X.like(F.col("x"), "a%b"), ["a\nb", "axb", "ab", "ba"]) == [True, True, True, False]
    assert values(spark, X.json_field_contains(F.col("x"), "li"), ['{"username":"Alice"}', '{"username":7}', "{}", "bad", None]) == [True, False, False, False, False]


def test_binary(spark):
    data = [b"plain", b"\xff\x00\xfe", b"", "é".encode()]
    wrapped = values(spark, X.wrap_binary(F.col("x")), data, "x binary")
    assert wrapped[0] == "plain" and wrapped[1].startswith(X.BINARY_PREFIX)
    assert [bytes(v) for v in values(spark, X.unwrap_binary(X.wrap_binary(F.col("x"))), data, "x binary")] == data


def test_memory_and_sizes(spark):
    assert [X.memory_bytes(t) for t in ("2GB", "512mb", "1024 KB", "10B", "77")] == [2 << 30, 512 << 20, 1 << 20, 10, 77]
    with pytest.raises(ValueError):
        X.memory_bytes("1.5GB")
    r = stats.memory(frame(spark, [("ab", "é")])).first()
    assert (r["keys"], r["bytes"]) == (1, 52)
    assert stats.bytes_to_evict(99, 100, 10) == 0 and stats.bytes_to_evict(120, 100, 10) == 30
    assert stats.must_refuse("none", 5, 5, 0, 0) and not stats.must_refuse("none", 5, 0, 9, 0) and not stats.must_refuse("lru", 9, 5, 0, 0)
    assert len(stats.advice(0.5, 11, 0.02, 11)) == 4 and stats.advice(1, 0, 0, 0) == []


def test_ranges(spark):
    store = KVStore(frame(spark, [(i, 10 * i) for i in range(200)], "key int, value int"))
    assert [r.key for r in store.range(Bound(25), Bound(42, False)).collect()] == list(range(25, 42))
    assert store.range(Bound(9), Bound(3)).count() == 0 and store.scan().count() == 200
    assert [r.key for r in store.stream_range(Bound(190))] == list(range(190, 200))
    after, n = store.delete(F.col("key") == 30)
    assert n.first().affected == 1 and after.get(30).count() == 0 and after.get(31).first().value == 310
    assert store.limit(0).count() == 0 and [r.key for r in store.limit(2, 5).collect()] == [5, 6]
    half = store.range_unordered(Bound(), Bound(49)).filter(lambda k, v: k % 2 == 0)
    assert half.aggregate_count().first().n == 25 and half.aggregate_sum(F.col("value")).first().total == 10 * sum(range(0, 50, 2))
    assert store.range_unordered(Bound(500)).aggregate_sum(F.col("value")).first().total == 0
    with pytest.raises(Exception, match="more than 3 keys"):
        KVStore(frame(spark, USERS)).keys("user:*", 3).collect()
    assert [r.key for r in KVStore(frame(spark, USERS)).keys("user:?", 4).collect()] == ["user:1", "user:2", "user:3", "user:5"]


def test_text_key_reaches_the_scan(spark, data):
    key = TextKey("o_orderkey", "order:", 7)
    table = spark.read.parquet(f"{data}/orders.parquet")
    key.check(table)
    store = KVStore.over(table, StoreSpec(key, "o_orderstatus"))
    plan = store.range_unordered(Bound("order:0000010"), Bound("order:0000020")).pairs()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan and "LessThanOrEqual(o_orderkey,20)" in plan and "o_comment" not in plan
    assert store.range(Bound("order:00"), Bound("order:0000003")).count() == 4
    with pytest.raises(ValueError):
        TextKey("o_orderkey", "", 2).check(table)


def test_few_keys_do_not_shuffle_the_store(spark, data):
    store = KVStore.over(spark.read.parquet(f"{data}/orders.parquet"), StoreSpec("o_orderkey", "o_totalprice"))
    keys = spark.createDataFrame([(0, 7), (1, 7), (2, -1)], "pos int, key long")
    got = store.multi_get(keys)
    assert [(r.pos, r.key, r.value is None) for r in got.collect()] == [(0, 7, False), (1, 7, False), (2, -1, True)]
    assert store.exists_count(keys).first().found == 2
    plan = store._hits(keys)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_conditions(spark):
    store = KVStore(frame(spark, USERS + [("q", '"Alice"')]))
    keys = lambda c: sorted(r.key for r in store.filter(c).pairs().collect())
    assert keys(P.Compare("value", "=", "Alice")) == ["q", "user:1"]
    assert keys(P.Between("key", "user:2", "user:4")) == ["user:2", "user:3"] and keys(P.Between("key", "z", "a")) == []
    assert keys(~P.In("value", ("Alice", "Bob")) & P.Like("key", "user%")) == ["user:3", "user:5"]
    assert keys(P.Compare("value", ">", "B") | P.IsNull("value")) == ["admin:1", "user:2", "user:3", "user:5"]
    assert len(keys(P.Always())) == 6
    nums = KVStore(frame(spark, [("a", 5), ("b", 40)], "key string, value int"))
    assert [r.key for r in nums.filter(P.Compare("value", "<=", 5)).pairs().collect()] == ["a"]
    assert [r.key for r in nums.filter(P.Compare("value", "<", "5")).pairs().collect()] == ["b"]
    with pytest.raises(ValueError, match="unknown column"):
        store.filter(P.Compare("name", "=", "x"))


def test_aggregates_and_joins(spark):
    rows = frame(spark, [("A", 10), ("B", 20), ("A", 30), ("B", 40), ("A", 50)], "g string, v int")
    agg = aggregate.Aggregator(rows, "g")
    for df, want in ((agg.count(), {"A": 3, "B": 2}), (agg.sum(F.col("v")), {"A": 90, "B": 60}), (agg.avg(F.col("v")), {"A": 30.0, "B": 30.0}), (agg.min(F.col("v")), {"A": 10, "B": 20}), (agg.max(F.col("v")), {"A": 50, "B": 40}), (agg.aggregate(lambda v: float(v.median()), "double", F.col("v")), {"A": 30.0, "B": 30.0})):
        assert {r[0]: r[1] for r in df.collect()} == want
    assert {r.group: [x.v for x in r.rows] for r in agg.groups("v").collect()} == {"A": [10, 30, 50], "B": [20, 40]}
    assert aggregate.selectivity(rows, F.col("v") > 25).first()[0] == 0.6 and aggregate.selectivity(rows.limit(0), F.lit(True)).first()[0] == 0.0
    r = aggregate.numbers(KVStore(frame(spark, [("1", "x"), ("2", "4")]))).first()
    assert tuple(r) == (2, 4.0, 2.0, 0.0, 4.0) and aggregate.numbers(KVStore(frame(spark, [("7", "x")])), "key").first()["sum"] == 7.0
    left, right = (KVStore(frame(spark, [(i, f"{n}{i}") for i in r], "key long, value string")) for n, r in (("L", range(20)), ("R", range(0, 20, 2))))
    assert joins.hash_join(left, right, F.col("key"), F.col("key")).count() == 10
    assert joins.hash_join(left, right, F.col("key"), F.col("key"), how="left_anti").count() == 10
    got = joins.build_probe(frame(spark, [(1, "Alice"), (2, "Bob"), (3, "C")], "key int, left string"), frame(spark, [(1, 100), (2, 200), (4, 400), (1, 5)], "key int, right int")).collect()
    assert sorted(map(tuple, got)) == [(1, "Alice", 5), (1, "Alice", 100), (2, "Bob", 200)]
    assert joins.self_join(left).count() == 20 and joins.join_order(3, 3)[0] and not joins.join_order(4, 3)[0]


CITIES = [("nyc", 40.7128, -74.0060), ("brooklyn", 40.6782, -73.9442), ("boston", 42.3601, -71.0589), ("london", 51.5074, -0.1278)]


def bisect_geohash(lat, lon, precision):
    lo, hi, bits = [-180.0, -90.0], [180.0, 90.0], 0
    for i in range(5 * precision):
        k, x = i % 2, (lon, lat)[i % 2]
        mid = (lo[k] + hi[k]) / 2
        bits = bits * 2 + (x >= mid)
        (lo if x >= mid else hi)[k] = mid
    return "".join(geo.ALPHABET[bits >> 5 * (precision - 1 - c) & 31] for c in range(precision))


def test_points(spark):
    df = frame(spark, CITIES, "key string, lat double, lon double")
    g = GeoIndex(df)
    d = {r.key: r.metres for r in g.nearest(40.7128, -74.0060, 4).collect()}
    assert list(d) == ["nyc", "brooklyn", "boston", "london"] and abs(d["london"] - 5_570_000) < 20_000
    assert {r.key for r in g.radius(40.7128, -74.0060, 20_000).collect()} == {"nyc", "brooklyn"}
    assert {r.key for r in g.box(40, -75, 43, -70).collect()} == {"nyc", "brooklyn", "boston"}
    import random

    rng = random.Random(0)
    pts = [(str(i), rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [("p", 90.0, 180.0), ("m", -90.0, -180.0), ("o", 0.0, 0.0)]
    for precision in (1, 5, 6, 12):
        got = {r.key: r.cell for r in GeoIndex(frame(spark, pts, "key string, lat double, lon double"), precision).cells().collect()}
        assert got == {k: bisect_geohash(a, o, precision) for k, a, o in pts}
    many = frame(spark, pts, "key string, lat double, lon double")
    for lat, lon, r in ((89.0, 10.0, 500_000.0), (0.0, 179.9, 900_000.0), (-45.0, -179.0, 3e6), (10.0, 20.0, 2.2e7)):
        brute = many.where(geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= r).count()
        assert GeoIndex(many).radius(lat, lon, r).count() == brute
    moved = g.add(frame(spark, [("nyc", 0.0, 0.0)], "key string, lat double, lon double"))
    assert moved.get("nyc").first().lat == 0.0 and moved.stats().first().points == 4 and moved.remove(moved.get("nyc")).stats().first().points == 3
    with pytest.raises(Exception, match="out of range"):
        GeoIndex(frame(spark, [("x", 91.0, 0.0)], "key string, lat double, lon double")).validated().collect()
    with pytest.raises(ValueError):
        geo.geohash(F.lit(0.0), F.lit(0.0), 13)
    m = GeoManager()
    m.create("a", df)
    assert m.radius("none", 0, 0, 1) is None and m.box("a", 40, -75, 43, -70).count() == 3 and m.names() == ["a"] and m.drop("a")


def test_indexes(spark):
    people = frame(spark, [("u1", "alice", 25), ("u2", "alice", 100), ("u3", "bob", 35)], "key string, name string, age int")
    c = secindex.Catalog()
    assert c.create(secindex.Index("name", "hash", F.col("key"), F.col("name")), people) and not c.create(secindex.Index("name", "hash", F.col("key"), F.col("name")), people)
    c.create(secindex.Index("age", "range", F.col("key"), F.col("age")), people)
    c.create(secindex.Index("typed", "range", F.col("key"), F.col("age"), typed=True), people)
    c.create(secindex.Index("pre", "prefix", F.col("key"), F.col("name"), 3), people)
    assert {r.key for r in c.exact("name", "alice").collect()} == {"u1", "u2"} and tuple(c.stats("name").first()) == (2, 3)
    assert [r.key for r in c.range("age", "100", "25").collect()] == ["u2", "u1"]
    assert [r.key for r in c.range("typed", 25, 99).collect()] == ["u1", "u3"]
    assert {r.key for r in c.prefix("pre", "ali").collect()} == {"u1", "u2"} and c.kind("pre") == "prefix" and c.kind("no") is None
    assert c.drop("pre") and not c.drop("pre") and c.names() == ["age", "name", "typed"]
    rows = c.entries("name").select(F.lit("name").alias("index_name"), "indexed_value", "key")
    assert secindex.add_entries(rows, rows).count() == 6 and secindex.remove_entries(rows, rows.where("key = 'u1'")).count() == 2


def test_victims_and_replicas(spark):
    trace = frame(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, "a")], "seq long, key string")
    order = lambda p, **k: [r.key for r in stats.victims(trace, p, 2, **k).orderBy("rank").collect()]
    assert order("lru") == ["c", "b"] and order("lfu") == ["c", "b"] and order("none") == [] and len(order("random")) == 2
    assert order("volatile_lru", ttl_keys=trace.where("key = 'a'").select("key")) == ["a"]
    assert tuple(stats.replication_stats(frame(spark, [("r1", 7), ("r2", 3)], "replica string, synced long"), 9).first()) == (6, 3)
    assert tuple(stats.replication_stats(frame(spark, [], "replica string, synced long"), 9).first()) == (0, 9)


def test_files_round_trip(spark, tmp_path):
    df = frame(spark, USERS)
    for fmt in ("parquet", "orc", "json", "csv"):
        write_pairs(df, f"{tmp_path}/{fmt}", fmt, shards=3)
        assert sorted(map(tuple, read_pairs(spark, f"{tmp_path}/{fmt}", fmt).collect())) == sorted(USERS)


def test_messages(spark):
    messages = frame(spark, [("a.b", "p", 1), ("a.c", "q", 2), ("x", "r", 3)], "topic string, payload string, timestamp long")
    subs = frame(spark, [("s1", "a.*"), ("s2", "a.b"), ("s2", "a.*"), ("s3", "y")], "subscriber string, pattern string")
    assert {r.topic: r.delivered for r in feed.delivered_counts(messages, subs).collect()} == {"a.b": 3, "a.c": 2}
    assert tuple(feed.subscription_stats(subs).first()) == (3, 3)


def test_epoch_stamps_are_the_nearest_milliseconds(spark):
    micros = [0, 499, 500, 1499, 1500, 999499, 999500, -499, -500, -1499, -1500, -999500, -1000500, 1704067200999500, 9223372036854775306, None]
    rows = frame(spark, list(enumerate(micros)), "i int, us long").selectExpr("i", "us", "cast(timestamp_micros(us) as timestamp_ntz) as plain", "timestamp_micros(us) as zoned")
    duck = duckdb.connect()
    for column in ("plain", "zoned"):
        got = rows.select("us", X.epoch_ms(F.col(column)), X.epoch_seconds(F.col(column))).orderBy("i").collect()
        assert list(map(tuple, got)) == [(us, *duck.execute("SELECT epoch_ms(t), CAST(floor(epoch_ms(t) / 1000.0) AS BIGINT) FROM (SELECT make_timestamp(?::BIGINT) AS t)", [us]).fetchone()) for us in micros]
        assert [r[1:] for r in got[:9]] == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (999, 0), (1000, 1), (0, 0), (-1, -1)]


def test_rate_limit(spark, tmp_path):
    rows = [("a", t, i) for i, t in enumerate([0, 0, 0, 500, 1000, 1000])] + [("b", 5, 9)]
    requests = frame(spark, rows, "client string, at_ms long, seq long")
    want = {(c, s): ok for (c, _, s), ok in zip(rows, [True, True, False, False, True, False, True])}
    assert {(r.client, r.seq): r.allowed for r in feed.rate_limit(requests, 1.0, 2.0).collect()} == want
    for i, part in enumerate((requests.where("at_ms < 500"), requests.where("at_ms >= 500"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in")
        got = feed.to_table(feed.rate_limit(stream, 1.0, 2.0), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert {(r.client, r.seq): r.allowed for r in got.collect()} == want


def test_rate_limit_of_requests_without_a_time(spark, tmp_path):
    big = (1 << 60) + 1  # a float would lose its last digit
    rows = [("a", None, big), ("a", 0, big + 1), ("a", 0, 2), ("a", 1000, None), ("a", 1000, big + 2), ("b", None, 3), ("b", None, 1), ("b", None, None), (None, 5, 6)]
    requests = frame(spark, rows, "client string, at_ms long, seq long")
    want = {(*r, ok) for r, ok in zip(rows, [False, True, True, False, True, True, True, False, True])}
    assert {tuple(r) for r in feed.rate_limit(requests, 1.0, 2.0).collect()} == want
    requests.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = feed.to_table(feed.rate_limit(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in"), 1.0, 2.0), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert {tuple(r) for r in got.collect()} == want
    frame(spark, [("b", 9000, 7), ("b", 10000, 8), ("b", 10000, 9)], "client string, at_ms long, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = feed.to_table(feed.rate_limit(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in"), 1.0, 2.0), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert {tuple(r) for r in got.collect()} == want | {("b", 9000, 7, False), ("b", 10000, 8, True), ("b", 10000, 9, False)}


def test_window_stream_waits_for_the_watermark(spark, tmp_path):
    rows = spark.range(100).selectExpr("timestamp_seconds(id * 60) ts", "id % 2 k")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = feed.to_table(feed.windowed(stream, "ts", "10 minutes", "0 seconds", "k"), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert {(r.k, r.n) for r in got.collect()} == {(0, 5), (1, 5)} and got.count() == 18


def test_deadline_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "ts timestamp, seq long, op string, key string, expires_at_ms long"
    first = "select timestamp_millis(1) ts, 1L seq, 'ttl_set' op, 'a' key, 5000L expires_at_ms union all select timestamp_millis(1), 2L, 'ttl_set', 'b', 6000L union all select timestamp_millis(1), 3L, 'ttl_remove', 'b', null union all select timestamp_millis(2), 4L, 'ttl_set', 'c', 900000L"
    spark.sql(first).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for at in (0, 1):
        stream = feed.expiry_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        got = feed.to_table(stream, f"{tmp_path}/cp", f"{tmp_path}/out")
        spark.sql(f"select timestamp_millis({20000 + at}) ts, {9 + at}L seq, 'put' op, 'z' key, cast(null as bigint) expires_at_ms").write.mode("append").parquet(f"{tmp_path}/in")
    got = feed.to_table(feed.expiry_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert [tuple(r) for r in got.collect()] == [("a", 5000)]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
