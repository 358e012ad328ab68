"""Streams over the operation log: change feed, subscriptions, published messages, deadlines and rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import glob, topic_matches
from ..sources.oplog import SCHEMA


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of a log (OpLog.log_path) as a stream, through all its generations; ``files_per_trigger`` is the back-pressure."""
    reader = spark.readStream.schema(SCHEMA + ", generation int, shard int")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).drop("generation", "shard")


def change_feed(ops: DataFrame, *patterns: str) -> DataFrame:
    """(seq, event, key, value) of puts (update), deletes and expiries (delete), tags and counter steps (incr, with the step), each given once, for the keys that match any pattern. Works on streams and tables."""
    op = F.col("op")
    event = F.when(op == "put", "update").when(op.isin("delete", "expire"), "delete").when(op.isin("tag", "untag", "incr"), op)
    rows = ops.select("seq", event.alias("event"), "key", F.when(op.isin("put", "incr"), F.col("value")).alias("value"))
    return rows.where(F.col("event").isNotNull() & glob(F.col("key"), *patterns))


#: Lengths of the literal starts and ends by which keys and patterns meet.
ANCHORS = (12, 4)


def _anchor(pattern: Column) -> Column:
    """What a matching key surely has: the whole key, or a start or an end of one of the lengths of ANCHORS; nothing where the pattern's literal parts are shorter."""
    start, end = F.regexp_extract(pattern, r"(?s)^([^*?]*)", 1), F.regexp_extract(pattern, r"(?s)([^*?]*)\z", 1)
    out = F.when(~pattern.rlike("[*?]"), F.concat(F.lit("="), pattern))
    for n in ANCHORS:
        out = out.when(F.length(start) >= n, F.concat(F.lit(f"{n}<"), F.substring(start, 1, n))).when(F.length(end) >= n, F.concat(F.lit(f"{n}>"), F.substring(end, -n, n)))
    return out.otherwise(F.lit(""))


def _anchors(key: Column) -> Column:
    """All that a pattern which matches the key may have as its anchor."""
    cuts = [F.when(F.length(key) >= n, F.concat(F.lit(f"{n}{side}"), F.substring(key, 1 if side == "<" else -n, n))) for n in ANCHORS for side in "<>"]
    return F.array_compact(F.array(F.lit(""), F.concat(F.lit("="), key), *cuts))


def deliver_changes(feed: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(client, seq, event, key, value): changes for static subscriptions (client, pattern), once for each client. Patterns are globs. Works on streams and tables.

    Keys and patterns meet by equal anchors, so a pattern is tried on the keys that have its literal start or end; only one without either meets all. A key that
    several patterns of a client match is given for the first of them, which needs no state.
    """
    regex = F.regexp_replace(F.col("pattern"), r"([\\.\[\]{}()+^$|])", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(regex, r"\*", ".*"), r"\?", "."), F.lit(r"\z"))
    subs = subscriptions.select("client", "pattern").distinct().select("client", _anchor(F.col("pattern")).alias("anchor"), regex.alias("regex"))
    before = F.collect_list("regex").over(Window.partitionBy("client").orderBy("regex").rowsBetween(Window.unboundedPreceding, -1))
    subs = subs.withColumn("earlier", F.concat_ws("|", before))
    met = feed.withColumn("anchor", F.explode(_anchors(F.col("key")))).join(subs, "anchor")
    first = F.rlike(F.col("key"), F.col("regex")) & ((F.col("earlier") == "") | ~F.rlike(F.col("key"), F.col("earlier")))
    return met.where(first).select("client", "seq", "event", "key", "value")


def deliver(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, topic, payload, timestamp) for messages (topic, payload, timestamp) and subscriptions (subscriber, pattern), once for each matching subscription.

    Patterns without * meet their messages by an equality join. The others meet the topics that occur, once each, by the number of segments and by their
    first segment that is not *; those of * alone meet all topics of their length, and match them.
    """
    plain, wild = (subscriptions.where(c) for c in (~F.contains("pattern", F.lit("*")), F.contains("pattern", F.lit("*"))))
    exact = messages.join(plain.select("subscriber", F.col("pattern").alias("topic")), "topic").select("subscriber", "topic", "payload", "timestamp")
    split = messages.select("topic").distinct().withColumn("all", F.split("topic", r"\."))
    topics = split.select("topic", F.size("all").alias("n"), F.posexplode("all").alias("i", "part")).unionByName(split.select("topic", F.size("all").alias("n"), F.lit(-1).alias("i"), F.lit("").alias("part")))
    of = F.split("pattern", r"\.")
    i = F.coalesce(F.array_position(F.transform(of, lambda x: x != "*"), True) - 1, F.lit(-1)).cast("int")
    wild = wild.select("subscriber", "pattern", F.size(of).alias("n"), i.alias("i"), F.when(i >= 0, F.get(of, i)).otherwise(F.lit("")).alias("part"))
    fits = topics.join(wild, ["n", "i", "part"]).where(topic_matches(F.col("pattern"), F.col("topic"))).select("topic", "subscriber")
    return exact.unionByName(messages.join(fits, "topic").select("subscriber", "topic", "payload", "timestamp"))


def delivered_counts(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(topic, delivered)."""
    return deliver(messages, subscriptions).groupBy("topic").agg(F.count("*").alias("delivered"))


def subscription_stats(subscriptions: DataFrame) -> DataFrame:
    """(subscribers, patterns)."""
    return subscriptions.agg(F.countDistinct("subscriber").alias("subscribers"), F.countDistinct("pattern").alias("patterns"))


def collect_stream(stream: DataFrame, checkpoint: str, then: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over what is there, and gives each batch to ``then``; a restart with the same checkpoint goes on where it stopped."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(then).trigger(availableNow=True).start()
    query.awaitTermination()


def to_table(stream: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Runs a stream over what is there into a Parquet folder, exactly once, and gives the folder's rows."""
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def snapshot_every(ops: DataFrame, log, checkpoint: str) -> None:
    """A snapshot after each batch of a stream of the log that brought operations; run again with the same checkpoint, it goes on with what was appended since."""
    collect_stream(ops, checkpoint, lambda df, n: log.snapshot() if not df.isEmpty() else None)


def windowed(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """An extension: counts in tumbling windows, with a watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def expiry_stream(ops: DataFrame) -> DataFrame:
    """(key, expired_at_ms): keys whose deadline passed, by event time: a timer for each key, and the log's time (column ts) as the clock."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Deadlines(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("deadline", "at bigint")

        def _drop(self):
            if self.state.exists():
                self.handle.deleteTimer(self.state.get()[0])
                self.state.clear()

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            import pandas as pd

            last = None
            for p in rows:
                p = p[p["op"].isin(["ttl_set", "ttl_remove", "delete"])]
                if len(p):
                    r = p.loc[p["seq"].idxmax()]
                    last = r if last is None or r["seq"] > last["seq"] else last
            if last is not None:
                self._drop()
                if last["op"] == "ttl_set":
                    at = int(last["expires_at_ms"])
                    self.state.update((at,))
                    self.handle.registerTimer(at)
            yield pd.DataFrame({"key": [], "expired_at_ms": []}).astype({"key": str, "expired_at_ms": "int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import pandas as pd

            at = int(expiredTimerInfo.getExpiryTimeInMs())
            self.state.clear()
            yield pd.DataFrame({"key": [key[0]], "expired_at_ms": [at]})

        def close(self) -> None:
            pass

    rows = ops.withWatermark("ts", "0 seconds")
    return rows.groupBy("key").transformWithStateInPandas(Deadlines(), outputStructType="key string, expired_at_ms bigint", outputMode="append", timeMode="eventTime")


def rate_limit(requests: DataFrame, rate: float = 1000.0, burst: float = 2000.0) -> DataFrame:
    """(client, at_ms, seq, allowed): a token bucket for each client over a stream or table of requests (client, at_ms, seq).

    Each client starts with ``burst`` tokens and gains ``rate`` a second. On a stream the bucket is kept as state between batches. On a table a client's requests
    pass in order through one task, which holds one batch of them at a time. Requests without a time come after a client's others (on a stream, after those of their
    batch) and bring no tokens; those without a client share a bucket.
    """
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    def spend(tokens, last, times):
        out = []
        for at in times:
            if at is not None:
                if last is not None:
                    tokens = min(burst, tokens + max(0, at - last) * rate / 1000.0)
                last = at if last is None else max(last, at)
            out.append(tokens >= 1.0)
            tokens -= 1.0 if out[-1] else 0.0
        return tokens, last, out

    def run(batches):
        client = tokens = last = None
        for b in batches:
            runs, at, allowed = pc.run_end_encode(b.column("client")), b.column("at_ms"), []  # sorted, so a client's rows are together
            times = at.to_pylist() if at.null_count else at.to_numpy().tolist()
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if client is None or name != client[0]:
                    client, tokens, last = (name,), burst, None
                tokens, last, out = spend(tokens, last, times[len(allowed) : end])
                allowed += out
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(allowed, pa.bool_())], [*b.schema.names, "allowed"])

    rows = requests.select(F.col("client").cast("string"), F.col("at_ms").cast("bigint"), F.col("seq").cast("bigint"))
    if not requests.isStreaming:
        order = F.asc("client"), F.asc_nulls_last("at_ms"), F.asc_nulls_last("seq")
        return rows.repartition("client").sortWithinPartitions(*order).mapInArrow(run, "client string, at_ms bigint, seq bigint, allowed boolean")

    def step(key, batches, state):
        p = pd.concat(list(batches)).sort_values(["no_at_ms", "at_ms", "no_seq", "seq"])
        tokens, last = state.get if state.exists else (burst, None)
        tokens, last, out = spend(tokens, last, [None if no else at for at, no in zip(p["at_ms"].tolist(), p["no_at_ms"].tolist())])
        state.update((float(tokens), last))
        yield p.assign(allowed=out)

    # nulls apart, as pandas makes floats of numbers that stand beside them
    parts = rows.select("client", *(c for n in ("at_ms", "seq") for c in (F.coalesce(n, F.lit(0)).alias(n), F.isnull(n).alias(f"no_{n}"))))
    schema = "client string, at_ms bigint, no_at_ms boolean, seq bigint, no_seq boolean, allowed boolean"
    out = parts.groupBy("client").applyInPandasWithState(step, schema, "tokens double, last bigint", "append", "NoTimeout")
    return out.select("client", *(F.when(~F.col(f"no_{n}"), F.col(n)).alias(n) for n in ("at_ms", "seq")), "allowed")
