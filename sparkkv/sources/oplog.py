"""A mutable store as an append-only log of operations, and its state as a fold over the log.

ops(seq, op, key, value, tag, expires_at_ms). Only the order of operations on one key matters. A fold is grouped aggregations with conditional
maxima, combined before their shuffle, and joins of operations with a row for each key. So that a key with very many operations does not
land in one task, the sides of such a join are shuffled for the join itself (see ``_anew``), and adaptive execution splits that key.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import StoreConfig
from ..functions import text as X
from ..operators import stats
from .adapters import few

SCHEMA = "seq bigint, op string, key string, value string, tag bigint, expires_at_ms bigint"
#: expire is the delete of a key whose deadline has passed; incr adds the number in value.
KINDS = ("put", "delete", "expire", "tag", "untag", "ttl_set", "ttl_remove", "incr")
ENDS = ("delete", "expire")


def _upto(ops: DataFrame, as_of_seq: int | None) -> DataFrame:
    return ops if as_of_seq is None else ops.where(F.col("seq") <= as_of_seq)


def of_keys(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """The operations on some keys, which is all that a fold for these keys needs; few keys do not make the log move."""
    return ops.join(few(keys), "key", "left_semi").select(*ops.columns)


def _anew(df: DataFrame) -> DataFrame:
    """The same keys as a new expression. What was grouped by key before counts as not yet laid out by it, so the join or the grouping that follows shuffles for itself:
    only such joins does adaptive execution split where one key has most rows."""
    return df.withColumn("key", F.concat("key", F.lit("")))


def _last(*ops: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("op").isin(*ops), F.col("seq"))), F.lit(-1))


def _step() -> Column:
    bad = F.raise_error(F.concat(F.lit("not an integer: "), F.coalesce("value", F.lit("null")))).cast("bigint")
    step = X.integer(F.col("value"))
    return F.when(step.isNull(), bad).otherwise(step)


def entries(ops: DataFrame, as_of_seq: int | None = None) -> DataFrame:
    """(key, value) of the keys that are there: the last put, and the steps of incr since; a missing key counts from 0.

    A step that is no integer, a step on a text that is none, and overflow raise an error.
    """
    rows = _upto(ops, as_of_seq)
    base = rows.where(F.col("op").isin("put", *ENDS)).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"), F.max("seq").alias("at"))
    steps = rows.where("op = 'incr'").select("key", F.col("seq").alias("s"), _step().alias("step"))
    live = steps.join(_anew(base.select("key", "at")), "key", "left").where("s > coalesce(at, -1)")
    sums = _anew(live).groupBy("key").agg(F.sum("step").alias("steps"))
    both = base.where("last.op = 'put'").select("key", F.col("last.value").alias("value"), F.lit(True).alias("there")).join(sums, "key", "full")
    now = X.integer(F.when(F.col("there"), F.col("value")).otherwise(F.lit("0")))
    bad = F.raise_error(F.concat(F.lit("not an integer: "), F.coalesce("value", F.lit("null")))).cast("bigint")
    stepped = F.when(now.isNull(), bad).otherwise(now + F.col("steps")).cast("string")
    return both.select("key", F.when(F.col("steps").isNull(), F.col("value")).otherwise(stepped).alias("value"))


def _lives(ops: DataFrame) -> DataFrame:
    """(key, born): the first put or incr since the last delete; keys that are there now. Puts do not start a life anew."""
    rows = ops.where(F.col("op").isin("put", "incr", *ENDS))
    ends = rows.groupBy("key").agg(_last(*ENDS).alias("died"), _last("put", "incr").alias("put")).where("put > died")
    puts = rows.where("op in ('put', 'incr')").select("key", "seq")
    born = puts.join(_anew(ends.select("key", "died")), "key").where("seq > died")
    return _anew(_anew(born).groupBy("key").agg(F.min("seq").alias("born")))


def tags(ops: DataFrame, as_of_seq: int | None = None) -> DataFrame:
    """(key, tag) now set. A tag counts only if the key was there when it was set; a delete takes the tags away, a put does not."""
    rows = _upto(ops, as_of_seq)
    marks = rows.where(F.col("op").isin("tag", "untag")).select("key", "tag", "seq", "op")
    live = _anew(marks.join(_lives(rows), "key").where("seq > born"))
    last = live.groupBy("key", "tag").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'tag'").select("key", "tag")


def ttls(ops: DataFrame, as_of_seq: int | None = None) -> DataFrame:
    """(key, expires_at_ms) now set. A put keeps a deadline, a delete drops it."""
    rows = _upto(ops, as_of_seq)
    marks = rows.where(F.col("op").isin("ttl_set", "ttl_remove")).select("key", "seq", "op", "expires_at_ms")
    live = _anew(marks.join(_lives(rows), "key").where("seq > born"))
    last = live.groupBy("key").agg(F.max_by(F.struct("op", "expires_at_ms"), "seq").alias("last"))
    return last.where("last.op = 'ttl_set'").select("key", F.col("last.expires_at_ms").alias("expires_at_ms"))


def expired(deadlines: DataFrame, as_of_ms: int) -> DataFrame:
    """A deadline that is reached has passed."""
    return deadlines.where(F.col("expires_at_ms") <= as_of_ms)


def visible(ops: DataFrame, as_of_ms: int, as_of_seq: int | None = None) -> DataFrame:
    """Entries without those whose deadline has passed."""
    return entries(ops, as_of_seq).join(expired(ttls(ops, as_of_seq), as_of_ms).select("key"), "key", "left_anti")


def ttl_read(keys: DataFrame, ops: DataFrame, as_of_ms: int, unit_ms: int = 1000) -> DataFrame:
    """(key, ttl) for the asked keys: -2 where there is no such key, -1 without a deadline, else whole units left."""
    ops = of_keys(ops, keys)
    now = visible(ops, as_of_ms).select("key", F.lit(True).alias("there"))
    left = keys.select("key").join(now, "key", "left").join(ttls(ops), "key", "left")
    rest = F.floor((F.col("expires_at_ms") - as_of_ms) / unit_ms).cast("bigint")
    return left.select("key", F.when(F.col("there").isNull(), F.lit(-2)).when(F.col("expires_at_ms").isNull(), F.lit(-1)).otherwise(rest).cast("bigint").alias("ttl"))


def rearmed(ops: DataFrame, as_of_ms: int) -> DataFrame:
    """(key, expires_at_ms): the deadlines that a restart at ``as_of_ms`` sets again, those still to come."""
    return ttls(ops).where(F.col("expires_at_ms") > as_of_ms)


def sweep(ops: DataFrame, as_of_ms: int, next_seq: int) -> DataFrame:
    """Expire operations for the keys whose deadline has passed, numbered from ``next_seq`` in key order within ranges. Once they are in the log, the next sweep has none."""
    gone = entries(ops).join(expired(ttls(ops), as_of_ms), "key", "left_semi").select("key")
    return _number(gone.select(F.lit("expire").alias("op"), "key"), next_seq)


def expire_returning(ops: DataFrame, batch: DataFrame, as_of_ms: int) -> DataFrame:
    """(key, done): whether a deadline of a batch (key, expires_at_ms) is set, which it is on keys that can be seen."""
    keys = batch.select("key").distinct()
    there = visible(of_keys(ops, keys), as_of_ms).select("key", F.lit(True).alias("there"))
    return keys.join(there, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("done"))


def persist_returning(ops: DataFrame, keys: DataFrame, as_of_ms: int) -> DataFrame:
    """(key, done): whether a deadline is there to be removed, on keys that can be seen."""
    keys = keys.select("key").distinct()
    mine = of_keys(ops, keys)
    armed = visible(mine, as_of_ms).select("key").join(ttls(mine).select("key"), "key").select("key", F.lit(True).alias("there"))
    return keys.join(armed, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("done"))


def _number(rows: DataFrame, next_seq: int) -> DataFrame:
    """Operations with increasing, not always consecutive, numbers; one per key, so any order among them will do."""
    have = rows.columns
    cols = [F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("op", "string"), ("key", "string"), ("value", "string"), ("tag", "bigint"), ("expires_at_ms", "bigint"))]
    return rows.select((F.monotonically_increasing_id() + next_seq).alias("seq"), *cols)


def put_returning(ops: DataFrame, batch: DataFrame) -> DataFrame:
    """(key, previous): what each put of a batch (key, value) replaces; null for a new key."""
    return batch.select("key").distinct().join(entries(of_keys(ops, batch)).withColumnRenamed("value", "previous"), "key", "left")


def delete_count(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """(removed): how many of the asked keys are there."""
    return entries(of_keys(ops, keys)).agg(F.count("*").alias("removed"))


def changes(ops: DataFrame, since: int) -> DataFrame:
    """Operations from ``since`` on, in order: what a replica that has all before needs."""
    return ops.where(F.col("seq") >= since)


def apply_changes(own: DataFrame, theirs: DataFrame) -> DataFrame:
    """A replica's log with the operations that it has not; those it has are not applied again."""
    top = own.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top"))
    return own.unionByName(theirs.join(F.broadcast(top), F.col("seq") > F.col("top")).drop("top"))


def truncate(ops: DataFrame, synced: int) -> DataFrame:
    """What is left when all replicas have the operations below ``synced``."""
    return ops.where(F.col("seq") >= synced)


@dataclass
class Batch:
    """Operations queued to be appended as one, or thrown away: a transaction. It notes the keys it reads, and conflicts with a log in which they changed."""

    since: int
    queued: list
    read: set

    @classmethod
    def begin(cls, last_seq: int) -> "Batch":
        return cls(last_seq, [], set())

    def add(self, op: str, key: str, value: str | None = None, tag: int | None = None, expires_at_ms: int | None = None) -> None:
        if op not in KINDS:
            raise ValueError(f"unknown operation: {op}")
        self.queued.append((op, key, value, tag, expires_at_ms))

    def touch(self, key: str) -> None:
        self.read.add(key)

    def commit(self, log: "OpLog") -> int:
        """Appends all or nothing; raises if a key that was read or is written has changed since the start."""
        ops = log.ops()
        keys = sorted(self.read | {q[1] for q in self.queued})
        if keys and not ops.where((F.col("seq") > self.since) & F.col("key").isin(keys)).isEmpty():
            raise RuntimeError("conflict: a key changed since the transaction began")
        return log.append_rows(self.queued)

    def write_set(self) -> tuple[list, list]:
        return [(q[1], q[2]) for q in self.queued if q[0] == "put"], [q[1] for q in self.queued if q[0] == "delete"]


class OpLog:
    """A folder with a log of Parquet files by generation, snapshots, and a manifest that names the current ones.

    Writers append files to the log, in the current generation's folder. A snapshot goes to a new folder first, and then one rename of the manifest makes it
    current, with the next generation, so a reader sees the old state or the new one. The log stays one folder through all generations: a stream of it
    goes on across snapshots. A single writer is assumed, as for the manifest, which also holds the largest number given: it is set before the rows are written.

    ``config`` is kept in the manifest of a new log: its shards are the folders by the key's hash, its limits decide whether a put is refused and how
    much is to be evicted, its seconds when a snapshot is due.
    """

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(self._p("manifest.json")):
            self._fs.mkdirs(self._hadoop.Path(self.path))
            self._publish({"generation": 0, "snapshot": None, "max_seq": -1, "last": -1, "snapshot_ms": 0, "config": (config or StoreConfig()).validate().dumps()})
        self.config = StoreConfig.loads(self.manifest()["config"])

    @property
    def log_path(self) -> str:
        """The folder that a stream of the log reads."""
        return f"{self.path}/log"

    def _p(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _publish(self, manifest: dict) -> None:
        tmp = self._p(f".manifest-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(tmp, self._p("manifest.json"), overwrite)

    def manifest(self) -> dict:
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/manifest.json").first()[1])

    def ops(self) -> DataFrame:
        """Operations since the current snapshot."""
        at = self._p("log")
        if not self._fs.exists(at):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(f"{SCHEMA}, generation int, shard int").parquet(str(at))
        return rows.where(F.col("generation") >= self.manifest()["generation"]).select("seq", "op", "key", "value", "tag", "expires_at_ms")

    def last_seq(self) -> int:
        return self.manifest()["last"]

    def append(self, ops: DataFrame, spread: int = 1) -> None:
        """Numbered operations, by the hash of their key, compressed. A shard's rows are written by ``spread`` tasks; raise it for large batches."""
        top = ops.agg(F.max("seq")).first()[0]
        if top is None:
            return
        m = self.manifest()
        self._publish(m | {"last": max(m["last"], top)})
        rows = ops.select("seq", "op", "key", "value", "tag", "expires_at_ms").withColumn("generation", F.lit(m["generation"])).withColumn("shard", F.pmod(F.hash("key"), F.lit(self.config.shards)))
        rows = rows.repartition("shard", F.pmod("seq", F.lit(spread)))
        rows.write.option("compression", "zstd").partitionBy("generation", "shard").mode("append").parquet(self.log_path)

    def append_rows(self, rows: list) -> int:
        """Refused under the policy none, if there is a limit and it is reached, should the rows put anything."""
        if any(r[0] in ("put", "incr") for r in rows) and (self.config.max_keys or self.config.max_bytes) and self.pressure()["refuse"]:
            raise MemoryError("the store is full, and its policy evicts nothing")
        if rows:
            at = self.last_seq() + 1
            self.append(self.spark.createDataFrame([(at + i, *r) for i, r in enumerate(rows)], SCHEMA))
        return len(rows)

    def pressure(self) -> dict:
        """keys, bytes, whether puts are refused, and how many bytes are to be evicted, by the settings."""
        c, (keys, used) = self.config, stats.memory(entries(self.state())).first()
        evict = 0 if c.eviction == "none" else stats.bytes_to_evict(used, c.max_bytes, c.evict_percent)
        return {"keys": keys, "bytes": used, "refuse": stats.must_refuse(c.eviction, keys, c.max_keys, used, c.max_bytes), "evict": evict}

    def snapshot_due(self, now_ms: int) -> bool:
        """Whether ``snapshot_seconds`` have passed since the last snapshot; never with 0."""
        return self.config.snapshot_seconds > 0 and now_ms - self.manifest()["snapshot_ms"] >= 1000 * self.config.snapshot_seconds

    def state(self) -> DataFrame:
        """The snapshot as operations before the log, and the log: what all folds run on."""
        m, ops = self.manifest(), self.ops()
        if not m["snapshot"]:
            return ops
        base = f"{self.path}/{m['snapshot']}"
        e = self.spark.read.schema("key string, value string").parquet(f"{base}/entries").selectExpr("-3L as seq", "'put' as op", "key", "value", "cast(null as bigint) tag", "cast(null as bigint) expires_at_ms")
        t = self.spark.read.schema("key string, tag bigint").parquet(f"{base}/tags").selectExpr("-2L as seq", "'tag' as op", "key", "cast(null as string) value", "tag", "cast(null as bigint) expires_at_ms")
        d = self.spark.read.schema("key string, expires_at_ms bigint").parquet(f"{base}/ttls").selectExpr("-1L as seq", "'ttl_set' as op", "key", "cast(null as string) value", "cast(null as bigint) tag", "expires_at_ms")
        lift = F.col("seq") + 3
        return e.unionByName(t).unionByName(d).unionByName(ops.where(F.col("seq") > m["max_seq"])).withColumn("seq", lift)

    def snapshot(self, now_ms: int | None = None) -> dict:
        """Writes the folded state and makes it current, with a new generation of the log."""
        state, m, name = self.state(), self.manifest(), f"snapshot-{uuid.uuid4().hex[:12]}"
        for part, df in (("entries", entries(state)), ("tags", tags(state)), ("ttls", ttls(state))):
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}/{part}")
        self._publish(m | {"generation": m["generation"] + 1, "snapshot": name, "max_seq": m["last"], "snapshot_ms": int(time.time() * 1000) if now_ms is None else now_ms})
        return self.manifest()

    def flush_all(self) -> None:
        """Every key goes: a new generation without entries."""
        m = self.manifest()
        self._publish(m | {"generation": m["generation"] + 1, "snapshot": None, "max_seq": m["last"]})

    def vacuum(self, keep: int = 1) -> int:
        """Removes old snapshots, and the generations before the last ``keep`` old ones, which streams of the log may still have to read; gives their number."""
        m, gone = self.manifest(), 0
        old = [s.getPath() for s in self._fs.listStatus(self._hadoop.Path(self.path)) if s.getPath().getName().startswith("snapshot-") and s.getPath().getName() != m["snapshot"]]
        if self._fs.exists(self._p("log")):
            for s in self._fs.listStatus(self._p("log")):
                name = s.getPath().getName()
                if name.startswith("generation=") and int(name[11:]) < m["generation"] - keep:
                    old.append(s.getPath())
        for path in old:
            self._fs.delete(path, True)
            gone += 1
        return gone

    def report(self) -> DataFrame:
        """(kind, n): what recovery would read."""
        m = self.manifest()
        rows = self.ops().groupBy(F.col("op").alias("kind")).agg(F.count("*").alias("n"))
        if m["snapshot"]:
            for part in ("entries", "tags", "ttls"):
                rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/{m['snapshot']}/{part}").agg(F.lit(f"snapshot {part}").alias("kind"), F.count("*").alias("n")))
        return rows
