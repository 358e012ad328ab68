"""Statistics of stores, deadlines, replicas and operation traces, and eviction as a batch policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approximate_size


def ttl_stats(deadlines: DataFrame, as_of_ms: int) -> DataFrame:
    """(keys_with_ttl, next_expiry_ms): how many, and the time to the next, not below 0."""
    return deadlines.agg(F.count("*").alias("keys_with_ttl"), F.greatest(F.min("expires_at_ms") - as_of_ms, F.lit(0)).alias("next_expiry_ms"))


def metrics(trace: DataFrame) -> DataFrame:
    """Totals of a trace (op, hit, nanos): gets, puts, deletes, hit_rate (0 without lookups), and mean latencies in whole nanoseconds."""

    def total(op):
        return F.count_if(F.col("op") == op)

    def mean(op):
        n = total(op)
        return F.when(n > 0, F.floor(F.coalesce(F.sum(F.when(F.col("op") == op, F.col("nanos"))), F.lit(0)) / F.greatest(n, F.lit(1)))).otherwise(0).cast("bigint")

    hits = F.count_if((F.col("op") == "get") & F.col("hit"))
    return trace.agg(
        total("get").alias("gets"), total("put").alias("puts"), total("delete").alias("deletes"), F.when(total("get") > 0, hits / F.greatest(total("get"), F.lit(1))).otherwise(0.0).alias("hit_rate"), mean("get").alias("get_nanos"), mean("put").alias("put_nanos"), mean("delete").alias("delete_nanos")
    )


def replication_stats(replicas: DataFrame, current: int) -> DataFrame:
    """(max_lag, min_synced) of replicas (replica, synced); without any the current sequence is synced."""
    return replicas.agg(F.coalesce(F.max(F.lit(current) - F.col("synced")), F.lit(0)).alias("max_lag"), F.coalesce(F.min("synced"), F.lit(current)).alias("min_synced"))


def recovery_stats(ops: DataFrame) -> DataFrame:
    """(op, n)."""
    return ops.groupBy("op").agg(F.count("*").alias("n"))


def memory(store: DataFrame) -> DataFrame:
    """(keys, bytes) by the size model."""
    return store.agg(F.count("*").alias("keys"), F.coalesce(F.sum(approximate_size(F.col("key").cast("string"), F.col("value").cast("string"))), F.lit(0)).alias("bytes"))


def victims(trace: DataFrame, policy: str, n: int, ttl_keys: DataFrame | None = None) -> DataFrame:
    """(key, rank): which n keys an access trace (seq, key) gives up first.

    lru: longest not used; lfu: least often used, longest not used of equals; random: the first by a hash; volatile_lru: lru among the keys of
    ``ttl_keys``; none: no key. Ties go to the smaller key.
    """
    use = trace.groupBy("key").agg(F.max("seq").alias("last"), F.count("*").alias("uses"))
    if policy == "none":
        return use.limit(0).select("key", F.lit(0).alias("rank"))
    if policy == "volatile_lru":
        if ttl_keys is None:
            raise ValueError("volatile_lru needs the keys with a deadline")
        use = use.join(ttl_keys.select("key").distinct(), "key", "left_semi")
    order = {"lru": ["last"], "volatile_lru": ["last"], "lfu": ["uses", "last"], "random": [F.md5(F.col("key").cast("binary"))]}[policy]
    first = use.orderBy(*order, "key").limit(n)
    return first.select("key", F.row_number().over(Window.orderBy(*order, "key")).alias("rank"))  # over n rows, streamed


def must_refuse(policy: str, keys: int, max_keys: int, used: int, max_bytes: int) -> bool:
    """Limits refuse new entries only under the policy none; a limit of 0 is no limit."""
    return policy == "none" and (0 < max_keys <= keys or 0 < max_bytes <= used)


def bytes_to_evict(used: int, max_bytes: int, percent: int) -> int:
    """Nothing below the limit, else what is above it less ``percent`` of it."""
    return 0 if used < max_bytes or max_bytes == 0 else used - max_bytes * (100 - percent) // 100


def advice(hit_rate: float, moves_per_op: float, overflow_share: float, resizes: int) -> list[str]:
    """Hints from thresholds."""
    out = []
    if hit_rate < 0.95:
        out.append("few lookups find their key: cluster the table by key, so that scans skip files")
    if moves_per_op > 10:
        out.append("entries move often: use more buckets")
    if overflow_share > 0.01:
        out.append("buckets overflow: use more, or salt the hot keys")
    if resizes > 10:
        out.append("the table is often rebuilt: compact the log less often")
    return out
