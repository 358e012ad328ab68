"""Joins of stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Bound, KVStore


def hash_join(left: KVStore, right: KVStore, left_key: Column, right_key: Column, left_range: tuple[Bound, Bound] = (Bound(), Bound()), right_range: tuple[Bound, Bound] = (Bound(), Bound()), how: str = "inner") -> DataFrame:
    """(join_key, left_key, left_value, right_key, right_value) for all pairs with equal join keys, after a key range on each side.

    The side to hash or to broadcast is chosen from statistics, and adaptive execution splits keys that hold many rows.
    """
    a = left.range_unordered(*left_range).df.select(left_key.alias("join_key"), F.col("key").alias("left_key"), F.col("value").alias("left_value"))
    b = right.range_unordered(*right_range).df.select(right_key.alias("join_key"), F.col("key").alias("right_key"), F.col("value").alias("right_value"))
    if how in ("left_semi", "left_anti"):
        return a.join(b, "join_key", how)
    return a.join(b, "join_key", how).select("join_key", "left_key", "left_value", "right_key", "right_value")


def build_probe(build: DataFrame, probe: DataFrame) -> DataFrame:
    """(key, left, right) of two frames (key, left) and (key, right); one build row meets all its probe rows."""
    return build.join(probe, "key").select("key", "left", "right")


def self_join(store: KVStore) -> DataFrame:
    """The store with itself on the key."""
    a = store.pairs().select(F.col("key").alias("a_key"), F.col("value").alias("a_value"))
    b = store.pairs().select(F.col("key").alias("b_key"), F.col("value").alias("b_value"))
    return a.join(b, F.col("a_key") == F.col("b_key"))


def join_order(left_rows: int, right_rows: int) -> tuple[bool, str]:
    """(whether to build on the left, why): the smaller side, the left of equals."""
    left = left_rows <= right_rows
    side, n, other = ("left", left_rows, right_rows) if left else ("right", right_rows, left_rows)
    return left, f"build on the {side} side: {n} rows against {other}"


def tag_semi_join(store: KVStore, tags: DataFrame, tag: int) -> DataFrame:
    """(key, value) of the keys with a tag."""
    return store.pairs().join(tags.where(F.col("tag") == tag).select("key").distinct(), "key", "left_semi")
