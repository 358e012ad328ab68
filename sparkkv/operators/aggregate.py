"""Whole-store and grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .store import KVStore


def target_number(store: KVStore, target: str = "value") -> Column:
    """The key as a number, or for any other target the value."""
    name = "key" if target == "key" else "value"
    return X.number(F.col(name), store.df.schema[name].dataType)


def numbers(store: KVStore, target: str = "value") -> DataFrame:
    """(count, sum, avg, min, max) where what is no number counts as 0: of an empty store the sum is 0 and the others are null."""
    n = target_number(store, target)
    return store.df.agg(F.count("*").alias("count"), F.coalesce(F.sum(n), F.lit(0.0)).alias("sum"), F.avg(n).alias("avg"), F.min(n).alias("min"), F.max(n).alias("max"))


class Aggregator:
    """Groups of a frame by a key expression. Built-in aggregates combine before the shuffle."""

    def __init__(self, df: DataFrame, key: Column | str):
        self.df, self.key = df, (F.col(key) if isinstance(key, str) else key).alias("group")

    def agg(self, **columns: Column) -> DataFrame:
        return self.df.groupBy(self.key).agg(*[c.alias(n) for n, c in columns.items()])

    def count(self) -> DataFrame:
        return self.agg(n=F.count("*"))

    def sum(self, of: Column) -> DataFrame:
        return self.agg(total=F.sum(of))

    def avg(self, of: Column) -> DataFrame:
        return self.agg(mean=F.avg(of.cast("double")))

    def min(self, of: Column) -> DataFrame:
        return self.agg(low=F.min(of))

    def max(self, of: Column) -> DataFrame:
        return self.agg(high=F.max(of))

    def aggregate(self, fn: Callable, kind: str, of: Column) -> DataFrame:
        """Any Python function of a group's values, which must fit into one task's memory; built-in aggregates have no such bound."""

        import pandas as pd

        rows = self.df.select(self.key, of.alias("of"))
        schema = T.StructType([T.StructField("group", rows.schema["group"].dataType), T.StructField("result", T._parse_datatype_string(kind))])
        return rows.groupBy("group").applyInPandas(lambda p: pd.DataFrame({"group": [p["group"].iloc[0]], "result": [fn(p["of"])]}), schema)

    def groups(self, *columns: str) -> DataFrame:
        """(group, rows): the rows of each group, sorted."""
        return self.df.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


def selectivity(df: DataFrame, condition: Column) -> DataFrame:
    """(selectivity): the share of rows that match; 0 of no rows. A sample is taken before, with df.sample()."""
    return df.agg(F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0)).alias("selectivity"))
