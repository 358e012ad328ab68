"""Views of tables as stores of keys and values, and readers and writers of files of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TextKey:
    """Keys that are made of a prefix and a number padded with zeros. Bounds on the text become bounds on the number, which a scan can use."""

    column: str
    prefix: str
    width: int

    def text(self) -> Column:
        number = F.col(self.column).cast("string")
        return F.concat(F.lit(self.prefix), F.when(F.length(number) < self.width, F.lpad(number, self.width, "0")).otherwise(number))

    def number(self, bound: str) -> int | None:
        m = re.fullmatch(re.escape(self.prefix) + rf"(\d{{{self.width}}})", bound)
        return int(m[1]) if m else None

    def check(self, df: DataFrame) -> None:
        """Numbers must fit the width, else text order is not the order of numbers."""
        low, high = df.agg(F.min(self.column), F.max(self.column)).first()
        if low is not None and (low < 0 or high >= 10**self.width):
            raise ValueError(f"{self.column} runs from {low} to {high}: more than {self.width} digits")


@dataclass(frozen=True)
class StoreSpec:
    """Which columns of a table are a store's key and value."""

    key: str | TextKey
    value: str

    def columns(self, df: DataFrame) -> DataFrame:
        if isinstance(self.key, TextKey):
            return df.select(self.key.text().alias("key"), F.col(self.value).alias("value"), F.col(self.key.column).alias("_number"), F.lit(True).alias("_typed"))
        return df.select(F.col(self.key).alias("key"), F.col(self.value).alias("value"))


def few(keys: DataFrame) -> DataFrame:
    """Distinct keys, to join by. Whether they are sent to all tasks is left to the planner, which goes by their size in bytes; more of them join by a shuffle."""
    return keys.select("key").distinct()


KEY_KINDS = (T.StringType, T.BinaryType, T.LongType, T.IntegerType, T.DecimalType)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Keys and values from Parquet, ORC, JSON lines or CSV files with columns key and value."""
    reader = spark.read.options(**options)
    if fmt in ("csv", "json"):
        reader = reader.schema("key string, value string")
    return reader.format(fmt).load(path).select("key", "value")


def write_pairs(df: DataFrame, path: str, fmt: str = "parquet", shards: int | None = None) -> None:
    """Writes a store; with ``shards`` its rows lie in folders by the hash of the key."""
    out = df.select("key", "value")
    if shards:
        out = out.withColumn("shard", F.pmod(F.hash("key"), F.lit(shards)))
        out.repartition("shard").write.partitionBy("shard").format(fmt).mode("overwrite").save(path)
    else:
        out.write.format(fmt).mode("overwrite").save(path)
