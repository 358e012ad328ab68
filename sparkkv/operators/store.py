"""A store of keys and values over a DataFrame: lookups, ordered ranges, pattern scans and mutations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.predicates import Columns, Condition, Numbered, to_column
from ..sources.adapters import StoreSpec, TextKey, few

#: Most keys that a pattern scan gives before it refuses (fixed value).
KEYS_CAP = 10_000


@dataclass(frozen=True)
class Bound:
    """An end of a range: a value that is in it or not, or no end."""

    value: object = None
    included: bool = True

    @classmethod
    def unbounded(cls) -> "Bound":
        return cls(None)


@dataclass(frozen=True)
class KVStore:
    """df has columns key and value. Keys are unique: a table with several rows of a key is first folded (sources.oplog).

    Beside a TextKey it also has _number, and _typed: true for rows whose key is made from their number. Both sides of a union have _typed as a literal, so a bound on the key is one
    on the number, which reaches the scan, for the rows of the table, and one on the text for rows put later.
    """

    df: DataFrame
    text_key: TextKey | None = None

    @classmethod
    def over(cls, table: DataFrame, spec: StoreSpec) -> "KVStore":
        return cls(spec.columns(table), spec.key if isinstance(spec.key, TextKey) else None)

    def _kind(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def pairs(self) -> DataFrame:
        return self.df.select("key", "value")

    def numbers(self) -> Numbered | None:
        return Numbered(self.text_key.number, F.col("_number"), F.col("_typed")) if self.text_key else None

    def _side(self, compare: Callable, value: object) -> Column:
        """compare(column, literal) on the key: on its number where it has one and the value is of its form."""
        text = compare(F.col("key"), F.lit(value))
        of = self.numbers()
        n = of.parse(value) if of and isinstance(value, str) else None
        return text if n is None else of.choose(compare(of.column, F.lit(n)), text)

    def _at(self, key: object) -> Column:
        return self._side(lambda a, b: a == b, key)

    def _range(self, low: Bound, high: Bound) -> Column:
        """On a TextKey, ends of its own form become ends of the number and reach the scan."""
        out = F.lit(True)
        if low.value is not None:
            out = out & self._side((lambda a, b: a >= b) if low.included else (lambda a, b: a > b), low.value)
        if high.value is not None:
            out = out & self._side((lambda a, b: a <= b) if high.included else (lambda a, b: a < b), high.value)
        return out

    def where(self, column: Column) -> "KVStore":
        return replace(self, df=self.df.where(column))

    # lookups
    def get(self, key: object) -> DataFrame:
        return self.where(self._at(key)).pairs().limit(1)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(pos, key, value) for keys (pos, key) in their order; null where there is no such key; a key asked twice is given twice."""
        return keys.select("pos", "key").join(self._hits(keys), "key", "left").select("pos", "key", "value").orderBy("pos")

    def _hits(self, keys: DataFrame) -> DataFrame:
        """The asked entries; few keys do not make the store move."""
        return self.pairs().join(few(keys), "key", "left_semi")

    def exists_count(self, keys: DataFrame) -> DataFrame:
        """(found): a key asked twice counts twice."""
        return keys.select("key").join(self._hits(keys).select("key"), "key").agg(F.count("*").alias("found"))

    # scans
    def range(self, low: Bound = Bound(), high: Bound = Bound()) -> DataFrame:
        """Ordered by key. A reversed range is empty."""
        return self.range_unordered(low, high).pairs().orderBy("key")

    def range_unordered(self, low: Bound = Bound(), high: Bound = Bound()) -> "KVStore":
        return self.where(self._range(low, high))

    def stream_range(self, low: Bound = Bound(), high: Bound = Bound()) -> Iterator:
        """The ordered rows one partition at a time."""
        return self.range(low, high).toLocalIterator(prefetchPartitions=True)

    def scan(self) -> DataFrame:
        return self.pairs().orderBy("key")

    def value_text(self) -> Column:
        return X.index_text(F.col("value"), self._kind("value"))

    def find_by_value(self, text: str) -> DataFrame:
        return self.where(self.value_text() == text).pairs()

    def find_by_value_like(self, pattern: str) -> DataFrame:
        return self.where(X.like(self.value_text(), pattern)).pairs()

    def keys(self, pattern: str, cap: int = KEYS_CAP) -> DataFrame:
        """Keys that match, in order. An error if there are more than ``cap``: it is raised when the result is computed, from at most cap + 1 rows."""
        top = self.where(X.glob(F.col("key").cast("string"), pattern)).df.select("key").orderBy("key").limit(cap + 1)
        top = top.withColumn("n", F.count("*").over(Window.partitionBy()))  # over at most cap + 1 rows
        guard = F.when(F.col("n") > cap, F.raise_error(F.lit(f"more than {cap} keys match")).cast("boolean")).otherwise(F.lit(True))
        return top.where(guard).select("key").orderBy("key")

    def tagged(self, tags: DataFrame, tag: int) -> DataFrame:
        """Values of the keys with a tag, without the keys."""
        return self.pairs().join(tags.where(F.col("tag") == tag).select("key").distinct(), "key", "left_semi").select("value")

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    # conditions
    def condition_columns(self) -> Columns:
        """Matching is on shown text (N2); literals that are no text compare with the typed column."""
        shown = {}
        for name in ("key", "value"):
            kind = self._kind(name)
            text = X.index_text(F.col(name), kind)
            shown[name] = X.display_text(text) if name == "value" and isinstance(kind, T.StringType) else text
        native = {n: F.col(n) for n in ("key", "value") if isinstance(self._kind(n), (T.NumericType, T.BooleanType))}
        return Columns(shown, native, {"key": self.numbers()} if self.text_key else {})

    def filter(self, condition: Condition | Column | Callable) -> "KVStore":
        """By a condition, a Column, or a Python function (key, value) -> bool, which runs on Arrow batches."""
        if isinstance(condition, Condition):
            condition = to_column(condition, self.condition_columns())
        if not isinstance(condition, Column):
            fn = condition

            @F.pandas_udf("boolean")
            def keep(k, v):
                import pandas as pd

                return pd.Series([bool(fn(a, b)) for a, b in zip(k, v)], dtype=bool)

            keep.__annotations__.clear()
            condition = keep(F.col("key"), F.col("value"))
        return self.where(condition)

    def limit(self, n: int, offset: int = 0) -> DataFrame:
        """The first n by key; none for n = 0."""
        return self.pairs().orderBy("key").offset(offset).limit(n)

    def aggregate_count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def aggregate_sum(self, of: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.sum(of), F.lit(0)).alias("total"))

    def page(self, start: object = None, end: object = None, limit: int = 100, contains: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(results, total): the first ``limit`` of an inclusive range by key, and the number of all that match."""
        hit = self.range_unordered(Bound(start), Bound(end))
        if contains is not None:
            hit = hit.where(X.json_field_contains(hit.value_text(), contains))
        return hit.limit(limit), hit.df.agg(F.count("*").alias("total"))

    # mutations give the new store, and a frame with the number of rows that changed
    def update(self, condition: Column, value: Column) -> tuple["KVStore", DataFrame]:
        hit = F.coalesce(condition, F.lit(False))
        new = self.df.withColumn("value", F.when(hit, value.cast(self._kind("value"))).otherwise(F.col("value")))
        return replace(self, df=new), self.df.agg(F.count_if(hit).alias("affected"))

    def delete(self, condition: Column) -> tuple["KVStore", DataFrame]:
        hit = F.coalesce(condition, F.lit(False))
        return self.where(~hit), self.df.agg(F.count_if(hit).alias("affected"))

    def update_by_value(self, text: str, value: object) -> tuple["KVStore", DataFrame]:
        return self.update(self.value_text() == text, F.lit(value))

    def delete_by_value(self, text: str) -> tuple["KVStore", DataFrame]:
        return self.delete(self.value_text() == text)

    def upsert(self, batch: DataFrame) -> "KVStore":
        """Puts (key, value), or (seq, key, value) of which a key's last counts."""
        if "seq" in batch.columns:
            batch = batch.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
        kept = self.df.join(batch.select("key"), "key", "left_anti")
        new = batch.select("key", "value")
        if self.text_key:
            kept = kept.select("key", "value", "_number", "_typed")
            new = new.select("key", "value", F.lit(None).cast(self._kind("_number")).alias("_number"), F.lit(False).alias("_typed"))
        else:
            kept = kept.select("key", "value")
        return replace(self, df=kept.unionByName(new))
