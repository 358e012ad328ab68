"""Secondary indexes that are derived from a table by an expression, so that they never fall behind it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Index:
    """kind: hash, range or prefix (of ``length`` characters). ``of`` gives the indexed text; ``typed`` compares ranges by its own kind."""

    name: str
    kind: str
    key: Column
    of: Column
    length: int = 0
    typed: bool = False


class Catalog:
    def __init__(self):
        self._indexes: dict[str, tuple[Index, DataFrame]] = {}

    def create(self, index: Index, table: DataFrame) -> bool:
        """False if there is one of this name."""
        if index.name in self._indexes:
            return False
        if index.kind not in ("hash", "range", "prefix"):
            raise ValueError(f"unknown kind of index: {index.kind}")
        self._indexes[index.name] = (index, table)
        return True

    def drop(self, name: str) -> bool:
        return self._indexes.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._indexes)

    def kind(self, name: str) -> str | None:
        return self._indexes[name][0].kind if name in self._indexes else None

    def entries(self, name: str) -> DataFrame:
        """(indexed_value, key); all rows, repeats included."""
        index, table = self._indexes[name]
        of = index.of if index.typed else index.of.cast("string")
        return table.select(of.alias("indexed_value"), index.key.alias("key"))

    def exact(self, name: str, value: object) -> DataFrame:
        return self.entries(name).where(F.col("indexed_value") == F.lit(value)).select("key")

    def range(self, name: str, low: object, high: object) -> DataFrame:
        """Ends included; text order unless the index is typed. Ordered by value, then key."""
        return self.entries(name).where(F.col("indexed_value").between(F.lit(low), F.lit(high))).orderBy("indexed_value", "key")

    def prefix(self, name: str, prefix: str) -> DataFrame:
        """Keys whose text starts with the prefix, cut to the index's length."""
        index = self._indexes[name][0]
        cut = prefix[: index.length] if index.length else prefix
        return self.entries(name).where(F.startswith(F.col("indexed_value"), F.lit(cut))).select("key")

    def stats(self, name: str) -> DataFrame:
        """(distinct_values, total_keys)."""
        return self.entries(name).agg(F.countDistinct("indexed_value").alias("distinct_values"), F.count("*").alias("total_keys"))


def add_entries(index: DataFrame, rows: DataFrame) -> DataFrame:
    """An index kept by hand, (index_name, indexed_value, key), with more rows; repeats stay."""
    return index.unionByName(rows)


def remove_entries(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Without all rows that agree; rows of unknown indexes do nothing."""
    return index.join(rows, ["index_name", "indexed_value", "key"], "left_anti")
