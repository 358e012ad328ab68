"""Conditions on a store's key and value, as small trees that become one Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X


class Condition:
    def __and__(self, other):
        return All((self, other))

    def __or__(self, other):
        return Any((self, other))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True)
class Compare(Condition):
    """field op literal; op is one of = != < > <= >=. Text compares by its bytes."""

    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Between(Condition):
    """Both ends included; a reversed range holds nothing."""

    field: str
    low: object
    high: object


@dataclass(frozen=True)
class Like(Condition):
    field: str
    pattern: str


@dataclass(frozen=True)
class In(Condition):
    field: str
    values: tuple


@dataclass(frozen=True)
class IsNull(Condition):
    field: str


@dataclass(frozen=True)
class Not(Condition):
    of: Condition


@dataclass(frozen=True)
class All(Condition):
    of: tuple


@dataclass(frozen=True)
class Any(Condition):
    of: tuple


@dataclass(frozen=True)
class Always(Condition):
    pass


@dataclass(frozen=True)
class Numbered:
    """A text column made from a number: parse gives a literal's number or None; typed is false for rows whose text is not made so."""

    parse: Callable
    column: Column
    typed: Column

    def choose(self, on_number: Column, on_text: Column) -> Column:
        return F.when(self.typed, on_number).otherwise(on_text)


@dataclass(frozen=True)
class Columns:
    """What the fields of a condition stand for: text columns to match, native columns to compare with literals of their own kind, and texts that are made from numbers."""

    text: dict = field(default_factory=dict)
    native: dict = field(default_factory=dict)
    numbered: dict = field(default_factory=dict)

    def side(self, name: str, literal: object) -> Column:
        if name not in self.text:
            raise ValueError(f"unknown column: {name}")
        if not isinstance(literal, str) and name in self.native:
            return self.native[name]
        return self.text[name]


def _literal(value: object, column_is_text: bool) -> Column:
    return F.lit(str(value) if column_is_text and not isinstance(value, str) else value)


def to_column(c: Condition, columns: Columns) -> Column:
    """One boolean Column, which the optimizer can push to the scan."""
    if isinstance(c, Always):
        return F.lit(True)
    if isinstance(c, Not):
        return ~to_column(c.of, columns)
    if isinstance(c, All):
        return reduce(lambda a, b: a & b, (to_column(x, columns) for x in c.of))
    if isinstance(c, Any):
        return reduce(lambda a, b: a | b, (to_column(x, columns) for x in c.of))
    if isinstance(c, IsNull):
        return columns.side(c.field, "").isNull()
    if isinstance(c, Like):
        return X.like(columns.side(c.field, ""), c.pattern)
    literals = (c.value,) if isinstance(c, Compare) else (c.low, c.high) if isinstance(c, Between) else c.values
    side = columns.side(c.field, "" if any(isinstance(x, str) for x in literals) else literals[0] if literals else "")
    text = c.field not in columns.native or any(isinstance(x, str) for x in literals)
    lits = [_literal(x, text) for x in literals]
    on_text = _compared(c, side, lits, [str(x) if text else x for x in literals])
    of = columns.numbered.get(c.field) if literals and all(isinstance(x, str) for x in literals) else None
    numbers = [of.parse(x) for x in literals] if of else [None]
    if None in numbers:
        return on_text
    return of.choose(_compared(c, of.column, [F.lit(n) for n in numbers], numbers), on_text)


def _compared(c: Condition, side: Column, lits: list[Column], plain: list) -> Column:
    if isinstance(c, In):
        return reduce(lambda a, b: a | b, (side == x for x in lits), F.lit(False)) if len(lits) < 8 else side.isin(plain)
    if isinstance(c, Between):
        return side.between(*lits)
    return {"=": side.__eq__, "!=": side.__ne__, "<": side.__lt__, ">": side.__gt__, "<=": side.__le__, ">=": side.__ge__}[c.op](lits[0])
