"""The SQL dialect over stores: SELECT with joins, WHERE, TOP, DISTINCT, ORDER BY, LIMIT and OFFSET; INSERT, UPDATE and DELETE.

A statement is parsed to a tree and then becomes one DataFrame plan. Every table has the columns key and value. Text compares by
its shown form (functions.text.display_text), and aggregates read numbers from text, where what is no number counts as 0. Grouping, having, outer joins
and scalar functions go beyond that dialect; they come from Spark.

``strict`` reproduces, on one bound store, observable oddities that programs may lean on; see SqlSession.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.store import KVStore
from .predicates import Numbered

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
FUNCTIONS = ("UPPER", "LOWER", "LENGTH", "TRIM", "LTRIM", "RTRIM", "SUBSTRING", "CONCAT", "REPLACE", "ABS", "ROUND", "FLOOR", "CEIL", "COALESCE")
_TOKEN = re.compile(r"\s+|--[^\n]*|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|'(?P<text>(?:[^']|'')*)'|\"(?P<quoted>[^\"]+)\"|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op><>|!=|<=|>=|\|\||[=<>(),.*;+-])", re.S)
_RESERVED = set("SELECT DISTINCT TOP FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET JOIN INNER LEFT RIGHT FULL OUTER CROSS SEMI ANTI ON AS AND OR NOT IN LIKE BETWEEN IS NULL ASC DESC INSERT INTO VALUES UPDATE SET DELETE UNION INTERSECT EXCEPT".split())


class SqlError(ValueError):
    pass


@dataclass(frozen=True)
class Ref:
    table: str | None
    name: str


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Op:
    """Comparisons and logic; op is = != < > <= >= like in between isnull not and or."""

    op: str
    args: tuple


@dataclass
class Select:
    items: list = field(default_factory=list)  # (expression or None for *, alias, header)
    distinct: bool = False
    top: int | None = None
    tables: list = field(default_factory=list)  # (how, name, alias, on)
    where: object = None
    group: list = field(default_factory=list)
    having: object = None
    order: list = field(default_factory=list)  # (expression or position, descending, nulls first or None)
    limit: int | None = None
    offset: int = 0


@dataclass
class Insert:
    table: str
    rows: list


@dataclass
class Update:
    table: str
    value: object
    where: object


@dataclass
class Delete:
    table: str
    where: object


def tokenize(sql: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"cannot read {sql[at : at + 20]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind == "number":
            out.append(("lit", float(m["number"]) if re.search(r"[.eE]", m["number"]) else int(m["number"])))
        elif kind == "text":
            out.append(("lit", m["text"].replace("''", "'")))
        elif kind == "quoted":
            out.append(("name", m["quoted"]))
        elif kind == "name":
            word = m["name"]
            reserved = word.upper() in _RESERVED and (word.upper() != "TOP" or out[-1:] in ([("word", "SELECT")], [("word", "DISTINCT")]))
            out.append(("word", word.upper()) if reserved else ("name", word))
        elif kind == "op":
            out.append(("op", "!=" if m["op"] == "<>" else m["op"]))
    return out


class Parser:
    def __init__(self, sql: str):
        self.tokens, self.at = tokenize(sql), 0
        while self.tokens and self.tokens[-1] == ("op", ";"):
            self.tokens.pop()
        if ("op", ";") in self.tokens:
            raise SqlError("one statement at a time")

    def peek(self, n: int = 0):
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ("end", None)

    def take(self, *values: str) -> bool:
        """Consumes these words or signs if they come next."""
        if all(self.peek(i) in (("word", v), ("op", v)) for i, v in enumerate(values)):
            self.at += len(values)
            return True
        return False

    def need(self, *values: str) -> None:
        if not self.take(*values):
            raise SqlError(f"expected {' '.join(values)}, got {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise SqlError(f"expected a name, got {value!r}")
        self.at += 1
        return value

    def whole(self, what: str) -> int:
        kind, value = self.peek()
        if kind != "lit" or not isinstance(value, int):
            raise SqlError(f"{what} takes a whole number")
        self.at += 1
        return value

    def statement(self):
        if self.take("SELECT"):
            out = self.select()
        elif self.take("INSERT"):
            out = self.insert()
        elif self.take("UPDATE"):
            out = self.update()
        elif self.take("DELETE"):
            self.need("FROM")
            table = self.name()
            self.need("WHERE")
            out = Delete(table, self.expression())
        else:
            raise SqlError(f"unsupported statement: {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise SqlError(f"unexpected {self.peek()[1]!r}")
        return out

    def select(self) -> Select:
        s = Select()
        s.distinct = self.take("DISTINCT")
        if self.take("ON"):
            raise SqlError("DISTINCT ON is not supported")
        if self.take("TOP"):
            bracket = self.take("(")
            s.top = self.whole("TOP")
            if bracket:
                self.need(")")
        while True:
            start = self.at
            if self.take("*"):
                s.items.append((None, None, "*"))
            else:
                e = self.expression()
                alias = self.name() if self.take("AS") or self.peek()[0] == "name" else None
                s.items.append((e, alias, "".join(str(v) for _, v in self.tokens[start : self.at]) if alias is None else alias))
            if not self.take(","):
                break
        self.need("FROM")
        s.tables.append(("from", *self.source(), None))
        while True:
            how = next((h for words, h in ((("JOIN",), "inner"), (("INNER", "JOIN"), "inner"), (("LEFT", "JOIN"), "left"), (("LEFT", "OUTER", "JOIN"), "left"), (("RIGHT", "JOIN"), "right"), (("RIGHT", "OUTER", "JOIN"), "right"), (("FULL", "JOIN"), "full"), (("FULL", "OUTER", "JOIN"), "full"), (("LEFT", "SEMI", "JOIN"), "left_semi"), (("LEFT", "ANTI", "JOIN"), "left_anti")) if self.take(*words)), None)
            if how is None:
                break
            source = self.source()
            self.need("ON")
            s.tables.append((how, *source, self.expression()))
        if self.take(","):
            raise SqlError("name tables with JOIN and ON")
        if self.take("WHERE"):
            s.where = self.expression()
        if self.take("GROUP", "BY"):
            s.group.append(self.expression())
            while self.take(","):
                s.group.append(self.expression())
        if self.take("HAVING"):
            s.having = self.expression()
        if self.take("ORDER", "BY"):
            while True:
                e = self.expression()
                down = self.take("DESC") or (self.take("ASC") and False)
                nulls = None
                if self.peek() == ("name", "NULLS") or str(self.peek()[1]).upper() == "NULLS":
                    self.at += 1
                    nulls = self.name().upper() == "FIRST"
                s.order.append((e, down, nulls))
                if not self.take(","):
                    break
        for _ in range(2):
            if self.take("LIMIT"):
                s.limit = self.whole("LIMIT")
            elif self.take("OFFSET"):
                s.offset = self.whole("OFFSET")
        return s

    def source(self) -> tuple[str, str]:
        table = self.name()
        return table, self.name() if self.take("AS") or self.peek()[0] == "name" else table

    def insert(self) -> Insert:
        self.need("INTO")
        table = self.name()
        self.need("(")
        names = [self.name()]
        while self.take(","):
            names.append(self.name())
        self.need(")")
        if [n.lower() for n in names] != ["key", "value"]:
            raise SqlError("INSERT names the columns key and value")
        self.need("VALUES")
        rows = []
        while True:
            self.need("(")
            row = [self.literal()]
            while self.take(","):
                row.append(self.literal())
            self.need(")")
            if len(row) != 2:
                raise SqlError("a row has a key and a value")
            rows.append(tuple(row))
            if not self.take(","):
                return Insert(table, rows)

    def update(self) -> Update:
        table = self.name()
        self.need("SET")
        if self.name().lower() != "value":
            raise SqlError("UPDATE sets value")
        self.need("=")
        value = self.literal()
        if self.take(","):
            raise SqlError("UPDATE sets one column")
        self.need("WHERE")
        return Update(table, value, self.expression())

    def literal(self):
        sign = -1 if self.take("-") else 1
        kind, value = self.peek()
        if kind != "lit" or sign < 0 and isinstance(value, str):
            if sign > 0 and self.take("NULL"):
                return None
            raise SqlError(f"expected a literal, got {value!r}")
        self.at += 1
        return value if isinstance(value, str) else sign * value

    def expression(self):
        out = self.conjunction()
        while self.take("OR"):
            out = Op("or", (out, self.conjunction()))
        return out

    def conjunction(self):
        out = self.negation()
        while self.take("AND"):
            out = Op("and", (out, self.negation()))
        return out

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("NOT") else self.comparison()

    def comparison(self):
        left = self.operand()
        kind, value = self.peek()
        if kind == "op" and value in ("=", "!=", "<", ">", "<=", ">="):
            self.at += 1
            return Op(value, (left, self.operand()))
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return Op("not", (Op("isnull", (left,)),)) if no else Op("isnull", (left,))
        no = self.take("NOT")
        if self.take("LIKE"):
            out = Op("like", (left, Lit(self.literal())))
        elif self.take("BETWEEN"):
            low = self.operand()
            self.need("AND")
            out = Op("between", (left, low, self.operand()))
        elif self.take("IN"):
            self.need("(")
            values = [Lit(self.literal())]
            while self.take(","):
                values.append(Lit(self.literal()))
            self.need(")")
            out = Op("in", (left, *values))
        elif no:
            raise SqlError("NOT is followed by LIKE, IN or BETWEEN here")
        else:
            return left
        return Op("not", (out,)) if no else out

    def operand(self):
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        kind, value = self.peek()
        if kind == "lit" or (kind, value) in (("op", "-"), ("word", "NULL")):
            return Lit(self.literal())
        name = self.name()
        if self.take("."):
            return Ref(name, self.name())
        if not self.take("("):
            return Ref(None, name)
        if self.take("*"):
            self.need(")")
            return Call(name.upper(), (), star=True)
        distinct, args = self.take("DISTINCT"), []
        if not self.take(")"):
            args.append(self.expression())
            while self.take(","):
                args.append(self.expression())
            self.need(")")
        return Call(name.upper(), tuple(args), distinct)


def parse(sql: str):
    return Parser(sql).statement()


@dataclass
class SqlResult:
    """Rows of a query, or the number of rows that a statement changed, as a frame (affected)."""

    df: DataFrame | None = None
    affected: DataFrame | None = None


class Scope:
    """Names to columns of a frame in which table i has the columns _i_key and _i_value."""

    def __init__(self):
        self.tables: dict[str, int] = {}
        self.kinds: dict[tuple[int, str], T.DataType] = {}
        self.numbered: dict[int, Numbered] = {}

    def add(self, alias: str, store: KVStore) -> int:
        if alias.lower() in self.tables:
            raise SqlError(f"the name {alias} is used twice")
        i = self.tables[alias.lower()] = len(self.tables)
        for n in ("key", "value"):
            self.kinds[i, n] = store.df.schema[n].dataType
        if store.text_key:
            self.numbered[i] = Numbered(store.text_key.number, F.col(f"_{i}_number"), F.col(f"_{i}_typed"))
        return i

    @staticmethod
    def columns(i: int, store: KVStore) -> list[Column]:
        """What a frame must hold of the store for its conditions."""
        return [F.col(c).alias(f"_{i}_{n}") for c, n in (("key", "key"), ("value", "value"), ("_number", "number"), ("_typed", "typed")) if c in store.df.columns]

    def _by_number(self, e: Op) -> tuple[Numbered, list] | None:
        """For a key that is made from a number, compared with literals of its form: it, and their numbers."""
        refs, lits = [a for a in e.args if isinstance(a, Ref)], [a for a in e.args if isinstance(a, Lit)]
        if e.op == "like" or len(refs) != 1 or refs[0].name.lower() != "key" or len(lits) + 1 != len(e.args) or not all(isinstance(a.value, str) for a in lits):
            return None
        self.find(refs[0])  # an unknown or ambiguous name is an error
        of = self.numbered.get(self.tables[refs[0].table.lower()] if refs[0].table else 0)
        numbers = [of.parse(a.value) for a in lits] if of else [None]
        return None if None in numbers else (of, [of.column if a is refs[0] else F.lit(of.parse(a.value)) for a in e.args])

    def find(self, ref: Ref) -> tuple[Column, T.DataType, str]:
        name = ref.name.lower()
        if name not in ("key", "value"):
            raise SqlError(f"unknown column: {ref.name}")
        if ref.table is None:
            if len(self.tables) > 1:
                raise SqlError(f"which {ref.name}? name its table")
            i = 0
        elif ref.table.lower() in self.tables:
            i = self.tables[ref.table.lower()]
        else:
            raise SqlError(f"unknown table: {ref.table}")
        return F.col(f"_{i}_{name}"), self.kinds[i, name], name

    def shown(self, e, top: bool = False) -> Column:
        """An operand as text."""
        if isinstance(e, Lit):
            return F.lit(None if e.value is None else e.value if isinstance(e.value, str) else str(e.value))
        if isinstance(e, Ref):
            column, kind, name = self.find(e)
            text = column if isinstance(kind, T.StringType) else X.index_text(column, kind)
            return X.display_text(text) if name == "value" and isinstance(kind, T.StringType) and not top else text
        return self.scalar(e).cast("string")

    def scalar(self, e) -> Column:
        if isinstance(e, Lit):
            return F.lit(e.value)
        if isinstance(e, Ref):
            column, kind, name = self.find(e)
            return X.display_text(column) if name == "value" and isinstance(kind, T.StringType) else column
        if isinstance(e, Call):
            if e.name not in FUNCTIONS:
                raise SqlError(f"unknown function: {e.name}")
            return F.call_function(e.name.lower(), *[self.scalar(a) for a in e.args])
        return self.condition(e)

    def _numeric(self, e) -> bool:
        if isinstance(e, Ref):
            return isinstance(self.find(e)[1], T.NumericType)
        return isinstance(e, Lit) and isinstance(e.value, (int, float))

    def condition(self, e, top: bool = False) -> Column:
        """top: an unnested condition of a strict statement, which sees values as they are stored."""
        if not isinstance(e, Op):
            raise SqlError("a condition compares something")
        if e.op == "and":
            return self.condition(e.args[0]) & self.condition(e.args[1])
        if e.op == "or":
            return self.condition(e.args[0]) | self.condition(e.args[1])
        if e.op == "not":
            return ~self.condition(e.args[0])
        if e.op == "isnull":
            return self.scalar(e.args[0]).isNull()
        if all(self._numeric(a) for a in e.args) and any(isinstance(a, Ref) for a in e.args):
            sides = [self.scalar(a) for a in e.args]
        elif e.op in ("=", "!=") and all(isinstance(a, Lit) for a in e.args):
            sides = [F.lit(a.value) for a in e.args] if len({type(a.value) for a in e.args}) == 1 else [self.shown(a) for a in e.args]
        else:
            sides = [self.shown(a, top and e.op in ("=", "like", "in")) for a in e.args]
        if e.op == "like":
            return X.like(sides[0], str(e.args[1].value))
        on_text, found = self._compared(e.op, sides), self._by_number(e)
        return found[0].choose(self._compared(e.op, found[1]), on_text) if found else on_text

    @staticmethod
    def _compared(op: str, sides: list[Column]) -> Column:
        if op == "between":
            return sides[0].between(*sides[1:])
        if op == "in":
            return sides[0].isin(*sides[1:])
        a, b = sides
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def aggregate(self, e: Call) -> Column:
        if e.name == "COUNT":
            if e.star or not e.args:
                return F.count("*")
            return F.countDistinct(self.scalar(e.args[0])) if e.distinct else F.count(self.scalar(e.args[0]))
        if len(e.args) != 1 or not isinstance(e.args[0], Ref):
            raise SqlError(f"{e.name} takes one column")
        column, kind, _ = self.find(e.args[0])
        n = X.number(column, kind)
        if e.distinct:
            return {"SUM": F.coalesce(F.sum_distinct(n), F.lit(0.0)), "AVG": F.try_divide(F.sum_distinct(n), F.count_distinct(n)), "MIN": F.min(n), "MAX": F.max(n)}[e.name]
        return {"SUM": F.coalesce(F.sum(n), F.lit(0.0)), "AVG": F.avg(n), "MIN": F.min(n), "MAX": F.max(n)}[e.name]


def _aggregates(e) -> bool:
    if isinstance(e, Call):
        return e.name in AGGREGATES or any(map(_aggregates, e.args))
    return isinstance(e, Op) and any(map(_aggregates, e.args))


class SqlSession:
    """Named stores and statements on them. Statements that change a store give it a new plan; nothing runs until a result is read.

    With ``strict``: any table name means the bound store ``bound``; an unnested = LIKE IN sees stored text; a header of COUNT(*) is
    COUNT(value), and SUM, MIN and MAX are text, whole numbers without a fraction; columns beside aggregates are N/A; ORDER BY sorts by the first column shown,
    in the first item's direction; a join of any kind pairs the store with itself on the key; and UPDATE of one missing key inserts it.
    """

    def __init__(self, spark: SparkSession, stores: dict[str, KVStore], strict: bool = False, bound: str | None = None):
        self.spark, self.stores, self.strict = spark, {k.lower(): v for k, v in stores.items()}, strict
        self.bound = (bound or next(iter(self.stores), "")).lower()

    def _name(self, name: str) -> str:
        if self.strict:
            return self.bound
        if name.lower() not in self.stores:
            raise SqlError(f"unknown table: {name}")
        return name.lower()

    def execute(self, sql: str) -> SqlResult:
        s = parse(sql)
        if isinstance(s, Select):
            return SqlResult(self._select(s))
        name = self._name(s.table)
        store = self.stores[name]
        if isinstance(s, Insert):
            kinds = [store.df.schema[n].dataType for n in ("key", "value")]
            rows = [(i, *[None if v is None else str(v) if not isinstance(v, str) else v for v in r]) for i, r in enumerate(s.rows)]
            batch = self.spark.createDataFrame(rows, "seq int, key string, value string").select("seq", F.col("key").cast(kinds[0]), F.col("value").cast(kinds[1]))
            self.stores[name] = store.upsert(batch)
            return SqlResult(affected=self.spark.createDataFrame([(len(rows),)], "affected bigint"))
        scope = Scope()
        scope.add(name, store)
        seen = scope.columns(0, store)
        frame = store.df.select("*", *seen)
        added = [f"_0_{n}" for n in ("key", "value", "number", "typed")]
        if s.where is None:
            raise SqlError("WHERE is needed")
        hit = F.coalesce(scope.condition(_unaliased(s.where), self.strict), F.lit(False))
        affected = frame.agg(F.count_if(hit).alias("affected"))
        if isinstance(s, Delete):
            self.stores[name] = replace(store, df=frame.where(~hit).drop(*added))
            return SqlResult(affected=affected)
        kind = store.df.schema["value"].dataType
        new = F.lit(s.value).cast(kind)
        changed = replace(store, df=frame.withColumn("value", F.when(hit, new).otherwise(F.col("value"))).drop(*added))
        w = s.where
        if self.strict and isinstance(w, Op) and w.op == "=" and isinstance(w.args[0], Ref) and w.args[0].name.lower() == "key" and isinstance(w.args[1], Lit):
            batch = self.spark.createDataFrame([(str(w.args[1].value),)], "key string").select(F.col("key").cast(store.df.schema["key"].dataType), new.alias("value"))
            self.stores[name] = store.upsert(batch)
            return SqlResult(affected=self.spark.createDataFrame([(1,)], "affected bigint"))
        self.stores[name] = changed
        return SqlResult(affected=affected)

    def _frame(self, s: Select) -> tuple[DataFrame, Scope]:
        scope, df = Scope(), None
        for how, name, alias, on in s.tables:
            store = self.stores[self._name(name)]
            i = scope.add(alias, store)
            part = store.df.select(*scope.columns(i, store))
            if df is None:
                df = part
                continue
            df = df.join(part, self._on(scope, on), how)
            if how in ("left_semi", "left_anti"):
                del scope.tables[alias.lower()]
        return df, scope

    @staticmethod
    def _on(scope: Scope, on) -> Column:
        """Equal keys of one kind compare as they are, so that the join is one on equal columns."""
        if isinstance(on, Op) and on.op == "=" and all(isinstance(a, Ref) for a in on.args):
            (a, ka, _), (b, kb, _) = (scope.find(r) for r in on.args)
            if ka == kb:
                return a == b
        if isinstance(on, Op) and on.op == "and":
            return SqlSession._on(scope, on.args[0]) & SqlSession._on(scope, on.args[1])
        return scope.condition(on)

    def _select(self, s: Select) -> DataFrame:
        if self.strict and len(s.tables) > 1:
            store = self.stores[self.bound].pairs()
            pair = store.select(F.col("key").alias("k"), F.col("value").alias("v"))
            return store.join(pair, F.col("key") == F.col("k")).select(F.col("key").alias("a.key"), F.col("value").alias("a.value"), F.col("k").alias("b.key"), F.col("v").alias("b.value"))
        df, scope = self._frame(s)
        if s.where is not None:
            df = df.where(scope.condition(s.where, self.strict))
        if s.group or any(_aggregates(e) for e, _, _ in s.items if e is not None):
            return self._finish(*self._grouped(s, df, scope), s, scope)
        items = []
        for e, alias, header in s.items:
            if e is None:
                for t, i in scope.tables.items():
                    items += [(F.col(f"_{i}_{n}"), n if len(scope.tables) == 1 else f"{t}.{n}") for n in ("key", "value")]
            else:
                items.append((self._item(e, scope), alias or (e.name if isinstance(e, Ref) and e.table is None else header)))
        order = []
        for e, down, nulls in s.order:
            order.append((self._order(e, items, s, scope), down, nulls))
        return self._cut(df, items, order, s)

    @staticmethod
    def _item(e, scope: Scope) -> Column:
        return scope.condition(e) if isinstance(e, Op) else scope.scalar(e)

    def _order(self, e, items, s: Select, scope: Scope) -> Column:
        if isinstance(e, Lit) and isinstance(e.value, int):
            if not 1 <= e.value <= len(items):
                raise SqlError(f"ORDER BY {e.value} is out of range")
            return items[e.value - 1][0]
        if isinstance(e, Ref) and e.table is None:
            for c, n in items:
                if n == e.name:
                    return c
        return self._item(e, scope)

    def _cut(self, df: DataFrame, items, order, s: Select) -> DataFrame:
        names = [f"_out{i}" for i in range(len(items))]
        shown = [c.alias(n) for (c, _), n in zip(items, names)]
        if self.strict and order:
            order = [(F.col(names[0]), order[0][1], None)]
            df = df.select(*shown)
        elif s.distinct:
            keep = [(c.alias(f"_sort{i}"), f"_sort{i}", d, n) for i, (c, d, n) in enumerate(order)]
            df = df.select(*shown, *[k[0] for k in keep])
            order = [(F.col(k[1]), k[2], k[3]) for k in keep]
        else:
            df = df.select(*shown, *[c.alias(f"_sort{i}") for i, (c, _, _) in enumerate(order)])
            order = [(F.col(f"_sort{i}"), d, n) for i, (_, d, n) in enumerate(order)]
        if s.distinct:
            df = df.dropDuplicates(names)
        by = []
        for c, down, nulls in order:
            first = not down if nulls is None else nulls
            by.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        if by:
            df = df.orderBy(*by)
        if s.offset:
            df = df.offset(s.offset)
        most = [n for n in (s.limit, s.top) if n is not None]
        if most:
            df = df.limit(min(most))
        return df.select(*[F.col(n).alias(name) for n, (_, name) in zip(names, items)])

    def _grouped(self, s: Select, df: DataFrame, scope: Scope):
        groups = [(g, self._item(g, scope)) for g in s.group]
        out, known = [], []

        def aggregated(e) -> Column:
            for g, c in groups:
                if e == g:
                    return c
            if isinstance(e, Call) and e.name in AGGREGATES:
                return scope.aggregate(e)
            if isinstance(e, Lit):
                return F.lit(e.value)
            if isinstance(e, Op) and _aggregates(e):
                args = [aggregated(a) for a in e.args]
                if e.op in ("and", "or", "not"):
                    return {"and": lambda: args[0] & args[1], "or": lambda: args[0] | args[1], "not": lambda: ~args[0]}[e.op]()
                return {"=": lambda: args[0] == args[1], "!=": lambda: args[0] != args[1], "<": lambda: args[0] < args[1], ">": lambda: args[0] > args[1], "<=": lambda: args[0] <= args[1], ">=": lambda: args[0] >= args[1], "between": lambda: args[0].between(*args[1:])}[e.op]()
            if self.strict:
                return F.lit("N/A")
            raise SqlError("a column beside aggregates must be in GROUP BY")

        for e, alias, header in s.items:
            if e is None:
                raise SqlError("* cannot stand beside aggregates")
            c, name = aggregated(e), alias or (e.name if isinstance(e, Ref) and e.table is None else header)
            if self.strict and isinstance(e, Call):
                name = alias or ("COUNT(value)" if e.star else header)
                if e.name in ("SUM", "MIN", "MAX"):
                    c = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
            out.append((c, name))
            known.append(e)
        having = None if s.having is None else aggregated(s.having)
        order = []
        for e, down, nulls in s.order:
            if isinstance(e, Lit) and isinstance(e.value, int):
                order.append((e.value - 1, None, down, nulls))
            else:
                at = next((i for i, (_, n) in enumerate(out) if isinstance(e, Ref) and e.table is None and n == e.name), None)
                order.append((at, None if at is not None else aggregated(e), down, nulls))
        parts = [c.alias(f"_o{i}") for i, (c, _) in enumerate(out)] + [c.alias(f"_s{i}") for i, (_, c, _, _) in enumerate(order) if c is not None]
        parts += [having.alias("_having")] if having is not None else []
        df = df.groupBy(*[c for _, c in groups]).agg(F.count("*").alias("_n"), *parts)
        if having is not None:
            df = df.where("_having")
        return df, [(F.col(f"_o{i}"), n) for i, (_, n) in enumerate(out)], [(F.col(f"_o{at}") if c is None else F.col(f"_s{i}"), d, n) for i, (at, c, d, n) in enumerate(order)]

    def _finish(self, df, items, order, s: Select, scope: Scope) -> DataFrame:
        return self._cut(df, items, [] if self.strict else order, s)


def _unaliased(e):
    """References of UPDATE and DELETE, whose one table may be named."""
    if isinstance(e, Ref):
        return Ref(None, e.name)
    if isinstance(e, Op):
        return Op(e.op, tuple(map(_unaliased, e.args)))
    if isinstance(e, Call):
        return Call(e.name, tuple(map(_unaliased, e.args)), e.distinct, e.star)
    return e
