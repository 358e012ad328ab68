"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Each source's documents stand in shuffled order, up to CAP passes one after the other. A place in the queue has
a virtual finish time: the source's words up to its end, divided by the source's target. All places
are range-sorted by that time; the mix takes them, from the first, while their words stay within the budget.

No window spans a source or the whole table: documents are dealt to slices of their shuffled order, and places to
ranges of the virtual time. Only sums of slices and ranges are put in order in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import DOCUMENT_COLUMNS, WORD, Scratch, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SEED = 20240611
ROWS_PER_SLICE = 4_096
LEAST_SLICES = 512
#: Rows for each range of the sort, fewest and most ranges, and most places of a range that are summed in order in one task; more are sorted again.
ROWS_PER_RANGE, LEAST_RANGES, RANGES, IN_ORDER = 8_192, 64, 2_048, 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _before(by: str, what: str) -> Column:
    """The sum of ``what`` over the rows ahead; for tables of sums only."""
    return F.sum(what).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, cap: int = CAP) -> tuple[DataFrame, int]:
    """(source, place, source_size, target) from (source, size), and the budget: the sum of all sizes.

    Sources by code point, null last, weigh ``weights`` in turn; places come from a range-sorted table. A target stops at
    cap times its source's size, and the excess goes by weight to the others until none is above: the level,
    target by weight, rises until the sources that it fills stay the same.
    """
    order = F.col("source").asc_nulls_last()
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(order).sortWithinPartitions(order)
    by = scratch.save(by.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")))
    parts = by.groupBy("part").agg(F.count("*").alias("rows"))
    parts = parts.select("part", F.coalesce(_before("part", "rows"), F.lit(0)).alias("before"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    by = by.join(parts, "part").select("source", "source_size", (F.col("before") + F.col("nth")).alias("place"))
    by = scratch.save(by.withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int"))))
    most, level = (F.col("source_size") * cap).cast("double"), 0.0
    budget = by.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = most <= F.col("weight") * level
        kept, open_weight = by.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (budget - (kept or 0)) / open_weight if open_weight else level
        if new == level:
            break
        level = new
    return scratch.save(by.select("source", "place", "source_size", F.least(most, F.col("weight") * level).alias("target"))), int(budget)


def _end(queue: DataFrame, budget: int, cap: int, ranges: int, scratch: Scratch, in_order: int = IN_ORDER) -> float:
    """The virtual time at which the budget is spent: the last whose places, with all before it, are within the budget.

    The places are range-sorted by virtual time, and the sums of the ranges tell in which of them the budget ends. While that one has more than
    ``in_order`` places it is sorted again, in ranges of its own.
    """
    finish = F.try_divide(F.col("upto") + F.col("pass") * F.col("source_size"), F.col("target"))
    spots = queue.where("size > 0").withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(cap)])))
    spots = scratch.save(spots.groupBy(finish.alias("v")).agg(F.sum("size").alias("size")))
    before, end = 0, None
    while True:
        sort = scratch.save(spots.repartitionByRange(ranges, "v").sortWithinPartitions("v").select("*", F.spark_partition_id().alias("part")))
        sums = sort.groupBy("part").agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.max("v").alias("v"))
        sums = scratch.save(sums.select("part", "rows", "v", "words", F.coalesce(_before("part", "words"), F.lit(0)).alias("before")))
        whole = sums.where(F.col("before") + F.col("words") <= budget - before).agg(F.max("v")).first()[0]
        end = end if whole is None else whole
        cut = sums.where((F.col("before") <= budget - before) & (F.col("before") + F.col("words") > budget - before)).orderBy("part").first()
        if cut is None:
            return end or 0.0
        spots, before = sort.where(F.col("part") == cut["part"]).select("v", "size"), before + cut["before"]
        if cut["rows"] <= in_order:
            break
    run = F.sum("size").over(Window.orderBy("v")) + before
    last = spots.select("v", run.alias("run")).where(F.col("run") <= budget).agg(F.max("v")).first()[0]
    return (end if last is None else last) or 0.0


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP, seed: int = SEED, carry: tuple[str, ...] = (), in_order: int = IN_ORDER) -> DataFrame:
    """A row for every row of ``docs``: doc_id, source, size, source_size, target, taken, and the columns of ``carry``.

    A null text has size 0; rows of size 0 have taken 0. A null source is a source. Rows with null or repeated ids stand in the
    order of their texts' hashes; only rows that agree in id and text stand together. A document is taken whole, 0 to ``cap`` times, however long.
    Columns that are not named are not read, whatever their names. An empty table gives an empty result. Reruns agree: the order is a hash of id, size and text.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col)
    extra = [F.col(c).alias(f"c_{c}") for c in carry]
    sizes = scratch.save(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"), *extra))
    by, budget = targets(sizes, scratch, weights, cap)
    n = sizes.count()
    slices, ranges = max(LEAST_SLICES, -(-n // ROWS_PER_SLICE)), min(max(LEAST_RANGES, -(-n // ROWS_PER_RANGE)), RANGES)
    keyed = sizes.withColumn("h", F.xxhash64("doc_id", "size", "text_hash", F.lit(seed)))
    keyed = keyed.withColumn("slice", F.pmod(F.shiftright("h", 20), F.lit(slices)).cast("long"))
    sums = keyed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "slice", F.coalesce(ahead, F.lit(0)).alias("ahead")).alias("s")
    sums = sums.join(by.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")))
    sums = scratch.save(sums.select(F.col("s.source").alias("at"), F.col("slice").alias("at_slice"), "ahead", "place", "source_size", "target"))
    queue = keyed.join(sums, keyed["source"].eqNullSafe(sums["at"]) & (keyed["slice"] == sums["at_slice"]))
    order = Window.partitionBy("place", "slice").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"c_{c}" for c in carry]
    queue = scratch.save(queue.select("doc_id", "source", "size", "source_size", "target", (F.col("ahead") + F.sum("size").over(order)).alias("upto"), *names))
    end = _end(queue, budget, cap, ranges, scratch, in_order)
    scratch.drop_all_but(queue)
    passes = F.lit(0)
    for i in range(cap):
        v = F.try_divide(F.col("upto") + F.lit(i) * F.col("source_size"), F.col("target"))
        passes = passes + F.when((F.col("size") > 0) & (v <= end), 1).otherwise(0)
    return queue.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * passes).alias("taken"), *[F.col(n).alias(c) for n, c in zip(names, carry)])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, whatever its id: rows go through the mix with their texts.

    Rows without words go. Null ids and sources are like others, repeated rows are taken each for itself, extra columns are left out, and an empty table stays empty.
    """
    got = mix(docs, carry=("text", "lang", "n_chars")).where("taken > 0")
    return got.withColumn("m_pass", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(*DOCUMENT_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
