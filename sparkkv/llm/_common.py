"""Shared pieces of the corpus operators: words, scratch tables, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: maximal runs of other bytes than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def words(raw: bytes | None) -> list[bytes]:
    """``bytes.split`` without argument splits on exactly the bytes that WORD leaves out."""
    return raw.split() if raw else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Python workers are told where this package lies, should nothing else have told them."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of this process only where none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "root" not in _own:
            _own["root"] = tempfile.mkdtemp(prefix="llm-")
            atexit.register(shutil.rmtree, _own["root"], True)
        root = f"file://{_own['root']}"
    return root.rstrip("/")


_made: ContextVar[list | None] = ContextVar("scratch_tables", default=None)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of the lineage before them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.live = spark, f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}", 0, set()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)  # what results still read goes with the process
        if _made.get() is not None:
            _made.get().append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.live.add(path)
        return out

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.live.discard(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        for df in frames:
            self._delete(df.scratch_path)

    def drop_all_but(self, *frames: DataFrame) -> None:
        for path in self.live - {df.scratch_path for df in frames}:
            self._delete(path)

    def close(self) -> None:
        self._delete(self.root)


@contextmanager
def released():
    """Deletes, at its end, the tables of all operators called inside: for results that are written there."""
    mark = _made.set([])
    try:
        yield
        for scratch in _made.get():
            scratch.close()
    finally:
        _made.reset(mark)


def most_frequent(counts: DataFrame, most: int, key: str = "token") -> list:
    """The ``most`` rows of (key, n) with the largest n, all if there are fewer; equal counts go by a hash of the key, then by the key. ``counts`` is a saved table.

    Found by narrowing: the groups of a level are counted, whole groups are taken while they fit, and the next one is cut at the next level: an eighth of
    a doubling of n, n itself, then ten bits of the hash at a time. The driver sees at most 512 groups, the counts within one eighth of a
    doubling, and 1,024 groups of hashes at a time.
    """
    n, h = F.col("n"), F.xxhash64(key)
    levels = [F.floor(F.log2(n.cast("double")) * 8), n, *[F.shiftright(h, 54 - 10 * i).bitwiseAND(F.lit(1023)) for i in range(6)]]
    out, rest = [], counts.where("n > 0")
    for level in levels:
        groups = sorted(((r.at, r["count"]) for r in rest.groupBy(level.alias("at")).count().collect()), reverse=True)
        left, least, cut = most - len(out), None, None
        for at, rows in groups:
            if rows > left:
                cut = at
                break
            left, least = left - rows, at
        if least is not None:
            out += rest.where(level >= F.lit(least)).collect()
        if cut is None or len(out) == most:
            return out
        rest = rest.where(level == F.lit(cut))
    return out + rest.orderBy(key).limit(most - len(out)).collect()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges stop changing: every step is a minimum per node, combined before the
    shuffle, and a join back. The minima are saved first: both sides of the join are then plain tables, and adaptive execution can split the
    edges of a node that has very many. The number of rounds grows with the logarithm of a component's size.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = scratch.save(star.where("u <> v").distinct())
        scratch.drop(low)
        low = scratch.save(star.groupBy("u").agg(F.min("v").alias("m")))
        near = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = scratch.save(near.union(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(e, star, low)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
