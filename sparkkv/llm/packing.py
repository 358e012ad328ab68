"""Best-fit packing of token sequences with large-item matching.

Pieces above a third of the capacity pair at most twice in a bin: the largest unmatched is matched with the
largest other one that fits beside it. Smaller pieces then go, from the longest, to the bin with the smallest gap
that holds them, or to a new bin. Only the number of pieces of each length matters for this, so the plan is made on
the driver from a histogram of at most ``capacity`` counts. Bins are kept as runs of equal content, and
the plan is a table of such runs. Pieces find their place in it by their number among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, table

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END = 1
ROWS_PER_SLICE = 8_192
LEAST_SLICES = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Signs that are cut from a letter or digit before them; an apostrophe is none, as it can begin a token with letters.
_SIGN, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b".,!?%&*$#;:)]|-")] = True
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _cut(raw: bytes) -> list[bytes]:
    low = raw.lower()
    data = np.frombuffer(low, np.uint8)
    at = np.flatnonzero(_ALNUM[data[:-1]] & _SIGN[data[1:]])
    return (np.insert(data, at + 1, 32).tobytes() if len(at) else low).split()


class WordTokens:
    """Ids of whole texts, put together from the ids of their parts.

    The tokenizer drops white space, lower-cases, and splits letters, digits and other signs from each other; no token spans such a split. So a text's ids
    are those of its parts between ASCII white space in turn, which can also be cut where a sign follows a letter or digit. Parts
    seen before are looked up in two tables, of which the older is dropped when the newer holds ``most`` bytes; one call's parts may go beyond that. New
    parts are encoded as one text, with a sign between them whose id no other part has. Texts that hold this sign or may hold special tokens are
    encoded as they are.
    """

    MARK = b"\x01"
    #: Bytes of an entry besides its part and ids: two objects and a place in the table.
    ENTRY = 170

    def __init__(self, path: str, most: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.new, self.old, self.held, self.most = Tokenizer.from_file(path), {}, {}, 0, most
        self.mark = self._ids(self.MARK)

    def _ids(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([raw.decode(errors="replace")], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, fresh: set[bytes]) -> dict[bytes, bytes]:
        """Adds parts to the newer table, but for very long ones, which it gives."""
        new, old = self.new, self.old
        long = {p: self._ids(p).tobytes() for p in fresh if len(p) > 4096}
        again = {p: old[p] for p in fresh if p in old}
        new.update(again)
        self.held += sum(map(len, again)) + sum(map(len, again.values())) + self.ENTRY * len(again)
        want = [p for p in fresh if p not in new and p not in long]
        if want:
            ids = self._ids((b"\n" + self.MARK + b"\n").join(want))
            ends = np.flatnonzero(ids == self.mark[0])
            assert len(self.mark) == 1 and len(ends) == len(want) - 1
            whole = ids.tobytes()
            lows, highs = [0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(whole)]
            new.update(zip(want, [whole[a:b] for a, b in zip(lows, highs)]))
            self.held += sum(map(len, want)) + len(whole) - 4 * len(ends) + self.ENTRY * len(want)
        return long

    def __call__(self, raws: list[bytes]) -> list[np.ndarray]:
        plain = [b"<|" not in raw and self.MARK not in raw for raw in raws]
        texts = [_cut(raw) if ok else [] for raw, ok in zip(raws, plain)]
        if self.held > self.most:
            self.old, self.new, self.held = self.new, {}, 0
        seen = self.new
        fresh = set().union(*texts).difference(seen)
        if fresh:
            long = self._learn(fresh)
            if long:
                seen = seen | long
        return [np.frombuffer(b"".join(map(seen.__getitem__, parts)), "<u4") if ok else self._ids(raw) for raw, parts, ok in zip(raws, texts, plain)]


@lru_cache(1)
def _tokens(path: str) -> WordTokens:
    """One for all tasks of a worker."""
    return WordTokens(path)


def _pieces(path, capacity):
    def run(batches):
        tokens = _tokens(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            rows, ids, texts = [], b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ids), 32):
                for i, got in zip(ids[lo : lo + 32], tokens([t.as_py() or b"" for t in texts[lo : lo + 32]])):
                    got = np.append(got, np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(got), capacity)):
                        part = got[at : at + capacity]
                        rows.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        tokens.old = {}  # between tasks only the newer table stays

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, pieces, first bin, pieces a bin, offset) in the order of their numbers.

    Piece number first + i of a length goes to bin first bin + i // pieces a bin, at offset + (i % pieces a bin) * length.
    """
    left = {n: c for n, c in counts.items() if c}
    number = dict.fromkeys(left, 0)
    runs, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room -> runs (first bin, bins)
    order: list[int] = []

    def room(gap, first, n):
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def put(length, first_bin, n, each, offset):
        runs.append((length, number[length], n * each, first_bin, each, offset))
        number[length] += n * each
        left[length] -= n * each

    third = capacity // 3
    large = sorted(n for n in left if n > third)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and (not left[large[k]] or large[k] == a and left[a] < 2):
            if not left[large[k]]:
                del large[k]
            k -= 1
        if k < 0:
            n = left[a]
            put(a, bins, n, 1, 0)
            room(capacity - a, bins, n)
        elif large[k] == a:
            n = left[a] // 2
            put(a, bins, n, 2, 0)
            room(capacity - 2 * a, bins, n)
        else:
            b = large[k]
            n = min(left[a], left[b])
            put(a, bins, n, 1, 0)
            put(b, bins, n, 1, a)
            room(capacity - a - b, bins, n)
        bins += n
    for length in sorted((n for n in left if n <= third), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                n = left[length] // each
                if n:
                    put(length, bins, n, each, 0)
                    room(capacity - each * length, bins, n)
                    bins += n
                if rest := left[length]:
                    put(length, bins, 1, rest, 0)
                    room(capacity - rest * length, bins, 1)
                    bins += 1
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            each = gap // length
            use = min(n, left[length] // each)
            if not use:  # fewer pieces than one bin of this run takes
                use, each = 1, left[length]
            if use < n:
                gaps[gap].append((first + use, n - use))
            if not gaps[gap]:
                del gaps[gap], order[at]
            put(length, first, use, each, capacity - gap)
            room(gap - each * length, first, use)
    return sorted(runs)


def _place(runs):
    def run(batches):
        table_ = np.array(runs.value, np.int64).reshape(-1, 6)
        at = {int(n): (lo, hi) for n, lo, hi in zip(*(lambda u, i: (u, i, np.append(i[1:], len(table_))))(*np.unique(table_[:, 0], return_index=True)))}
        for b in batches:
            length, number = (b.column(i).to_numpy() for i in (b.num_columns - 2, b.num_columns - 1))
            row = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                lo, hi = at[n]
                own = length == n
                row[own] = lo + np.searchsorted(table_[lo:hi, 1], number[own], side="right") - 1
            r = table_[row]
            i = number - r[:, 1]
            out = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(r[:, 3] + i // r[:, 4]), pa.array(r[:, 5] + i % r[:, 4] * length)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for every piece: doc_id, piece, start, ids_crc32, length, sequence_id, offset.

    A null or empty text is the end id alone. A longer document, however long, is cut into pieces of ``capacity`` ids. Rows repeat as often as they come
    in; a null id stays null. Pieces that tie in length take places by a hash, then by id. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pieces = scratch.save(rows.mapInArrow(_pieces(tokenizer or tokenizer_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    slices = max(LEAST_SLICES, -(-sum(counts.values()) // ROWS_PER_SLICE))
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    sums = pieces.groupBy("length", "slice").agg(F.count("*").alias("rows"))
    ahead = F.sum("rows").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = scratch.save(sums.select("length", "slice", F.coalesce(ahead, F.lit(0)).alias("ahead")))
    near = pieces.join(sums, ["length", "slice"])
    number = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1 + F.col("ahead")
    numbered = near.select("doc_id", "piece", "start", "ids_crc32", "length", number.cast("long").alias("number"))
    return numbered.mapInArrow(_place(runs), "doc_id long, piece int, start long, ids_crc32 long, length long, sequence_id long, offset long")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces and their sequences, of each row for itself; odd rows as in ``pack``."""
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
