"""Repeated passages: every window of WINDOW consecutive words whose sequence starts anywhere else is removed.

The windows of a text are dealt to anchors: a window's anchor is the place in it whose run of GRAM words has
the smallest hash (the leftmost of equals), so equal windows have equal anchors at equal offsets. The
windows of one anchor are consecutive and make a segment, which covers about twelve of them.

1. Count-min prefilter. Each partition counts the anchors of its segments in a sketch of DEPTH rows; the
   partitions' sketches are merged cell by cell. A cell counts no less than any window of its
   anchors does. Counters stop at two, so a merged row is a bitmap of fixed size; this bitmap is broadcast.
   More segments than the width fits only let more of them through to the exact pass.
2. Segments estimated repeated are grouped exactly, by anchor and content. A segment that occurs twice has
   all its windows repeated.
3. Where an anchor has different segments, as at the edges of a passage, their windows are grouped exactly. A
   map task first settles the windows that it sees in two segments and passes one row for all of them.

Equality is that of 64-bit hashes of window (or segment) together with the 64-bit hash of the anchor.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import DOCUMENT_COLUMNS, Scratch, table

WINDOW = 35
GRAM = 8
DEPTH = 2
#: Counters of a row of the sketch, as a power of two: two bitmaps of 2**26 bits are 16 MB.
WIDTH_BITS = 26
_CHUNK_BITS = 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Windows that a task settles at a time before it passes them on.
_BUFFER = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of the base and of its inverse, as many as the longest text asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            ones = np.ones(1, np.uint64)
            self.up = np.concatenate([ones, np.cumprod(np.full(n - 1, _BASE, np.uint64))])
            self.down = np.concatenate([ones, np.cumprod(np.full(n - 1, _INVERSE, np.uint64))])
        return self.up, self.down


def _sliding_argmin(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value of each run of ``width``, by its upper 48 bits, the leftmost of equals.

    The lower 16 bits hold the place in a block, and minima over runs of 1, 2, 4, ... values make those over ``width``.
    """
    n, out, step = len(g) - width + 1, [], (1 << 16) - width
    places = np.arange(min(len(g), 1 << 16), dtype=np.uint64)
    for lo in range(0, n, step):
        low = g[lo : min(n, lo + step) + width - 1] & np.uint64(0xFFFFFFFFFFFF0000)
        low |= places[: len(low)]
        have = 1
        while have < width:
            more = min(have, width - have)
            low = np.minimum(low[: len(low) - more], low[more:])
            have += more
        out.append((low & np.uint64(0xFFFF)).astype(np.int64) + lo)
    return np.concatenate(out)


class Segments:
    """Segments of texts: cell (hash of the anchor's words), content (hash of all words), first window, windows."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.powers = window, min(gram, window), Powers()

    def __call__(self, raw: bytes | None):
        words = raw.split() if raw else []
        n, w, k = len(words), self.window, self.gram
        if n < w:
            return None
        up, down = self.powers.get(n + 1)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
        grams = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
        anchor = _sliding_argmin(grams, w - k + 1)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first, end = np.append(0, cut), np.append(cut, len(anchor))
        size = end - first
        content = _mix(_mix((sums[end + w - 1] - sums[first]) * down[first]) + size.astype(np.uint64))
        return grams[anchor[first]], content, first, size, (sums, down)

    def windows(self, got) -> np.ndarray:
        sums, down = got[4]
        w = self.window
        return _mix((sums[w:] - sums[:-w]) * down[: len(sums) - w] + np.uint64(0xD1B54A32D192ED03))


def _buckets(cell: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mix(cell + np.uint64((0xA0761D6478BD642F * (row + 1)) & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _partial_sketches(window, gram, bits, depth):
    """A partition's sketch as rows (row, chunk, counts): deflated pairs of offsets, those counted once, then those counted more."""

    def rows(cells):
        for j in range(depth):
            b, n = np.unique(_buckets(np.concatenate(cells), j, bits), return_counts=True)
            chunk = b >> _CHUNK_BITS
            at = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(b))
            low = (b & (1 << _CHUNK_BITS) - 1).astype("<u2")
            out = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                once, more = low[lo:hi][n[lo:hi] == 1], low[lo:hi][n[lo:hi] > 1]
                out.append(len(once).to_bytes(4, "little") + once.tobytes() + more.tobytes())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), j, np.int32)), pa.array(chunk[at[:-1]].astype(np.int32)), pa.array(out, pa.binary())], ["j", "chunk", "counts"])

    def run(batches):
        segments, cells, held = Segments(window, gram), [], 0
        for b in batches:
            for t in b.column(0):
                got = segments(t.as_py())
                if got is not None:
                    cells.append(got[0])
                    held += len(got[0])
            if held > 1_000_000:
                yield from rows(cells)
                cells, held = [], 0
        if cells:
            yield from rows(cells)

    return run


def _merged_chunks(batches):
    """Sorted partial chunks, folded one at a time; gives the bitmap of counters that reached two."""
    at, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], ["j", "chunk", "twice"])

    for b in batches:
        for j, c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (j, c) != at:
                if at is not None and twice.any():
                    yield out()
                at, once, twice = (j, c), np.zeros(1 << _CHUNK_BITS, bool), np.zeros(1 << _CHUNK_BITS, bool)
            n = int.from_bytes(x[:4], "little")
            offsets = np.frombuffer(x, "<u2", offset=4)
            twice[offsets[n:]] = True
            twice[offsets[:n][once[offsets[:n]]]] = True
            once[offsets] = True
    if at is not None and twice.any():
        yield out()


def sketch(texts: DataFrame, window: int, gram: int, bits: int, depth: int) -> np.ndarray:
    """The merged sketch: for each row a bitmap of the counters that reached two; depth * 2**bits / 8 bytes."""
    parts = texts.mapInArrow(_partial_sketches(window, gram, bits, depth), "j int, chunk int, counts binary")
    parts = parts.repartition("j", "chunk").sortWithinPartitions("j", "chunk")
    maps = np.zeros((depth, 1 << bits - 3), np.uint8)
    size = 1 << _CHUNK_BITS - 3
    for r in parts.mapInArrow(_merged_chunks, "j int, chunk int, twice binary").collect():  # at most the bitmap's size
        maps[r.j, r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return maps


def _set(maps: np.ndarray, cell: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(cell), bool)
    for j in range(len(maps)):
        b = _buckets(cell, j, bits)
        hit &= (maps[j][b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def _repeated_segments(window, gram, bits, maps):
    def run(batches):
        segments, bitmap = Segments(window, gram), maps.value
        for b in batches:
            rows, parts = [], []
            for i, t in enumerate(b.column(2)):
                got = segments(t.as_py())
                if got is not None:
                    hit = _set(bitmap, got[0], bits)
                    if hit.any():
                        parts.append([x[hit] for x in got[:4]])
                        rows.append(np.full(len(parts[-1][0]), i))
            if parts:
                rows = pa.array(np.concatenate(rows))
                cell, content, first, size = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(cell.view(np.int64)), pa.array(content.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["doc_id", "text_hash", "cell", "content", "first", "size"],
                )

    return run


def _settled(cell, win, content, k):
    """Rows of a buffer: kind 1, settled here (repeated), and kind 0, to be held against other tasks' rows; many marks a window seen in two segments."""
    order = np.lexsort((content, win, cell))
    cell, win, content, k = cell[order], win[order], content[order], k[order]
    keep = np.concatenate([[True], (cell[1:] != cell[:-1]) | (win[1:] != win[:-1]) | (content[1:] != content[:-1])])
    cell, win, content, k = cell[keep], win[keep], content[keep], k[keep]
    new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (win[1:] != win[:-1])])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(cell)))
    many = np.repeat(size > 1, size)
    pass_on = new  # one row of each window
    kind = np.concatenate([np.ones(int(many.sum()), np.int32), np.zeros(int(pass_on.sum()), np.int32)])
    pick = np.concatenate([np.flatnonzero(many), np.flatnonzero(pass_on)])
    key = np.where(kind == 1, content[pick], win[pick])  # settled rows need no meeting and spread evenly
    return pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(cell[pick].view(np.int64)), pa.array(key.view(np.int64)), pa.array(content[pick].view(np.int64)), pa.array(k[pick].astype(np.int32)), pa.array(many[pick])],
        ["kind", "cell", "win", "content", "k", "many"],
    )


def _edge_windows(window, gram, maps):
    """The windows of the segments whose anchor has different segments."""

    def run(batches):
        segments, bitmap = Segments(window, gram), maps.value
        bits = int(bitmap.shape[1] * 8).bit_length() - 1
        held, n, seen = [], 0, set()
        for b in batches:
            for t in b.column(0):
                got = segments(t.as_py())
                if got is None:
                    continue
                hit = np.flatnonzero(_set(bitmap, got[0], bits))
                if not len(hit):
                    continue
                fresh = []
                for i, key in zip(hit.tolist(), zip(got[0][hit].tolist(), got[1][hit].tolist())):
                    if key not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(key)
                        fresh.append(i)
                if not fresh:
                    continue
                fresh = np.array(fresh)
                size = got[3][fresh]
                k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                win = segments.windows(got)[np.repeat(got[2][fresh], size) + k]
                held.append((np.repeat(got[0][fresh], size), win, np.repeat(got[1][fresh], size), k))
                n += len(k)
                if n >= _BUFFER:
                    yield _settled(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if held:
            yield _settled(*(np.concatenate(x) for x in zip(*held)))

    return run


def _repeated_windows(batches):
    """Rows sorted by (cell, win, content): those of a window that occurs in two segments. One row is held back until the next shows what it is."""
    last = None  # the window's first row, not yet given

    def out(cell, content, k):
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(content, pa.int64()), pa.array(k, pa.int32())], ["cell", "content", "k"])

    run_key, run_on = None, False  # the window of the last row, and whether it is known to be repeated
    for b in batches:
        kind, cell, win, content, k = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        many = b.column(5).to_numpy(zero_copy_only=False).astype(bool)
        one = kind == 1
        if one.any():
            yield out(cell[one], content[one], k[one])
        cell, win, content, k, many = (x[~one] for x in (cell, win, content, k, many))
        if not len(cell):
            continue
        new = np.concatenate([[(cell[0], win[0]) != run_key], (cell[1:] != cell[:-1]) | (win[1:] != win[:-1])])
        at = np.flatnonzero(new)
        if not new[0]:
            at = np.append(0, at)
        size = np.diff(np.append(at, len(cell)))
        differs = np.concatenate([[False], (content[1:] != content[:-1]) & ~new[1:]])
        on = np.add.reduceat((differs | many).astype(np.int64), at) > 0
        if not new[0]:
            on[0] |= run_on or (last is not None and last[1] != content[0])
            if on[0] and last is not None:
                yield out([last[0]], [last[1]], [last[2]])
                last = None
        else:
            last = None
        rows = np.repeat(on, size)
        if rows.any():
            yield out(cell[rows], content[rows], k[rows])
        run_key, run_on = (cell[-1], win[-1]), bool(on[-1])
        if run_on:
            last = None
        elif last is None or len(at) > 1 or new[0]:
            last = (cell[-1], content[-1], k[-1])

    return


def _bitmap_of(cells: DataFrame, bits: int) -> np.ndarray:
    """Cells as one bitmap of fixed size, made from chunks that the executors merge; hash collisions only add candidates."""

    def partial(batches):
        for b in batches:
            at = np.unique(_buckets(b.column(0).to_numpy().view(np.uint64), 0, bits))
            chunk = at >> _CHUNK_BITS
            cut = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(at))
            low = (at & (1 << _CHUNK_BITS) - 1).astype("<u2")
            got = [low[lo:hi].tobytes() for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[cut[:-1]].astype(np.int32)), pa.array([x for x in got], pa.binary())], ["chunk", "low"])

    def merged(batches):
        at, seen = None, None
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c != at:
                    if at is not None:
                        yield row(at, seen)
                    at, seen = c, np.zeros(1 << _CHUNK_BITS, bool)
                seen[np.frombuffer(x, "<u2")] = True
        if at is not None:
            yield row(at, seen)

    def row(at, seen):
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)], pa.binary())], ["chunk", "map"])

    out, size = np.zeros((1, 1 << bits - 3), np.uint8), 1 << _CHUNK_BITS - 3
    parts = cells.mapInArrow(partial, "chunk int, low binary").repartition("chunk").sortWithinPartitions("chunk")
    for r in parts.mapInArrow(merged, "chunk int, map binary").collect():  # at most the bitmap's size
        out[0, r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(zlib.decompress(r.map), np.uint8)
    return out


def remove(raw: bytes | None, spans: list[tuple[int, int]], window: int = WINDOW) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by a space); spans: first word, bits of the windows repeated from there."""
    words = raw.split() if raw else []
    n = len(words)
    if not spans:
        return n, 0, b" ".join(words)
    gone = np.zeros(n + 1, np.int32)
    for first, mask in spans:
        while mask:
            k = (mask & -mask).bit_length() - 1
            ones = (~(mask >> k) & (mask >> k) + 1).bit_length() - 1  # a run of windows covers one range
            gone[first + k] += 1
            gone[min(n, first + k + ones - 1 + window)] -= 1
            mask &= ~((1 << ones) - 1 << k)
    kept = np.cumsum(gone[:n]) == 0
    return n, int(n - kept.sum()), b" ".join([w for w, x in zip(words, kept.tolist()) if x])


def _cut(window, with_text):
    def run(batches):
        for b in batches:
            n_words, n_removed, sums, texts = [], [], [], []
            for t, s in zip(b.column("text"), b.column("spans")):
                n, gone, kept = remove(t.as_py(), [(x["first"], x["mask"]) for x in s.as_py() or ()], window)
                n_words.append(n)
                n_removed.append(gone)
                if with_text:
                    texts.append(kept if gone else t.as_py())
                else:
                    sums.append(hashlib.sha256(kept).hexdigest())
            out = [b.column(i) for i in range(b.num_columns - 2)]
            out += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            out.append(pa.array(texts, pa.binary()) if with_text else pa.array(sums, pa.string()))
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names[:-2], "n_words", "n_removed", "kept" if with_text else "kept_sha256"])

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, bits: int = WIDTH_BITS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, text_hash, spans) for the texts with repeated windows; docs: doc_id, text (binary), text_hash."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select("text")
    maps = sc.broadcast(sketch(texts, window, gram, bits, depth))
    held = docs.select("doc_id", "text_hash", "text").mapInArrow(_repeated_segments(window, gram, bits, maps), "doc_id long, text_hash long, cell long, content long, first int, size int")
    held = scratch.save(held)
    classes = scratch.save(held.groupBy("cell", "content").agg(F.count("*").alias("n"), F.min("size").alias("size")))
    mixed = classes.groupBy("cell").agg(F.count("*").alias("kinds")).where("kinds > 1").select("cell")
    edge = sc.broadcast(_bitmap_of(mixed, bits))
    rows = texts.mapInArrow(_edge_windows(window, gram, edge), "kind int, cell long, win long, content long, k int, many boolean")
    rows = rows.repartition("cell", "win").sortWithinPartitions("cell", "win", "content")
    seen = rows.mapInArrow(_repeated_windows, "cell long, content long, k int")
    ones = F.lit(1).cast("long")
    whole = classes.where("n > 1").select("cell", "content", (F.call_function("shiftleft", ones, F.col("size")) - 1).alias("mask"))
    found = seen.select("cell", "content", F.call_function("shiftleft", ones, F.col("k")).alias("mask")).union(whole)
    found = scratch.save(found.groupBy("cell", "content").agg(F.bit_or("mask").alias("mask")))
    spans = held.join(found, ["cell", "content"]).select("doc_id", "text_hash", F.struct("first", "mask").alias("span"))
    spans = scratch.save(spans.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans")))
    scratch.drop(held, classes, found)
    return spans


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = False, window: int = WINDOW, gram: int = GRAM, bits: int = WIDTH_BITS) -> DataFrame:
    """A row for every row of ``docs``: doc_id, the columns of ``carry``, n_words, n_removed, and kept_sha256 or, with_text, kept.

    Windows are judged on all rows as they came in; each row counts, so of repeated rows every window is
    repeated. A null or empty text has no words; kept is then the text itself, and so it is where nothing goes. A text
    of fewer than ``window`` words has no window; a very long text is read whole. Null ids stay null. Columns besides those named are not read, and those of
    ``carry`` come back as they are, so they may have no name of a result column. An empty table gives an empty result. Windows of at most 63 + 8 words.
    """
    if not gram <= window <= gram + 55:
        raise ValueError("a segment's windows must fit a mask of 63 bits")
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).cast("binary").alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(base, scratch, window, gram, bits)
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "spans")
    on = base["text_hash"].eqNullSafe(spans["span_hash"]) & base["doc_id"].eqNullSafe(spans["span_id"])
    # the spans grow with the texts: one plan at every size
    both = base.join(spans.hint("merge"), on, "left").select("doc_id", *carry, "text", "spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields[:-2])
    last = "kept binary" if with_text else "kept_sha256 string"
    return both.mapInArrow(_cut(window, with_text), f"{kinds}, n_words long, n_removed long, {last}")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages leave the texts; n_chars follows the text. No row goes.

    Odd rows as in ``cut_repeats``: null and empty texts stay what they are, repeated rows lose all windows of theirs, extra columns are left out.
    """
    got = cut_repeats(docs, carry=("lang", "source", "n_chars"), with_text=True)
    text = F.col("kept").cast("string")
    chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return got.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars")).select(*DOCUMENT_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
