"""SimHash near-duplicates, linked by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of its shingles have it set.
Equal fingerprints are one node. For radius 3, every bit position gets a nonzero vector of four
bits; the mask of a nonzero vector v keeps the positions whose vector has an odd product with v. Three
differing positions span at most three dimensions of four, so some v is orthogonal to all of them: its
mask keeps none of them and the pair has equal masked values. 15 tables thus find every pair within the radius.

With several prints, a text gets that many fingerprints from remixed hashes of the same shingles, and texts link if any of them do: a
radius of 3 alone holds only texts whose shingles agree to a few hundredths, and each further print catches more of the near copies.

A bucket of more than BUCKET nodes goes to the next level, where the bits that its mask left free
are covered in the same way; after three levels at most 8 bits are free, so no bucket can be
larger than 256. Nothing is capped or dropped, and a task holds at most BUCKET nodes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import DOCUMENT_COLUMNS, Scratch, connected_components, table

RADIUS = 3
SHINGLE = 3
BUCKET = 2048
#: Fingerprints of the pipeline stage.
STAGE_PRINTS = 8
#: The pipeline stage confirms what the fingerprints link: words of a shingle, least Jaccard similarity, texts of a block.
CONFIRM_SHINGLE, SIMILARITY, BLOCK = 5, 0.8, 32
_BLOCK = 1 << 16


def _remix(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64 well-spread bits from each hash; the hashes themselves for seed 0."""
    if not seed:
        return h
    x = h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a whole text's shingles, repeats included, a block at a time; nothing without words."""
    words = raw.lower().split() if raw else []
    n = len(words)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, max(1, n - shingle + 1) if n else 0, _BLOCK):
        part = words[lo : lo + _BLOCK + shingle - 1]
        text = b" ".join(part)
        if n <= shingle:
            yield np.array([digest(text, 42)], "<u8")
        else:
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            starts = [0, *(ends[: len(part) - shingle] + 1).tolist()]
            yield np.array([digest(text[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")


def fingerprints(raw: bytes | None, shingle: int = SHINGLE, prints: int = 1) -> np.ndarray:
    """64-bit SimHashes of a whole text; 0 without words."""
    counts, m = np.zeros((prints, 64), np.int64), 0
    for h in _hashes(raw, shingle):
        m += len(h)
        for k in range(prints):
            counts[k] += np.unpackbits(_remix(h, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > m, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    return int(fingerprints(raw, shingle)[0])


def _fingerprints(shingle, prints):
    def run(batches):
        for b in batches:
            got = [fingerprints(t.as_py(), shingle, prints) for t in b.column(2)]
            flat = np.concatenate(got).astype("<u8").view(np.int64) if got else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * prints), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "text_hash", "fps"])

    return run


def _vectors(free: int) -> list[int]:
    """For each vector 1..15, the set of free positions that have it, dealt out in turn."""
    held, k = [0] * 16, 0
    for p in range(64):
        if free >> p & 1:
            held[1 + k % 15] |= 1 << p
            k += 1
    return held


@lru_cache(None)
def masks(free: int) -> tuple[int, ...]:
    """The 15 covering masks over the free positions."""
    held = _vectors(free)
    return tuple(sum(held[u] for u in range(1, 16) if (u & v).bit_count() & 1) for v in range(1, 16))


def level_masks(level: int) -> list[int]:
    """Fixed positions of every table of a level: 15, 225 or 3375 of them, in the order of their numbers."""
    fixed = [0]
    for _ in range(level):
        fixed = [m | x for m in fixed for x in masks((1 << 64) - 1 & ~m)]
    return fixed


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _local_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest (child, parent) of the pairs within RADIUS among at most BUCKET fingerprints."""
    near = np.empty((len(fps), len(fps)), bool)
    for lo in range(0, len(fps), 256):
        near[lo : lo + 256] = np.bitwise_count(fps[lo : lo + 256, None] ^ fps[None, :]) <= RADIUS
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        new = new[new]
        if (new == label).all():
            child = np.flatnonzero(label != np.arange(len(fps)))
            return child, label[child]
        label = new


def _link_buckets(bucket):
    """Rows (t, key, fp) sorted by table and key; gives links (kind 0: a, b) and the rows of too large buckets (kind 1: t, fp)."""

    def run(batches):
        held_t, held_k, held_f = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        over = None

        def out(links, t, f):
            a, b, of = links
            k = np.concatenate([np.zeros(len(a), np.int32), np.ones(len(f), np.int32)])
            cols = [pa.array(k), pa.array(np.concatenate([a, f])), pa.array(np.concatenate([b, f])), pa.array(np.concatenate([of, t]))]
            return pa.RecordBatch.from_arrays(cols, ["kind", "a", "b", "t"])

        def flush(t, k, f):
            """Whole buckets only, each of at most ``bucket`` rows."""
            if not len(f):
                return f, f, t
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
            size = np.diff(np.append(new, len(f)))
            two = new[size == 2]
            two = two[np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= RADIUS]
            a, b, of = [f[two + 1]], [f[two]], [t[two]]
            for s, n in zip(new[size > 2].tolist(), size[size > 2].tolist()):
                g = f[s : s + n]
                child, parent = _local_links(g.view(np.uint64))
                a.append(g[child])
                b.append(g[parent])
                of.append(t[s : s + len(child)])
            return np.concatenate(a), np.concatenate(b), np.concatenate(of)

        nothing = (held_f, held_f, held_t)

        for x in batches:
            t, k, f = (x.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            t, k, f = np.concatenate([held_t, t]), np.concatenate([held_k, k]), np.concatenate([held_f, f])
            if over is not None:
                n = int(((t == over[0]) & (k == over[1])).sum())
                if n:
                    yield out(nothing, t[:n], f[:n])
                    t, k, f = t[n:], k[n:], f[n:]
                if len(f):
                    over = None
            if not len(f):
                held_t, held_k, held_f = t, k, f
                continue
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
            size = np.diff(np.append(new, len(f)))
            big = np.repeat(size > bucket, size)
            last = new[-1]
            whole = ~big
            whole[last:] = False
            yield out(flush(t[whole], k[whole], f[whole]), t[big], f[big])
            if big[-1]:
                over = (t[-1], k[-1])
                last = len(f)
            held_t, held_k, held_f = t[last:], k[last:], f[last:]
        yield out(flush(held_t, held_k, held_f), held_t[:0], held_f[:0])

    return run


def links(nodes: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """A forest (f, a, b) with the connectivity of all pairs of distinct fingerprints (f: its print, fp) within RADIUS."""
    todo, found = nodes.select("fp", F.col("f").alias("t")), None
    for level in (1, 2, 3):
        # table t of a level has the tables 15 t to 15 t + 14 of the next below it; the masks repeat with every print
        small = [(i, _signed(m)) for i, m in enumerate(level_masks(level))]
        if level == 1:
            picks = F.array(*[F.struct((F.col("t") * 15 + i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in small])
            rows = todo.select("fp", F.explode(picks).alias("p")).select("p.t", "p.key", "fp")
        else:
            masks_ = nodes.sparkSession.createDataFrame([(i // 15, i % 15, m) for i, m in small], "place int, i int, mask long")  # 225 or 3375 rows
            at = todo.withColumn("place", F.pmod("t", F.lit(15 ** (level - 1))))
            rows = at.join(F.broadcast(masks_), "place").select((F.col("t") * 15 + F.col("i")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        rows = rows.repartition(F.col("t"), F.col("key")).sortWithinPartitions("t", "key", "fp")
        got = scratch.save(rows.mapInArrow(_link_buckets(bucket if level < 3 else 1 << 9), "kind int, a long, b long, t int"))
        new = got.where("kind = 0").select(F.floor(F.col("t") / 15**level).cast("int").alias("f"), "a", "b")
        found = new if found is None else found.union(new)
        todo = got.where("kind = 1").select(F.col("a").alias("fp"), "t").distinct()
        if level == 3 or todo.isEmpty():
            return found
    raise AssertionError


def _classes(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int, bucket: int, prints: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) for every row, and (fp, first) for every fingerprint: the row (without_id, doc_id, text_hash) that stands for its component."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    rows = scratch.save(texts.mapInArrow(_fingerprints(shingle, prints), "doc_id long, text_hash long, fps array<long>").withColumn("fp", F.col("fps")[0]))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "text_hash"))
    nodes = scratch.save(rows.groupBy("fp").agg(first.alias("first")))
    if prints == 1:
        forest = links(nodes.select("fp", F.lit(0).alias("f")), scratch, bucket)
    else:  # each value of a further print stands for the smallest first print beside it
        beside = rows.select("fp", "fps").distinct().select(F.col("fp").alias("node"), F.posexplode("fps").alias("f", "fp"))
        beside = scratch.save(beside.distinct())
        reps = scratch.save(beside.groupBy("f", "fp").agg(F.min("node").alias("rep")))
        same = beside.join(reps, ["f", "fp"]).select(F.col("node").alias("a"), F.col("rep").alias("b"))
        near = links(reps, scratch, bucket).distinct()
        one, two = (reps.select("f", F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep")) for c in "ab")
        near = near.join(one, ["f", "a"]).join(two, ["f", "b"]).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
        forest = near.union(same)
    labels = scratch.save(connected_components(forest.select("a", "b"), scratch))
    roots = labels.join(nodes, labels["node"] == nodes["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    member = labels.join(roots, "root").select(F.col("node").alias("fp"), "least")
    classes = scratch.save(nodes.join(member, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")))
    scratch.drop_all_but(rows, classes)
    return rows, classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET, prints: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for every row of ``docs``.

    A null or empty text has no words and fingerprint 0, which links like any other. A null id takes no
    part in component_id, which is null only if all ids of a component are. Repeated rows stay. Very long texts are read whole.
    Other columns of ``docs`` are not read, whatever their names. An empty table gives an empty result. With several ``prints`` the first is shown.
    """
    rows, classes = _classes(docs, Scratch(docs.sparkSession), id_col, text_col, shingle, bucket, prints)
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.select("doc_id", "fp").join(classes, "fp").select("doc_id", text, F.col("first.doc_id").alias("component_id"))


def _first_of_linked(sets: list[np.ndarray], similarity: float) -> list[int]:
    """For each set the first that it is linked with, over any number of pairs of at least that Jaccard similarity; two empty sets are alike."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] == label[j] or min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def _confirmed(shingle: int, similarity: float):
    """Rows (class_, block, more, without_id, doc_id, text_hash, text) sorted by all but ``more``; the rows of a block are judged together.

    Gives their keys and whether a row ahead in the block is linked with it (``goes``), and the text again of those of which none is, where ``more`` says
    that its class has other blocks.
    """

    def judged(rows):
        sets = [np.unique(np.concatenate([np.empty(0, "<u8"), *_hashes(r["text"], shingle)])) for r in rows]
        for i, (r, first) in enumerate(zip(rows, _first_of_linked(sets, similarity))):
            yield r | {"goes": first != i, "text": r["text"] if first == i and r["more"] else None}

    def run(batches):
        held, schema = [], None
        for b in batches:
            schema = schema or pa.schema([f for f in b.schema if f.name != "more"] + [pa.field("goes", pa.bool_())])
            for at in range(0, b.num_rows, 256):
                out = []
                for r in b.slice(at, 256).to_pylist():
                    if held and (held[0]["class_"], held[0]["block"]) != (r["class_"], r["block"]):
                        out += judged(held)
                        held = []
                    held.append(r)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(list(judged(held)), schema)

    return run


def confirm(texts: DataFrame, scratch: Scratch, shingle: int = CONFIRM_SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash) of the texts that go, from the different texts (class_, n, without_id, doc_id, text_hash, text) of classes of n > 1.

    A text goes only where pairs of at least ``similarity``, each computed exactly, link it with a text ahead of it, by id, then hash. A class of at most two blocks is
    judged whole. Of a larger one the texts are dealt by hash to blocks of about ``block``, and those that stay are dealt again until a round halves
    their number no more; then every two blocks of them meet. So no two texts that stay in a class are that similar; of a larger class a text may
    stay that only texts which went would link. A group of copies costs about one comparison a text, and only texts that differ from each other, yet share a
    class, are copied: once for every ``block`` of them.
    """
    keys = ["without_id", "doc_id", "text_hash"]
    kinds = "class_ long, block long, without_id boolean, doc_id long, text_hash long, text binary, goes boolean"
    gone, turn, pairs = None, 0, False
    todo = texts.withColumn("was", F.lit(None).cast("long"))
    while True:
        blocks = F.ceil(F.col("n") / block)
        at = F.pmod(F.xxhash64("text_hash", F.lit(turn)), blocks)
        stuck = F.coalesce(F.col("n") * 2 > F.col("was"), F.lit(False))
        each = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda i: F.least(i, at) * blocks + F.greatest(i, at))
        to = F.when(F.col("n") <= 2 * block, F.array(F.lit(0).cast("long"))).when(stuck, each).otherwise(F.array(at))
        more = (F.col("n") > 2 * block) & ~stuck
        rows = todo.select("class_", F.explode(to).alias("block"), more.alias("more"), *keys, "text").repartition("class_", "block").sortWithinPartitions("class_", "block", *keys)
        got = scratch.save(rows.mapInArrow(_confirmed(shingle, similarity), kinds))
        new = got.where("goes").select("doc_id", "text_hash")
        gone = new if gone is None else gone.union(new)
        stay = got.where("text is not null")
        if stay.isEmpty():
            return gone.distinct()
        sizes = scratch.save(stay.groupBy("class_").agg(F.count("*").alias("n")))
        was = todo.select("class_", F.col("n").alias("was")).distinct()
        todo = scratch.save(stay.select("class_", *keys, "text").join(sizes, "class_").join(scratch.save(was), "class_"))
        turn += 1


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group stays, that with the smallest id, then the smallest hash of its text; a row without an id only if none of its group has one.

    The fingerprints only propose: within their components, groups are the texts that ``confirm`` links, by a Jaccard similarity of SIMILARITY or more on shingles of
    CONFIRM_SHINGLE words (of the whole text, if it has fewer). Rows are told apart by id and text, so texts that share an id are judged each for itself; of rows with
    equal texts one stays. All texts without words are one group. Extra columns are left out. An empty table stays empty. Very long texts are
    read whole; a task holds the shingles of one block of texts at a time.

    The join that brings the verdicts back to the texts is pinned to a sort-merge join: its kept side grows with the table, so it could be broadcast only on
    small tables, and one plan at every size is easier to foresee.
    """
    scratch = Scratch(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    rows, classes = _classes(docs, scratch, "doc_id", "text", SHINGLE, BUCKET, STAGE_PRINTS)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id"))
    texts = rows.groupBy("fp", "text_hash").agg(least.alias("least")).join(classes, "fp")
    texts = scratch.save(texts.select(F.xxhash64("first.doc_id", "first.text_hash").alias("class_"), F.col("least.doc_id").alias("keep_id"), "text_hash"))
    sizes = scratch.save(texts.groupBy("class_").agg(F.count("*").alias("n")))
    # repeated rows are combined before they move, and keys without nulls let the join take them from where that left them
    key = ["without_id", "key_id", "text_hash"]
    keyed = docs.select("*", F.col("doc_id").isNull().alias("without_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("key_id"), F.xxhash64("text").alias("text_hash"))
    keep = texts.join(sizes, "class_").select(F.col("keep_id").isNull().alias("without_id"), F.coalesce("keep_id", F.lit(0)).cast("long").alias("key_id"), "text_hash", "class_", "n")
    once = scratch.save(keyed.dropDuplicates(key).join(keep.hint("merge"), key))
    several = once.where("n > 1")
    gone = confirm(several.select("class_", "n", "without_id", F.col("doc_id").cast("long").alias("doc_id"), "text_hash", F.col("text").cast("binary").alias("text")), scratch)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    on = several["doc_id"].eqNullSafe(gone["gone_id"]) & (several["text_hash"] == gone["gone_hash"])
    return once.where("n = 1").select(*DOCUMENT_COLUMNS).union(several.join(gone, on, "left_anti").select(*DOCUMENT_COLUMNS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
