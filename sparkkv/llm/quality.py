"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words (lower-case, by a hash), its trigrams of character classes and a few word statistics. Word counts are damped and weighted by
the inverse of their share of the labelled texts, as in latent semantic analysis; the shapes are damped alone. Both blocks have unit
length, the words times WORD_SHARE, and are projected by a singular value decomposition fitted to the labelled rows. The labelled
vectors are broadcast: at most LABELLED rows of LATENT numbers. Every document's cosine with every one of them is computed in blocks, and the
labels of its NEIGHBOURS nearest vote, weighted by a power of the similarity.

Labels, lang, source and ids are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import DOCUMENT_COLUMNS, table

#: Most labelled rows that the classifier is fitted on: those with the smallest hashes of their ids.
LABELLED = 4_000
LATENT = 64
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.3
HOLD_OUT = 5
#: Dimensions of the shapes and of the hashed words, and the length of the word block beside that of the shapes.
_SHAPES, _WORDS, WORD_SHARE = 2048, 4096, 1.0
_FEATURES = _SHAPES + _WORDS
_CHUNK = 1 << 18

#: Classes of bytes: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 beyond ASCII; punctuation has its own classes.
_CLASS = np.full(256, 5, np.uint32)
_CLASS[33:127] = np.arange(6, 100)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 3, 4


def shapes(raw: bytes | None, words: list[bytes]) -> np.ndarray:
    """Unit vector of a whole text's damped counts of shapes; zero for an empty text."""
    out = np.zeros(_SHAPES, np.float32)
    if not raw:
        return out
    counts = np.zeros(_SHAPES - 32, np.int64)
    data = np.frombuffer(raw, np.uint8)
    for lo in range(0, max(1, len(data) - 2), _CHUNK):
        c = _CLASS[data[lo : lo + _CHUNK + 2]]
        if len(c) > 2:
            h = (c[:-2] * np.uint32(10007) + c[1:-1] * np.uint32(101) + c[2:]) * np.uint32(2654435761)
            counts += np.bincount((h >> np.uint32(8)) % np.uint32(len(counts)), minlength=len(counts))
    out[32:] = np.log1p(1000.0 * counts / max(1, len(data)))
    n = len(words)
    if n:
        twins = sum(map(bytes.__eq__, words[1:], words[:-1])) / n
        upper = sum(map(bytes.isupper, words)) / n
        marks = np.count_nonzero(_CLASS[data] > 5) / len(data)
        out[:5] = 6 * np.array([twins, upper, marks * 4, min(1.0, 8 / n), 1 - len(set(words)) / n])
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


def terms(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place, damped count) of the hashed lower-case words of a whole text; words of one hash add up."""
    seen = Counter(words)
    at = np.fromiter((crc32(w.lower()) for w in seen), np.int64, len(seen)) % _WORDS
    counts = np.bincount(at, np.fromiter(seen.values(), float, len(seen)), _WORDS)
    at = np.flatnonzero(counts)
    return at, np.log1p(counts[at]).astype(np.float32)


def features(raw: bytes | None, weights: np.ndarray) -> np.ndarray:
    """Shapes, then words by ``weights``; zero for an empty text."""
    words = raw.split() if raw else []
    out = np.zeros(_FEATURES, np.float32)
    out[:_SHAPES] = shapes(raw, words)
    if words:
        at, n = terms(words)
        n = n * weights[at]
        norm = float(np.sqrt((n * n).sum()))
        out[_SHAPES + at] = n * (WORD_SHARE / norm) if norm else 0
    return out


def _right_axes(x: np.ndarray, latent: int, rounds: int = 6, more: int = 16) -> np.ndarray:
    """The first right singular vectors, by powers of a random start (a few more than asked, so that the last ones settle too)."""
    q = np.random.default_rng(1).standard_normal((x.shape[1], min(latent + more, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turn.T)[:, :latent].astype(np.float32))


class Voter:
    """Labelled texts in latent space; rows: their shapes and terms."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, latent: int = LATENT, neighbours: int = NEIGHBOURS):
        self.rate = float(labels.mean()) if len(labels) else 0.5
        self.labels, self.neighbours = labels.astype(np.float32), min(neighbours, len(labels))
        seen = np.bincount(np.concatenate([at for _, at, _ in rows]), minlength=_WORDS) if rows else np.zeros(_WORDS)
        self.weights = np.log((len(rows) + 1) / (seen + 1)).astype(np.float32) + 1  # a word of no labelled text weighs most
        if not len(labels):
            return
        vectors = np.zeros((len(rows), _FEATURES), np.float32)
        for v, (form, at, n) in zip(vectors, rows):
            v[:_SHAPES] = form
            n = n * self.weights[at]
            norm = float(np.sqrt((n * n).sum()))
            v[_SHAPES + at] = n * (WORD_SHARE / norm) if norm else 0
        self.mean = vectors.mean(axis=0)
        vectors -= self.mean
        self.axes = _right_axes(vectors, latent)
        z = vectors @ self.axes
        self.known = (z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.axes
        norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return (z / np.maximum(norm, 1e-9)).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the neighbours, with one vote of the overall rate."""
        if not len(self.labels):
            return np.full(len(x), self.rate)
        out = np.empty(len(x))
        for lo in range(0, len(x), 256):
            cosine = self.latent(x[lo : lo + 256]) @ self.known.T
            if self.neighbours < len(self.labels):
                near = np.argpartition(cosine, -self.neighbours, axis=1)[:, -self.neighbours :]
                cosine, votes = np.take_along_axis(cosine, near, 1), self.labels[near]
            else:
                votes = np.broadcast_to(self.labels, cosine.shape)
            weight = np.maximum(cosine, 0).astype(np.float64) ** POWER
            out[lo : lo + 256] = ((weight * votes).sum(axis=1) + 0.05 * self.rate) / (weight.sum(axis=1) + 0.05)
        return np.clip(out, 0.0, 1.0)


def _vectors(batches):
    """(known_id, label, vector): a text's shapes, number of terms, their places and counts, in few bytes."""
    for b in batches:
        got = []
        for t in b.column(1):
            raw = t.as_py()
            words = raw.split() if raw else []
            at, n = terms(words)
            got.append(shapes(raw, words).astype("<f2").tobytes() + at.astype("<u2").tobytes() + n.astype("<f2").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.binary())], ["known_id", "label", "vector"])


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest = raw[2 * _SHAPES :]
    return np.frombuffer(raw[: 2 * _SHAPES], "<f2").astype(np.float32), np.frombuffer(rest[: len(rest) // 2], "<u2").astype(np.int64), np.frombuffer(rest[len(rest) // 2 :], "<f2").astype(np.float32)


def _score(voter):
    def run(batches):
        of = voter.value
        for b in batches:
            texts, out = b.column("text"), np.empty(b.num_rows)
            for lo in range(0, b.num_rows, 256):
                out[lo : lo + 256] = of.score(np.stack([features(t.as_py(), of.weights) for t in texts[lo : lo + 256]]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "score"])

    return run


def remainder(id_col: str, mod: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Voter:
    """Learns from at most ``most`` labelled rows outside the held-out fifth; labels with a null are left out, and differing ones averaged.

    Of several texts under one id the one whose bytes of terms come first is taken.
    """
    known = labels.where("doc_id is not null and quality is not null").where(remainder("doc_id", HOLD_OUT) != 0)
    known = known.groupBy(F.col("doc_id").alias("known_id")).agg(F.avg("quality").alias("label"))
    known = known.orderBy(F.xxhash64("known_id"), "known_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))
    rows = rows.select(F.col("known_id").cast("long").alias("known_id"), F.col("text").cast("binary").alias("text"), F.col("label").cast("double").alias("label"))
    got = rows.mapInArrow(_vectors, "known_id long, label double, vector binary")
    got = got.groupBy("known_id").agg(F.min("label").alias("label"), F.min("vector").alias("vector")).collect()  # at most ``most`` rows
    got.sort(key=lambda r: (r.label, bytes(r.vector)))
    return Voter([_unpacked(bytes(r.vector)) for r in got], np.array([r.label for r in got]))


def score(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), most: int = LABELLED) -> DataFrame:
    """A row for every row of ``docs``: doc_id, the columns of ``carry``, text (as bytes), score (0 to 1, higher: label 1 likelier).

    An empty or null text is scored like any other, by the neighbours of the zero vector. Very long texts are read whole. Without any label every score is
    0.5. Repeated rows get equal scores. Null ids stay null. Columns other than doc_id, text and ``carry`` are not read, whatever their names. An
    empty table gives an empty result.
    """
    voter = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("binary").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_score(voter), f"{kinds}, score double")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score below THRESHOLD go.

    Each row is judged for itself, by its whole text, which goes to Python and back once; null ids and repeated rows too. A null text comes back null. Extra columns are
    left out. An empty table stays empty.
    """
    got = score(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"), carry=("lang", "source", "n_chars"))
    return got.where(F.col("score") >= THRESHOLD).withColumn("text", F.col("text").cast("string")).select(*DOCUMENT_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder("doc_id", HOLD_OUT) == 0, F.lit(False)).alias("held_out")
    return got.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
