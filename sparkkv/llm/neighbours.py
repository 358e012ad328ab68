"""Approximate nearest neighbours by learned partitions.

1. A bounded sample of the vectors gets an exact neighbour graph.
2. The graph is cut into parts of nearly equal size: balanced label propagation from balanced centres, where a vector moves to the part
   that holds most of its neighbours and has room. There is a part for every PART_ROWS rows of the table, at most PARTS.
3. A small classifier (softmax regression on the vector) learns the part in which a vector's neighbours lie.
4. Sampled vectors that the classifier has not seen are searched for their nearest in the sample: the fewest parts with which the mean recall, less
   twice its standard error, reaches RECALL are the number of parts that a query goes to.
5. Every row of the table is put in its likeliest part, once. A query goes to its likeliest parts, where its scores with all their rows are
   computed exactly, in blocks: a part of more than BLOCK rows is dealt to several tasks, each of which holds its rows and lets
   the part's queries stream past. Their best rows meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, table

SAMPLE = 8_192
#: Most parts, rows for each below that, recall to reach on the sample, and the share of the sample that measures it.
PARTS, PART_ROWS, RECALL, MEASURED = 128, 64, 0.93, 0.125
TOP = 20
EVERY = 20
GRAPH = 12
#: Rows of a part that one task holds, about.
BLOCK = 65_536
SEED = 7


def knn_graph(x: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """Each row's k largest inner products among the others, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 512] = np.argpartition(s, -k, axis=1)[:, -k:]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = SEED) -> np.ndarray:
    """Labels of a balanced cut of the graph: no part holds more than slack times its share."""
    n, rng = len(x), np.random.default_rng(seed)
    room = int(np.ceil(n / parts * slack))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    wish = x @ centres.T
    label, load = np.full(n, -1), np.zeros(parts, np.int64)
    for i in np.argsort(-wish.max(axis=1), kind="stable"):
        for p in np.argsort(-wish[i], kind="stable"):
            if load[p] < room:
                label[i], load[p] = p, load[p] + 1
                break
    back = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    both = [np.array(sorted({*g, *b}), np.int64) for g, b in zip(graph.tolist(), back)]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            if not len(both[i]):
                continue
            votes = np.bincount(label[both[i]], minlength=parts)
            votes[(load >= room) & (np.arange(parts) != label[i])] = -1
            p = int(votes.argmax())
            if votes[p] > votes[label[i]]:
                load[label[i]] -= 1
                load[p] += 1
                label[i] = p
                moved += 1
        if moved < n // 200:
            break
    return label


class Router:
    """Softmax regression from a unit vector to the part of its neighbours."""

    def __init__(self, x: np.ndarray, parts: int = PARTS, seed: int = SEED, epochs: int = 60):
        self.parts = max(1, min(parts, len(x) // 32))
        self.weights = np.zeros((x.shape[1] + 1, self.parts))
        if self.parts == 1:
            return
        graph = knn_graph(x)
        label = balanced_partition(x, graph, self.parts, seed=seed)
        goal = np.zeros((len(x), self.parts))
        np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0 / graph.shape[1])
        goal = 0.5 * goal + 0.5 * np.eye(self.parts)[label]
        z = np.hstack([x, np.ones((len(x), 1))])
        rng, speed = np.random.default_rng(seed), np.zeros_like(self.weights)
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                p = self.chances(z[rows])
                speed = 0.9 * speed + z[rows].T @ (p - goal[rows]) / len(rows)
                self.weights -= 2.0 * (1 - epoch / epochs) * speed

    def chances(self, z: np.ndarray) -> np.ndarray:
        s = z @ self.weights
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def likeliest(self, x: np.ndarray, n: int) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        s = np.hstack([unit, np.ones((len(x), 1))]) @ self.weights
        return np.argsort(-s, axis=1, kind="stable")[:, : min(n, self.parts)].astype(np.int32)


def fewest_probes(x: np.ndarray, parts: int, recall: float = RECALL, top: int = TOP, seed: int = SEED) -> tuple[Router, int]:
    """A router, and the fewest parts with which vectors that it has not seen reach ``recall`` among the rows of x, by the means of the module."""
    length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    asked = np.random.default_rng(seed).permutation(len(x))[: max(1, int(len(x) * MEASURED))] if len(x) else np.empty(0, np.int64)
    rest = np.setdiff1d(np.arange(len(x)), asked)
    router = Router(x[rest] / length[rest], parts)
    if router.parts == 1:
        return router, 1
    home, top = router.likeliest(x, 1)[:, 0], min(top, len(x) - 1)
    hits = np.zeros((len(asked), router.parts))
    for lo in range(0, len(asked), 256):
        q = asked[lo : lo + 256]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        near = np.argpartition(s, -top, axis=1)[:, -top:]
        place = np.argsort(router.likeliest(x[q], router.parts), axis=1)  # of each part in a query's order
        np.add.at(hits, (np.repeat(np.arange(lo, lo + len(q)), top), place[np.arange(len(q))[:, None], home[near]].ravel()), 1.0 / top)
    found = hits.cumsum(axis=1)
    sure = found.mean(axis=0) - 2 * found.std(axis=0) / np.sqrt(len(asked))
    return router, int(np.argmax(sure >= recall)) + 1


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    """(vec_id, vector of the column's own kind): rows with an id and a vector that is finite in every component and not zero."""
    v = F.col(vector_col)
    kind = "array<float>" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "array<double>"
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast(kind).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("vector", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    """Rows of doubles."""
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1).astype(float)


def _home(router):
    """(part, vec_id, vector): a row in its likeliest part."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                part = router.value.likeliest(_matrix(b.column(1)), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), b.column(1)], ["part", "vec_id", "vector"])

    return run


def _ask(router, probes, sizes, least):
    """(part, vec_id, vector): a query in each part that it goes to, the ``probes`` likeliest, and further ones while these hold fewer than ``least`` rows."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            to = router.value.likeliest(_matrix(b.column(2)), len(sizes))
            held = np.asarray(sizes)[to].cumsum(axis=1)
            goes = (np.arange(to.shape[1]) < probes) | (held - np.asarray(sizes)[to] < least)
            take = pa.array(np.repeat(np.arange(len(to)), goes.sum(axis=1)))
            yield pa.RecordBatch.from_arrays([pa.array(to[goes], pa.int32()), b.column(1).take(take), b.column(2).take(take)], ["part", "vec_id", "vector"])

    return run


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors score equally wherever they are computed."""
    out = np.zeros(len(x))
    for k in range(len(q)):
        out += q[k] * x[:, k]
    return out


def _rerank(top):
    """Rows (part, deal, query, vec_id, vector) sorted so that a deal's rows come before its queries; gives each query's best of these rows."""

    def best(q_ids, q, ids, x):
        out = []
        for lo in range(0, len(q_ids), 256):
            near = q[lo : lo + 256] @ x.T
            near[q_ids[lo : lo + 256, None] == ids] = -np.inf
            for n, s in enumerate(near):
                # a margin for rounding: the sums in fixed order decide
                edge = np.partition(s, len(s) - top)[len(s) - top] - 1e-9 * (1 + np.abs(s[s > -np.inf]).max(initial=0)) if len(s) > top else -np.inf
                keep = np.flatnonzero((s >= edge) & (s > -np.inf))
                exact = exact_scores(q[lo + n], x[keep])
                at = np.lexsort((ids[keep], -exact))[:top]
                out.append((np.full(len(at), q_ids[lo + n]), ids[keep][at], exact[at]))
        cols = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    def run(batches):
        here, ids, x, block = None, [], [], None
        for b in batches:
            part, deal, asked, vec = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            asked = asked.astype(bool)
            m = _matrix(b.column(4)) if b.num_rows else None
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (deal[1:] != deal[:-1]) | (asked[1:] != asked[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                if (part[lo], deal[lo]) != here:
                    here, ids, x, block = (part[lo], deal[lo]), [], [], None
                if not asked[lo]:
                    ids.append(vec[lo:hi])
                    x.append(m[lo:hi])
                elif ids:
                    block = block or (np.concatenate(ids), np.concatenate(x))
                    yield best(vec[lo:hi], m[lo:hi], *block)

    return run


def placed(routed: DataFrame, deals: DataFrame) -> DataFrame:
    """(part, deal, query, vec_id, vector): each row once, and a query once in every deal of a part that it goes to."""
    spread = routed.join(F.broadcast(deals), "part")
    deal = F.when(F.col("query"), F.sequence(F.lit(0), F.col("deals") - 1)).otherwise(F.array(F.pmod(F.xxhash64("vec_id"), "deals").cast("int")))
    return spread.withColumn("deal", F.explode(deal)).select("part", "deal", "query", "vec_id", "vector")


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, every: int = EVERY, parts: int = PARTS, probes: int | None = None, sample: int = SAMPLE, block: int = BLOCK, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows with the largest inner products for each query, a row whose id is divisible by ``every``.

    ``probes`` is the number of parts that a query goes to, by default the fewest that reach ``recall`` on the sample. Rows with a null id, a vector that
    is null, zero, of another length than most, or holds a null or non-finite component take no part. An id that repeats counts once, with its
    smallest vector. Ties go to the smaller id. With fewer than ``top`` candidates all are given. A table without queries or candidates gives an
    empty result. Other columns are not read, whatever their names; vectors are of one length, so none is long.

    What moves: each row once, and each query once for each part that it goes to and for each BLOCK rows of that part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = scratch.save(rows.select("*", F.size("vector").alias("dim")))
    lengths = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim, n = (lengths["dim"], lengths["count"]) if lengths else (1, 0)
    rows = rows.where(F.col("dim") == dim).select("vec_id", "vector")
    share = min(1.0, sample / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("vec_id").collect()  # about ``sample`` rows at any n
    x = np.array([r.vector for r in picked], float).reshape(-1, dim)
    router, enough = fewest_probes(x, min(parts, n // PART_ROWS), recall, top)
    state, kinds = spark.sparkContext.broadcast(router), f"part int, vec_id long, vector {rows.schema['vector'].dataType.simpleString()}"
    homes = scratch.save(rows.mapInArrow(_home(state), kinds))
    counts = {r.part: r["count"] for r in homes.groupBy("part").count().collect()}  # at most PARTS
    sizes = [counts.get(p, 0) for p in range(router.parts)]
    asks = homes.where(F.col("vec_id") % every == 0).mapInArrow(_ask(state, probes or enough, sizes, top + 1), kinds)
    routed = homes.withColumn("query", F.lit(False)).unionByName(asks.withColumn("query", F.lit(True)))
    deals = spark.createDataFrame([(p, max(1, -(-k // block))) for p, k in enumerate(sizes)], "part int, deals int")
    spread = placed(routed, deals)
    spread = spread.repartition("part", "deal").sortWithinPartitions("part", "deal", "query")
    near = spread.mapInArrow(_rerank(top), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
