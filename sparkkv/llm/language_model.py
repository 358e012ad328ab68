"""A gated recurrent language model in numpy, with a class-factored softmax, and a smoothed unigram baseline.

Counts of all training tokens are gathered from the whole corpus. The most frequent tokens are the model's vocabulary, the rest are one symbol
whose probability is shared out by smoothed counts, so the model gives every text a proper probability. It is trained by backpropagation
through windows of WINDOW tokens, with the state carried on: first, on the driver, on about START_PIECES pieces of PIECE tokens, drawn from all
training documents by a hash, which only gives all tasks one start; then on all training documents. In each of ROUNDS rounds every task runs once over its share of a part of the documents, starting from the same weights, and the tasks' weights
are averaged by their tokens. Every token of every training document is learnt from once in the rounds. A task lays its documents end to
end and cuts them into lanes, so a document across the start of a lane begins there with a new state.
Scoring runs the documents of a task side by side, window after window, and carries each document's state from its first to its last token.

The counts of frequent tokens (at most HOT) are broadcast. The other tokens meet their counts in a join.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, most_frequent, table

HOLD_OUT, HELD = 7, 2
#: Most counts that are broadcast, and most bytes of a token among them.
HOT, HOT_BYTES = 300_000, 64
VOCABULARY = 2_048
CLASSES = 45
UNITS = 16
WINDOW = 32
STREAMS = 64
STEPS = 1_500
#: Pieces that the network starts on, about, and tokens of one: at most about 5 MB that come to the driver.
START_PIECES, PIECE = 5_000, 512
#: Passes over a share each of all training documents, their first rate, streams side by side, and tokens that a task lays end to end.
ROUNDS, RATE, LANES, LEARN_TOKENS = 3, 0.006, 256, 1_000_000
#: Tasks that sum the tasks' weights, so that as many rows at most come to the driver.
SLOTS = 32
#: Scores up to which exponentials and their sums stay finite in 32 bits.
SAFE = 60.0
#: Documents and tokens that a task runs side by side.
POOL_DOCS, POOL_TOKENS = 3_000, 3_000_000
#: The end of a text, as a token; no word is empty.
END = b""


def tokens(raw: bytes | None) -> list[bytes]:
    out = raw.lower().split() if raw else []
    out.append(END)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Adam:
    """Steps on the parameters p, in place; a gradient longer than 1 takes a smaller one."""

    def __init__(self, p: dict):
        self.p, self.n = p, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, grads: dict, rate: float) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
        rate = float(rate / max(norm, 1.0)) / (1 - 0.9**self.n)
        for k, v in grads.items():
            self.first[k] += 0.1 * (v - self.first[k])
            v *= v
            self.second[k] += 0.01 * (v - self.second[k])
            self.p[k] -= rate * self.first[k] / (np.sqrt(self.second[k] / (1 - 0.99**self.n)) + 1e-8)


class Network:
    """ids: 0 the end (also what stands before a text), 1 the symbol for other tokens, then words by frequency."""

    def __init__(self, counts: np.ndarray, units: int = UNITS, classes: int = CLASSES, seed: int = 3):
        self.size, g = len(counts), units
        rng = np.random.default_rng(seed)
        mass = np.sqrt(np.maximum(counts, 1).astype(float))
        label = np.minimum((np.cumsum(mass) - mass / 2) / mass.sum() * classes, classes - 1).astype(int)
        label = np.unique(label, return_inverse=True)[1]
        self.label, self.edges = label, np.append(np.flatnonzero(np.diff(label, prepend=-1)), self.size)
        c = len(self.edges) - 1

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"E": draw(self.size, g, scale=0.3), "W": draw(g, 3 * g, scale=g**-0.5), "U": draw(g, 3 * g, scale=g**-0.5), "b": np.zeros(3 * g, np.float32)}
        share = np.array([counts[lo:hi].sum() for lo, hi in zip(self.edges[:-1], self.edges[1:])], float)
        self.p |= {"C": draw(g, c, scale=0.1), "c": np.log(np.maximum(share, 1)).astype(np.float32), "O": draw(self.size, g, scale=0.1), "o": np.log(np.maximum(counts, 1)).astype(np.float32)}

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size

    def _loss(self, h: np.ndarray, goal: np.ndarray, grads: dict | None = None):
        """Log-likelihood of each goal; with grads also the gradient of h, for the mean of the negative.

        A state's parts lie within -1 and 1, so a score is at most the sum of its weights' sizes and its bias; only beyond SAFE are scores moved below 0 first.
        """
        p, n = self.p, len(h)
        s = h @ p["C"]
        s += p["c"]
        if float((np.abs(p["C"]).sum(axis=0) + np.abs(p["c"])).max()) > SAFE or h.dtype != np.float32:
            s -= s.max(axis=1, keepdims=True)
        label, rows = self.label[goal], np.arange(n)
        out = s[rows, label]
        e = np.exp(s, out=s)
        total = e @ np.ones(e.shape[1], e.dtype)
        out -= np.log(total)
        order = np.argsort(label.astype(np.uint16), kind="stable")
        if grads is not None:
            e *= (1 / (total * n))[:, None]
            e[rows, label] -= 1 / n
            grads["C"], grads["c"], dh = h.T @ e, np.ones(n, e.dtype) @ e, e @ p["C"].T
            back = np.zeros_like(dh)
        cuts = np.searchsorted(label[order], np.arange(len(self.edges))).tolist()
        xs, goals, inner = h[order], goal[order], np.zeros_like(out)
        most = np.abs(p["O"]).sum(axis=1) + np.abs(p["o"])
        for c, (lo, hi) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist())):
            first, last = cuts[c], cuts[c + 1]
            if first == last or hi - lo == 1:
                continue
            x = xs[first:last]
            s = x @ p["O"][lo:hi].T
            s += p["o"][lo:hi]
            if most[lo:hi].max() > SAFE or h.dtype != np.float32:
                s -= s.max(axis=1, keepdims=True)
            own, here = goals[first:last] - lo, rows[: last - first]
            inner[first:last] = s[here, own]
            e = np.exp(s, out=s)
            total = e @ np.ones(hi - lo, e.dtype)
            inner[first:last] -= np.log(total)
            if grads is not None:
                e *= (1 / (total * n))[:, None]
                e[here, own] -= 1 / n
                grads["O"][lo:hi] += e.T @ x
                grads["o"][lo:hi] += np.ones(last - first, e.dtype) @ e
                np.matmul(e, p["O"][lo:hi], out=back[first:last])
        out[order] += inner
        if grads is not None:
            dh[order] += back
        return (out, dh) if grads is not None else out

    def _window(self, ids: np.ndarray, h: np.ndarray):
        """Log-likelihoods, gradients of the mean of the negative, and the states after a window; ids: a row for every stream, one token more than the window."""
        p, g = self.p, self.p["U"].shape[0]
        x, goal = ids[:, :-1].T, ids[:, 1:].T
        keep = (x != 0).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        e = p["E"][x]
        a = np.matmul(p["W"].T, e.transpose(0, 2, 1)) + p["b"][:, None]  # units before streams, so that the gates are contiguous
        h0s, zrs, us, ns, hs = (np.empty((len(x), k, len(ids)), np.float32) for k in (g, 2 * g, g, g, g))
        back, h = p["U"].T.copy(), h.T
        for t in range(len(x)):
            h0 = np.multiply(h, keep[t], out=h0s[t])
            u = back @ h0
            zr = np.add(a[t, : 2 * g], u[: 2 * g], out=zrs[t])
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            us[t] = u[2 * g :]
            n = np.multiply(zr[g:], us[t], out=ns[t])
            n += a[t, 2 * g :]
            np.tanh(n, out=n)
            h = np.subtract(h0, n, out=hs[t])
            h *= zr[:g]
            h += n
        h = h.T
        ll, dhs = self._loss(hs.transpose(0, 2, 1).reshape(-1, g), goal.ravel(), grads)
        dhs = np.ascontiguousarray(dhs.reshape(len(x), -1, g).transpose(0, 2, 1))
        d, das, dus = np.zeros_like(dhs[0]), np.empty_like(a), np.empty_like(a)
        for t in reversed(range(len(x))):
            z, r, n = zrs[t, :g], zrs[t, g:], ns[t]
            d += dhs[t]
            dz = d * z
            dn = np.subtract(d, dz, out=das[t, 2 * g :])
            dn *= 1 - n * n
            np.multiply(dz * (1 - z), h0s[t] - n, out=das[t, :g])
            dr = np.multiply(dn, r, out=dus[t, 2 * g :])
            np.multiply(dr * (1 - r), us[t], out=das[t, g : 2 * g])
            dus[t, : 2 * g] = das[t, : 2 * g]
            d = p["U"] @ dus[t]
            d += dz
            d *= keep[t]
        grads["W"], grads["b"] = np.matmul(das, e).sum(axis=0).T, das.sum(axis=(0, 2))
        grads["U"] = np.matmul(h0s, dus.transpose(0, 2, 1)).sum(axis=0)
        de = np.matmul(das.transpose(0, 2, 1), p["W"].T).reshape(-1, g)
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        seen = x.ravel()[order]
        cuts = np.flatnonzero(np.diff(seen, prepend=-1))
        grads["E"][seen[cuts]] = np.add.reduceat(de[order], cuts)
        return ll, grads, h

    def train(self, streams: list[np.ndarray], steps: int = STEPS, window: int = WINDOW, rate: float = 0.01) -> list[float]:
        """Adam on windows of all streams side by side; a stream starts again at its end, and the state is new after an end token."""
        adam, h, losses = Adam(self.p), np.zeros((len(streams), self.p["U"].shape[0]), np.float32), []
        for step in range(steps):
            at = np.arange(window + 1) + step * window
            ll, grads, h = self._window(np.stack([s[at % len(s)] for s in streams]), h)
            losses.append(-float(ll.mean()))
            adam.step(grads, rate * (1 - 0.9 * step / steps))
        return losses

    def learn(self, flat: np.ndarray, adam: Adam, rate: float, lanes: int = LANES, window: int = WINDOW) -> int:
        """One pass over texts laid end to end after an end token: every token is a goal once. Returns their number.

        The sequence is cut into lanes that run side by side, each with its state carried from window to window; smaller windows at the ends take smaller steps.
        """
        done = 0
        while done < len(flat) - 1:
            left = len(flat) - 1 - done
            n = min(lanes, max(1, left // window))
            size = left // n
            ids = flat[done + np.arange(n)[:, None] * size + np.arange(size + 1)]
            h = np.zeros((n, self.p["U"].shape[0]), np.float32)
            for lo in range(0, size, window):
                part = ids[:, lo : lo + window + 1]
                _, grads, h = self._window(part, h)
                adam.step(grads, rate * n * (part.shape[1] - 1) / (lanes * window))
            done += n * size
        return done

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each whole document (ids, the end last)."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.concatenate([docs[i] for i in order])
        start = np.cumsum(sizes) - sizes
        p, g = self.p, self.p["U"].shape[0]
        table_ = p["E"] @ p["W"] + p["b"]
        h, last, total, t0 = np.zeros((len(docs), g), np.float32), np.zeros(len(docs), np.int64), np.zeros(len(docs)), 0
        while t0 < sizes[0]:
            n = int(np.searchsorted(-sizes, -t0, side="left"))
            window = int(min(max(8, 65_536 // n), sizes[0] - t0, 4_096))
            states, goals, owners = [], [], []
            for t in range(t0, t0 + window):
                n = int(np.searchsorted(-sizes[:n], -t, side="left"))
                a, u = table_[last[:n]], h[:n] @ p["U"]
                zr = a[:, : 2 * g] + u[:, : 2 * g]
                zr = _sigmoid(zr)
                m = np.tanh(a[:, 2 * g :] + zr[:, g:] * u[:, 2 * g :])
                new = m + zr[:, :g] * (h[:n] - m)
                h[:n] = new
                goal = flat[start[:n] + t]
                last[:n] = goal
                states.append(new)
                goals.append(goal)
                owners.append(n)
            ll = self._loss(np.concatenate(states), np.concatenate(goals))
            at = 0
            for n in owners:
                total[:n] += ll[at : at + n]
                at += n
            t0 += window
        out[order] = total / np.log(10)
        return out


def _count(batches):
    names = ["token", "n"]
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names)

    for b in batches:
        for t in b.column(0):
            seen.update(tokens(t.as_py()))
        if len(seen) > 500_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _ids(words, ids) -> np.ndarray:
    return np.fromiter((ids.get(w, 1) for w in words), np.int64, len(words))


def _sample(vocabulary, share):
    """Pieces of the texts whose hash of (hash of the text, place) falls within ``share`` of 2^32."""

    def run(batches):
        ids = vocabulary.value
        for b in batches:
            got = []
            for h, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = tokens(t.as_py())
                for k in range(0, len(words), PIECE):
                    if zlib.crc32(b"%d:%d" % (h, k)) < share:
                        got.append(_ids(words[k : k + PIECE], ids).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["ids"])

    return run


def _learn(state, rate):
    """A row for a task: (slot, task, tokens, weights) after one pass over its texts."""

    def run(batches):
        network, ids = state.value
        network = copy.deepcopy(network)
        adam, held, pooled, done = Adam(network.p), [np.zeros(1, np.int64)], 0, 0
        for b in batches:
            for t in b.column(0):
                held.append(_ids(tokens(t.as_py()), ids))
                pooled += len(held[-1])
                if pooled >= LEARN_TOKENS:
                    done += network.learn(np.concatenate(held), adam, rate)
                    held, pooled = held[:1], 0
        if pooled:
            done += network.learn(np.concatenate(held), adam, rate)
        if done:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task % SLOTS], pa.int32()), pa.array([task], pa.int32()), pa.array([done], pa.int64()), pa.array([network.packed().tobytes()], pa.binary())], ["slot", "task", "tokens", "weights"])

    return run


def _mean(batches):
    """Of the rows of a partition, weighted by their tokens."""
    tokens_, total = 0, 0.0
    for b in batches:
        for n, w in zip(b.column(2).to_pylist(), b.column(3)):
            tokens_, total = tokens_ + n, total + n * np.frombuffer(w.as_buffer(), np.float32).astype(float)
    if tokens_:
        yield pa.RecordBatch.from_arrays([pa.array([tokens_], pa.int64()), pa.array([(total / tokens_).astype(np.float32).tobytes()], pa.binary())], ["tokens", "weights"])


def learn_all(network: Network, train: DataFrame, ids: dict, rounds: int = ROUNDS) -> int:
    """Trains on all texts of ``train`` (doc_id, text), each in one of the rounds: every task runs over its share, then the tasks' weights are averaged. Returns the tokens learnt from."""
    context, done = train.sparkSession.sparkContext, 0
    of = F.pmod(F.xxhash64("text", "doc_id"), F.lit(rounds))
    for k in range(rounds):
        state = context.broadcast((network, ids))
        part = train.where(of == k).select("text").mapInArrow(_learn(state, RATE * (1 - k / rounds)), "slot int, task int, tokens long, weights binary")
        part = part.repartition(SLOTS, "slot").sortWithinPartitions("slot", "task").mapInArrow(_mean, "tokens long, weights binary")
        got = sorted((r.tokens, bytes(r.weights)) for r in part.collect())
        n = sum(t for t, _ in got)
        if n:
            network.unpack((sum(t * np.frombuffer(w, np.float32).astype(float) for t, w in got) / n).astype(np.float32))
        done += n
        state.unpersist()
    return done


class Model:
    """What scoring tasks need: the network, and for each frequent token its place in two arrays, log10(c + 1) and the network's id."""

    def __init__(self, network, ids, frequent):
        self.network = network
        self.place = {t: i for i, (t, _) in enumerate(frequent)}
        self.logs = np.log10(np.array([n for _, n in frequent] + [0], float) + 1)  # the last stands for tokens without a place
        self.ids = np.array([ids.get(t, 1) for t, _ in frequent] + [1], np.int32)


def _score(model):
    """Per document what is known here, and its rare tokens."""

    def run(batches):
        m = model.value
        find = m.place.get
        names = ["doc_id", "text_hash", "held_out", "n_tokens", "n_hot", "sum_hot", "n_other", "other_hot", "network", "rare", "times"]
        held, docs = [], []

        def out():
            net = m.network.score(docs) if m.network else np.zeros(len(docs))
            cols = [*zip(*held)]
            cols.insert(8, net.tolist())
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        pooled = 0
        for b in batches:
            for i, h, out_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                words = tokens(t.as_py())
                at = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
                unplaced = np.flatnonzero(at < 0).tolist()
                rare: Counter = Counter([words[k] for k in unplaced])
                seq, logs = m.ids[at], m.logs[at]
                seq[-1] = 0  # the end, frequent or not
                other = seq == 1
                held.append((i, h, out_, len(words), len(words) - len(unplaced), float(logs.sum()), int(other.sum()), float(logs[other].sum()), list(rare), list(rare.values())))
                docs.append(seq)
                pooled += len(words)
                if len(docs) >= POOL_DOCS or pooled >= POOL_TOKENS:
                    yield out()
                    held, docs, pooled = [], [], 0
        if docs:
            yield out()

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, vocabulary: int = VOCABULARY, steps: int = STEPS) -> DataFrame:
    """A row for every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    A null or empty text is the end token alone. Rows with a null id are training rows. Repeated rows count, and score, each for itself.
    Without training rows the model is the baseline. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")  # Python workers: small products gain nothing from threads that wait for each other
    scratch = Scratch(spark)
    out = F.crc32(F.col(id_col).cast("string").cast("binary")) % HOLD_OUT == HELD
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(out, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    train = rows.where("not held_out")
    counts = scratch.save(train.select("text").mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = counts.where(F.length("token") <= HOT_BYTES)
    frequent = most_frequent(short, hot)
    frequent = sorted(((bytes(r.token), r.n) for r in frequent), key=lambda r: (-r[1], r[0]))
    words = [(t, n) for t, n in frequent if t != END][: vocabulary - 2]
    ends = train.count()
    other = n_all - ends - sum(n for _, n in words)
    ids = {END: 0} | {t: i + 2 for i, (t, _) in enumerate(words)}
    network = None
    if ends:
        network = Network(np.array([ends, max(other, 1), *(n for _, n in words)], float))
        share = int(min(1.0, START_PIECES / (n_all / PIECE + ends)) * (1 << 32))  # at most so many pieces, the last of a document is short
        part = train.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("h"), "text").mapInArrow(_sample(spark.sparkContext.broadcast(ids), share), "ids binary")
        got = sorted(bytes(r.ids) for r in part.collect())
        np.random.default_rng(5).shuffle(got)
        streams = [b"".join(got[k::STREAMS]) for k in range(STREAMS)]
        streams = [np.concatenate([[0], np.frombuffer(s, "<u2")]).astype(np.int64) for s in streams if s]
        if streams:
            network.train(streams, steps)
        learn_all(network, train.select("doc_id", "text"), ids)
    model = spark.sparkContext.broadcast(Model(network, ids, frequent))
    base = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "held_out", "text")
    kinds = "doc_id long, text_hash long, held_out boolean, n_tokens long, n_hot long, sum_hot double, n_other long, other_hot double, network double, rare array<binary>, times array<int>"
    part = scratch.save(base.mapInArrow(_score(model), kinds))
    rare = part.where(F.size("rare") > 0).select("doc_id", "text_hash", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("doc_id", "text_hash", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    cold = rare.join(counts, "token").groupBy("doc_id", "text_hash").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("sum_rare"))
    twins = part.where(F.size("rare") > 0).groupBy("doc_id", "text_hash").agg(F.count("*").alias("twins"))  # repeated rows
    cold = cold.join(twins, cold["doc_id"].eqNullSafe(twins["doc_id"]) & cold["text_hash"].eqNullSafe(twins["text_hash"])).select(cold["doc_id"].alias("c_id"), cold["text_hash"].alias("c_hash"), (F.col("n_rare") / F.col("twins")).cast("long").alias("n_rare"), (F.col("sum_rare") / F.col("twins")).alias("sum_rare"))
    both = part.drop("rare", "times").join(cold, part["doc_id"].eqNullSafe(cold["c_id"]) & part["text_hash"].eqNullSafe(cold["c_hash"]), "left")
    sum_rare = F.coalesce("sum_rare", F.lit(0.0))
    whole = float(np.log10(n_all + v_all + 1))
    outside = float(np.log10(max(other, 0) + max(v_all - len(words) - (1 if ends else 0), 0) + 1))
    base_score = F.col("sum_hot") + sum_rare - F.col("n_tokens") * whole
    net = F.col("network") + F.col("other_hot") + sum_rare - F.col("n_other") * outside if network else base_score
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base_score.alias("base_score"), net.alias("score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
