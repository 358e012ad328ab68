"""Chat formatting: a hidden Markov model recovers who speaks in each line of a conversation, then turns are rendered canonically.

A conversation is the lines of its rows, in the order of their turns. Hidden states are the roles. Seen are, for each line, a speaker marker (which role
it names, and whether by a whole word or a letter), a shape (question, list, code, short, long, ...), whether it opens a row, and then also the size of
the row. A row starts a turn; inside a row a line may start one, far more often if the row opens with a marker, as a transcript does. Starts,
transitions between turns, shapes, sizes and how far markers can be trusted are counted from rows whose role is known. Decoding never sees
the roles: Viterbi finds the most probable ones of a whole conversation.

Conversations lie in ranges of (conversation, turn), so one with very many rows spans many tasks. A task decodes what lies wholly inside its range. For what may go on
before or after it, it keeps the best paths for every role before and every role at the end, and a matrix of their scores. The driver
chains the matrices, two for each range, and a second pass takes the path that the chain chose.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, table

ROLES = ("system", "user", "assistant")
#: Other names of the roles, in role columns and in speaker markers.
ALIASES = {"system": 0, "instruction": 0, "developer": 0, "user": 1, "human": 1, "q": 1, "question": 1, "prompter": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "a": 2, "answer": 2, "model": 2, "agent": 2}
SHAPES = ("blank", "question", "list", "code", "short", "medium", "long")
#: Sizes of rows, by doublings of the number of their characters.
SIZES = 24
#: Probability that a line inside a row starts a turn: in a plain row, and in one that opens with a marker.
TURN = (0.002, 0.3)
#: Probability that a line which starts a turn is marked, and that one which does not looks so, for names of a word and of a letter.
MARKED, ALIKE = (0.45, 0.45), (0.002, 0.05)
#: Share of a marker's turns that are of the role it names, before any are counted, and the weight of that share, and of ALIKE, in lines.
NAMED, WEIGHT = 0.98, 50
#: Conversations whose hash leaves no remainder are held out from learning.
HOLD_OUT = 5
#: What the opening of a turn mark becomes inside a content: a zero-width space stands between its signs.
BROKEN = "<\u200b|"
#: The state before the first turn, and the number of states with it.
NONE, STATES = len(ROLES), len(ROLES) + 1
_MARKER = re.compile(r"^\s*(?:<\|(\w+)\|>|\[(\w+)\]\s*:?|#{1,4}\s*(\w+)\s*:?\s*$|\*{0,2}(\w+)\*{0,2}\s*:)\s*", re.ASCII)
_END = re.compile(r"\s*<\|(?:end|im_end|endoftext)\|>\s*$")


def marker(line: str) -> tuple[int, int, str]:
    """(role or -1, 1 if a letter names it, the line without its marker)."""
    m = _MARKER.match(line)
    name = next((x for x in m.groups() if x), "").lower() if m else ""
    return (ALIASES[name], int(len(name) == 1), line[m.end() :]) if name in ALIASES else (-1, 0, line)


def shape(line: str) -> int:
    s = line.strip()
    if not s:
        return 0
    if s.endswith("?"):
        return 1
    if s[0] in "-*+•" or s[0].isdigit() and s[1:3].strip(" ")[:1] in (".", ")"):
        return 2
    if s.startswith("```") or line.startswith(("    ", "\t")):
        return 3
    return 4 if len(s) < 40 else 5 if len(s) < 200 else 6


def role_number(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), -1)


def steps(text: str | None) -> tuple[list[tuple], list[tuple[str, str]]]:
    """What is seen of each line, (opens the row, transcript, size, marker, by a letter, shape), and the lines, whole and without markers. None for a null or blank text."""
    if not text or text.isspace():
        return [], []
    lines = text.split("\n")
    first = next(i for i, x in enumerate(lines) if x and not x.isspace())
    size, transcript = min(len(text).bit_length(), SIZES - 1), int(marker(lines[first])[0] >= 0)
    seen, out = [], []
    for i, x in enumerate(lines[first:]):
        if transcript:
            x = _END.sub("", x)
        role, letter, rest = marker(x)
        seen.append((int(not i), transcript, size, role, letter, shape(rest)))
        out.append((x, rest))
    return seen, out


class RoleModel:
    """Log probabilities from counts of known rows: starts[role], follows[role before][role], shapes[role][shape], sizes[role][size], named[role][role], and (lines, lines like markers of a word, of a letter)."""

    def __init__(self, counts: dict | None = None):
        k, counts = len(ROLES), counts or {}

        def share(name, shape_, prior):
            n = prior + counts.get(name, np.zeros(shape_))
            return np.log(n / n.sum(axis=-1, keepdims=True)).tolist()

        self.start, self.follow = share("starts", k, np.ones(k)), share("follows", (k, k), np.ones((k, k)))
        self.shape, self.size = share("shapes", (k, len(SHAPES)), np.ones((k, len(SHAPES)))), share("sizes", (k, SIZES), np.ones((k, SIZES)))
        off = (1 - NAMED) / (k - 1)
        self.named = share("named", (k, k), WEIGHT * np.where(np.eye(k) > 0, NAMED, off))
        lines = counts.get("lines", np.zeros(3))
        self.turn, self.no_turn = np.log(TURN).tolist(), np.log1p(-np.array(TURN)).tolist()
        self.marked, self.unmarked = np.log(MARKED).tolist(), float(np.log(1 - MARKED[0]))
        alike = (np.array(ALIKE) * WEIGHT * 20 + lines[1:]) / (WEIGHT * 20 + lines[0])
        self.alike = [np.log(alike).tolist(), np.log(ALIKE).tolist()]  # in plain rows, and in transcripts
        self.ways: dict = {}

    def scores(self, step: tuple) -> list[list[tuple[float, int]]]:
        """ways[state before][role]: (score, whether a turn starts)."""
        got = self.ways.get(step)
        if got is None:
            opens, transcript, size, mark, letter, form = step
            got = []
            for before in range(STATES):
                row = []
                for r in range(len(ROLES)):
                    seen = self.shape[r][form]
                    turn = self.start[r] if before == NONE else self.follow[before][r]
                    if mark >= 0:
                        turn += self.named[r][mark]
                    if opens or before == NONE:
                        row.append((seen + turn + (0.0 if transcript else self.size[r][size]), 1))
                        continue
                    turn += self.turn[transcript] + (self.marked[letter] if mark >= 0 else self.unmarked)
                    stay = self.no_turn[transcript] + (self.alike[transcript][letter] if mark >= 0 else 0.0) if before == r else -np.inf
                    row.append((seen + stay, 0) if stay >= turn else (seen + turn, 1))
                got.append(row)
            self.ways[step] = got
        return got

    def paths(self, seen: list[tuple], entry: int) -> tuple[list[float], list[bytes]]:
        """For each state at the end, the best score and path (role, and 4 where a turn starts) from state ``entry``."""
        best, back = [-np.inf] * STATES, []
        best[entry] = 0.0
        for step in seen:
            ways, new, come = self.scores(step), [-np.inf] * STATES, [None] * len(ROLES)
            for before in range(STATES):
                if best[before] > -np.inf:
                    for r, (s, starts) in enumerate(ways[before]):
                        s += best[before]
                        if s > new[r]:
                            new[r], come[r] = s, (before, r + 4 * starts)
            best = new
            back.append(come)
        out = []
        for end in range(STATES):
            path, at = bytearray(len(seen)), end
            if best[end] > -np.inf:
                for t in range(len(seen) - 1, -1, -1):
                    at, path[t] = back[t][at]
            out.append(bytes(path))
        return best, out

    def decode(self, seen: list[tuple]) -> bytes:
        best, paths = self.paths(seen, NONE)
        return paths[int(np.argmax(best))]


def assemble(lines: list[tuple[str, str]], path: bytes) -> list[tuple[str, str]]:
    """(role, content) turns of a row's lines; a marker goes only where a turn of the role that it names starts."""
    turns: list[tuple[int, list[str]]] = []
    for (whole, rest), p in zip(lines, path):
        r, starts = p & 3, p & 4
        if starts or not turns:
            turns.append((r, []))
        turns[-1][1].append(rest if starts and marker(whole)[0] == r else whole)
    out = [(ROLES[r], "\n".join(x).strip()) for r, x in turns]
    return [t for t in out if t[1]]


def parse(text: str | None, model: RoleModel) -> list[tuple[str, str]]:
    """(role, content) turns of one transcript; none for a null or blank one."""
    seen, lines = steps(text)
    return assemble(lines, model.decode(seen))


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical turns; marks of turns inside a content are broken up, so that the rendering can be read back."""
    return "".join(f"<|{r}|>\n{c.replace('<|', BROKEN)}\n<|end|>\n" for r, c in turns)


def _line_counts(batches):
    """Rows (what, at, n) of a partition: shapes, sizes, named roles, and lines that look like markers inside plain rows."""
    k = len(ROLES)
    shapes, sizes, named, lines = np.zeros((k, len(SHAPES)), np.int64), np.zeros((k, SIZES), np.int64), np.zeros((k, k), np.int64), np.zeros(3, np.int64)
    for b in batches:
        for r, text in zip(b.column(0).to_pylist(), b.column(1)):
            for opens, transcript, size, mark, letter, form in steps(text.as_py())[0]:
                if opens and mark >= 0:
                    named[r, mark] += 1
                if transcript:  # may hold turns of other roles
                    continue
                shapes[r, form] += 1
                if opens:
                    sizes[r, size] += 1
                else:
                    lines += (1, int(mark >= 0 and not letter), int(mark >= 0 and letter))
    whats = {"shapes": shapes, "sizes": sizes, "named": named, "lines": lines}
    what, at, n = zip(*((w, i, c) for w, counts in whats.items() for i, c in enumerate(counts.ravel().tolist())))
    yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["what", "at", "n"])


def fit(rows: DataFrame) -> RoleModel:
    """From rows (conv, turn, role, text), all of them that have a known role; counts are summed in the partitions first.

    A conversation starts with its smallest turn. One turn follows another inside a run of 64 turn numbers, so no task orders a whole conversation.
    """
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    known = rows.withColumn("r", F.element_at(names, F.lower(F.trim("role")))).where("r is not null")
    counted = known.select("r", "text").mapInArrow(_line_counts, "what string, at int, n long").groupBy("what", "at").agg(F.sum("n").alias("n"))
    placed = known.where("conv is not null").select("conv", F.col("turn").cast("long").alias("turn"), "r")
    starts = placed.groupBy("conv").agg(F.min_by("r", F.struct("turn", "r")).alias("r")).groupBy("r").agg(F.count("*").alias("n"))
    one = placed.where("turn is not null").groupBy("conv", "turn").agg(F.min("r").alias("r"))
    before = F.lag("r").over(Window.partitionBy("conv", F.floor(F.col("turn") / 64)).orderBy("turn"))
    follows = one.select(before.alias("before"), "r").where("before is not null").groupBy("before", "r").agg(F.count("*").alias("n"))
    k = len(ROLES)
    shapes = {"starts": (k,), "follows": (k, k), "shapes": (k, len(SHAPES)), "sizes": (k, SIZES), "named": (k, k), "lines": (3,)}
    every = counted.unionByName(starts.select(F.lit("starts").alias("what"), F.col("r").alias("at"), "n")).unionByName(follows.select(F.lit("follows").alias("what"), (F.col("before") * k + F.col("r")).alias("at"), "n"))
    counts = {w: np.zeros(s) for w, s in shapes.items()}
    for r in every.collect():  # at most a few hundred rows
        counts[r["what"]].ravel()[r["at"]] = r["n"]
    return RoleModel(counts)


_KINDS = "__text string, __part int, __edge int, __paths binary, __scores array<double>"


def _decode(model, keys):
    """Rows sorted by conversation: each with its path (edge 0), or with the paths for every state before and at the end (edge 1: of a conversation that may have
    begun before this range, 2: of one that may go on after it); and for each edge a row with the scores, whose text is null."""

    def run(batches):
        part, made, names, kinds = TaskContext.get().partitionId(), [], None, None

        def decode(rows, edge, through=False):
            read = [steps(r[-1])[0] for r in rows]
            flat, ends = [s for x in read for s in x], np.cumsum([len(x) for x in read]).tolist()
            if edge:
                best = [model.value.paths(flat, e) for e in ([*range(STATES)] if edge == 1 else [NONE])]
                every = [p for _, paths in best for p in paths]
                made.append((*rows[0][:-1], None, part, -edge, None, [s for scores, _ in best for s in scores] + [float(through)]))
            else:
                every = [model.value.decode(flat)]
            for r, x, hi in zip(rows, read, ends):
                made.append((*r, part, edge, b"".join(p[hi - len(x) : hi] for p in every), None))

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)
            made.clear()
            return batch

        held, first = [], True
        for b in batches:
            if names is None:
                names = [*b.schema.names[: keys + 1], "__part", "__edge", "__paths", "__scores"]
                kinds = [*(b.schema.field(i).type for i in range(keys + 1)), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64())]
            for row in zip(*(b.column(i).to_pylist() for i in range(keys + 1))):
                if held and (row[0] is None or row[0] != held[-1][0]):
                    decode(held, int(first))
                    held, first = [], False
                    if len(made) > 4_000:
                        yield out()
                held.append(row)
        if held:
            decode(held, 1 if first else 2, through=first)
        if made:
            yield out()

    return run


def chain(summaries: list) -> dict:
    """{(part, edge): (state before, state at the end)} from (part, edge, conversation, scores) of all ranges: the best path of each conversation through the ranges that it spans."""
    chosen, links, best, conv = {}, [], None, None

    def close():
        if links:
            end = int(np.argmax(best))
            for at, come in reversed(links):
                chosen[at] = (come[end], end)
                end = come[end]
            links.clear()

    for part, edge, of, scores in sorted(summaries, key=lambda s: (s[0], s[1])):
        m, through = np.array(scores[:-1], float).reshape(-1, STATES), scores[-1]
        if edge == 1 and links and of is not None and of == conv:
            ways = best[:, None] + m
            come, best = ways.argmax(axis=0).tolist(), ways.max(axis=0)
        else:
            close()
            come, best = [NONE] * STATES, m[-1]
        links.append(((part, edge), come))
        conv = of
        if edge == 1 and not through:
            close()
    close()
    return chosen


def _format(chosen):
    def run(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            turns = []
            for text, part, edge, paths in zip(cols["__text"], cols["__part"].to_pylist(), cols["__edge"].to_pylist(), cols["__paths"].to_pylist()):
                lines = steps(text.as_py())[1]
                if edge:
                    before, end = chosen.value[part, edge]
                    paths = paths[((before if edge == 1 else 0) * STATES + end) * len(lines) :][: len(lines)]
                turns.append(assemble(lines, paths))
            made = [pa.array([len(t) for t in turns], pa.int32()), pa.array([",".join(r for r, _ in t) for t in turns], pa.string()), pa.array([render(t) for t in turns], pa.string())]
            keys = b.schema.names[: b.schema.names.index("__text")]
            yield pa.RecordBatch.from_arrays([*(cols[k] for k in keys), *made], [*keys, "n_turns", "roles", "rendered"])

    return run


def format_turns(rows: DataFrame, keys: tuple[str, str] = ("conv_id", "turn"), role_col: str = "role", text_col: str = "text", model: RoleModel | None = None) -> DataFrame:
    """A row for every row: the keys, n_turns, roles (decoded, in order, joined by commas), rendered.

    ``keys`` name a conversation and the order in it. Without a ``model`` one is fitted to the rows with a known role; roles are not read otherwise, so a changed or missing
    role of a row changes nothing but those counts. Rendered rows of a conversation, in order, are its whole rendering. Each row with a null
    conversation is one of its own. Rows of one turn go by the hash of their text, repeated rows are turns like others. A null or blank text has no turns and renders
    as the empty text. Very long texts, and conversations of any number of rows, are read whole. Other columns are not read, whatever their names. An empty
    table gives an empty result.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    if model is None:
        model = fit(rows.select(F.col(keys[0]).alias("conv"), F.col(keys[1]).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")))
    rows = rows.select(*keys, F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    h = F.xxhash64("__text")
    laid = rows.withColumn("__spread", F.monotonically_increasing_id()).repartitionByRange(*keys, h, "__spread").sortWithinPartitions(*keys, h, "__spread").drop("__spread")
    paths = laid.mapInArrow(_decode(spark.sparkContext.broadcast(model), len(keys)), f"{kinds}, {_KINDS}")
    paths = scratch.save(paths)
    edges = [(r[1], -r[2], r[0], r[3]) for r in paths.where("__edge < 0").select(keys[0], "__part", "__edge", "__scores").collect()]  # two for each range
    chosen = spark.sparkContext.broadcast(chain(edges))
    return paths.where("__edge >= 0").drop("__scores").mapInArrow(_format(chosen), f"{kinds}, n_turns int, roles string, rendered string")


def held_out(conv):
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, held_out, n_turns, roles, rendered; the model learns from the conversations that are not held out."""
    rows = table(spark, sf_dir, "conversations")
    train = rows.where(~held_out(F.col("conv_id"))).select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    got = format_turns(rows, model=fit(train))
    return got.select("conv_id", "turn", held_out(F.col("conv_id")).alias("held_out"), "n_turns", "roles", "rendered")
