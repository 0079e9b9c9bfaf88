"""Roles of raw transcripts by a hidden Markov model, and canonical rendering of the turns.

A transcript is rows (conv_id, turn, text) whose lines may or may not begin with a speaker marker. The states are ROLES.
A line's emission has two independent parts: what marker it begins with (MARKER_HIT for the role's own, MARKER_MISS for
another's, the rest for none; only lines that can open a turn carry one) and its length class, whose frequencies by role
are counted on the training conversations. Within a row the role stays with probability STAY; at a marker within a row
either that or a turn's change is as likely; between rows it moves by transition frequencies, and a conversation starts by
start frequencies, both counted on the training conversations (add-one). Viterbi's path gives every line its role.

A marker is a name with a colon, in brackets, or alone after three number signs; a bare word or letter on a line is text.
It is cut off only where the path says that it opens a turn: on a row's first line if the line has the marker's role, on
later lines if the path changes to the marker's role there. Any other such line is content ("A: " in a list, say) and stays
as it is. Adjacent lines of one role are joined, and each turn is rendered between marks, so nothing but markers goes.

A conversation may be far too long for one task. Rows are range-partitioned by (conv_id, turn), and each partition cuts its
rows of a conversation into segments of at most SEGMENT_ROWS rows and about SEGMENT_CHARS characters. A segment's best paths are found for every state before it
and every last state; only these scores (12 numbers a segment) meet in one place, where the states at the boundaries are
chosen, exactly as one pass over the whole conversation would. Ties go to the earlier role in ROLES.

Null conv_ids are one conversation; null turns come first; null texts are empty (one empty line). Repeated rows each get
their row, in the order of their text. Other columns are ignored. conv_id and turn are taken as long integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, cut

ROLES = ("system", "user", "assistant")
MARKERS = {
    "system": ("System: ", "[system] ", "### System\n"),
    "user": ("User: ", "Human: ", "Q: ", "### User\n"),
    "assistant": ("Assistant: ", "AI: ", "A: ", "### Assistant\n"),
}
FOLDS, HELD_OUT = 5, 0
SEGMENT_ROWS, SEGMENT_CHARS = 2000, 1 << 22
MARKER_HIT, MARKER_MISS = 0.7, 0.01
STAY = 0.995
#: Upper ends of the length classes of a line, in characters.
LENGTHS = (40, 120, 250, 500)
START = len(ROLES)
_OPENING = re.compile(r"###\s+(system|user|human|assistant)\s*$|\[(system|user|human|assistant)\]\s*|(system|user|human|q|assistant|ai|a):(?:\s+|$)", re.IGNORECASE)
_SPEAKER = {"system": 0, "user": 1, "human": 1, "q": 1, "assistant": 2, "ai": 2, "a": 2}


def marker(line: str) -> tuple[int | None, str]:
    """(role number, rest) of a line that begins with a speaker marker, else (None, line)."""
    m = _OPENING.match(line)
    return (_SPEAKER[m[m.lastindex].lower()], line[m.end() :]) if m else (None, line)


def length_class(n: int) -> int:
    return sum(n > x for x in LENGTHS)


class Model:
    """Log probabilities: start (S), move (S, S), lengths (S, classes)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> None:
        log = lambda m: np.log((m + 1) / (m + 1).sum(-1, keepdims=True))
        self.start, self.move, self.lengths = log(start), log(move), log(lengths)
        s = len(ROLES)
        self.stay = np.log(np.where(np.eye(s), STAY, (1 - STAY) / (s - 1)))
        self.turn = np.logaddexp(self.stay, self.move) - np.log(2)  # at a marker within a row
        self.first = np.vstack([self.move, self.start])  # from each state, or from none

    def emission(self, line: str, opens: bool) -> tuple[np.ndarray, bool]:
        """Of each role; and whether the line begins with a marker."""
        role, rest = marker(line)
        out = self.lengths[:, length_class(len(rest))].copy()
        if role is not None:
            out += np.log(np.where(np.arange(len(ROLES)) == role, MARKER_HIT, MARKER_MISS))
        elif opens:
            out += np.log(1 - MARKER_HIT - MARKER_MISS * (len(ROLES) - 1))
        return out, role is not None

    def best_paths(self, rows: list[list[str]]) -> tuple[np.ndarray, list[list[str]]]:
        """For a segment's rows of lines: scores (states before, last states) and for each such pair each row's path."""
        score, back = None, []
        for lines in rows:
            for i, line in enumerate(lines):
                emit, marked = self.emission(line, i == 0)
                step = self.move if i == 0 else self.turn if marked else self.stay
                if score is None:
                    score = self.first + emit
                    continue
                options = score[:, :, None] + step[None]
                back.append(options.argmax(1))
                score = options.max(1) + emit
        n = len(back) + 1
        paths = []
        for a in range(len(ROLES) + 1):
            for b in range(len(ROLES)):
                states, s = [b], b
                for p in reversed(back):
                    s = int(p[a, s])
                    states.append(s)
                states.reverse()
                paths.append("".join(map(str, states)))
        assert len(paths[0]) == n
        cuts = np.cumsum([0, *map(len, rows)])
        return score, [[p[x:y] for p in paths] for x, y in zip(cuts, cuts[1:], strict=False)]


def chain(scores: list[list[float]]) -> list[tuple[int, int]]:
    """(state before, last state) of each segment on the best path through them all."""
    s, best, back = len(ROLES), None, []
    for flat in scores:
        m = np.array(flat).reshape(s + 1, s)
        if best is None:
            best = m[START]
            back.append(np.full(s, START))
        else:
            options = best[:, None] + m[:s]
            back.append(options.argmax(0))
            best = options.max(0)
    state, out = int(best.argmax()), []
    for p in reversed(back):
        out.append((int(p[state]), state))
        state = int(p[state])
    return out[::-1]


def render(lines: list[str], path: str) -> tuple[str, int]:
    """Canonical turns of a row's lines, and their number."""
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, path, strict=True):
        new = not turns or turns[-1][0] != state
        if new:
            turns.append((state, []))
        role, rest = marker(line)
        if not new or role != int(state):
            turns[-1][1].append(line)
        elif rest:
            turns[-1][1].append(rest)
    return "".join(f"<|{ROLES[int(s)]}|>\n{chr(10).join(t)}\n<|end|>\n" for s, t in turns), len(turns)


def fit(rows: DataFrame) -> Model:
    """Counts of the training conversations' (conv_id, turn, role, text)."""
    known = rows.filter((crc_mod("conv_id", FOLDS) != HELD_OUT) & F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", "text")
    number = {r: i for i, r in enumerate(ROLES)}
    start, move, lengths = np.zeros(len(ROLES)), np.zeros((len(ROLES),) * 2), np.zeros((len(ROLES), len(LENGTHS) + 1))
    for r in known.filter("turn = 0").groupBy("role").count().collect():
        start[number[r.role]] = r["count"]
    pair = known.select("conv_id", "turn", F.col("role").alias("a")).join(known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("b")), ["conv_id", "turn"])
    for r in pair.groupBy("a", "b").count().collect():  # roles squared
        move[number[r.a], number[r.b]] = r["count"]
    n = F.length("line")
    kind = sum(((n > x).cast("int") for x in LENGTHS), F.lit(0))
    lines = known.select("role", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    for r in lines.groupBy("role", kind.alias("kind")).count().collect():
        lengths[number[r.role], r.kind] = r["count"]
    return Model(start, move, lengths)


def recover(transcripts: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, held_out, role (of the row's first line), n_lines, n_turns, rendered."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)
    limit, most = SEGMENT_ROWS, SEGMENT_CHARS
    kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("text", pa.string()), ("seg", pa.int64()), ("paths", pa.list_(pa.string())), ("scores", pa.list_(pa.float64()))]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, number, chars = shared.value, [], None, 0

        def closed() -> pa.RecordBatch:
            score, paths = m.best_paths([(r[2] or "").split("\n") for r in held])
            rows = [(*r, number, p, None) for r, p in zip(held, paths, strict=True)]
            rows[-1] = (*rows[-1][:5], score.ravel().tolist())  # the last row carries the segment's scores
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [name for name, _ in kinds])

        for batch in batches:
            for at, conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (held[0][0] != conv or len(held) >= limit or chars >= most):
                    yield closed()
                if not held:
                    number, chars = at, 0  # place in the global order
                held.append((conv, turn, text))
                chars += len(text or "")
        if held:
            yield closed()

    order = ["conv_id", "turn", "text"]
    rows = transcripts.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.monotonically_increasing_id().alias("at"), *order)
    done = cut(rows.mapInArrow(segments, "conv_id long, turn long, text string, seg long, paths array<string>, scores array<double>"), "segments")

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("seg", T.LongType()), T.StructField("pick", T.IntegerType())])))
    def chosen(parts: pa.Array) -> pa.Array:
        out = []
        for conv in parts.to_pylist():
            pairs = chain([x["scores"] for x in conv])
            out.append([{"seg": x["seg"], "pick": a * len(ROLES) + b} for x, (a, b) in zip(conv, pairs, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("seg", pa.int64()), ("pick", pa.int32())])))

    ends = done.filter("scores is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "scores"))).alias("parts"))
    picks = ends.select(F.explode(chosen("parts")).alias("x")).select("x.seg", "x.pick")

    @F.arrow_udf(T.StructType([T.StructField("rendered", T.StringType()), T.StructField("n_turns", T.IntegerType()), T.StructField("n_lines", T.IntegerType())]))
    def rendered(texts: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for text, path in zip(texts.to_pylist(), paths.to_pylist(), strict=True):
            lines = (text or "").split("\n")
            r, n = render(lines, path)
            out.append({"rendered": r, "n_turns": n, "n_lines": len(lines)})
        return pa.array(out, pa.struct([("rendered", pa.string()), ("n_turns", pa.int32()), ("n_lines", pa.int32())]))

    out = done.join(picks, "seg").withColumn("path", F.element_at("paths", F.col("pick") + 1))
    out = out.withColumn("r", rendered.asNondeterministic()("text", "path"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.substring("path", 1, 1).cast("int") + 1)
    return out.select("conv_id", "turn", (crc_mod("conv_id", FOLDS) == HELD_OUT).alias("held_out"), role.alias("role"), "r.n_lines", "r.n_turns", "r.rendered")


def as_transcript(rows: DataFrame) -> DataFrame:
    """Labelled rows as raw transcript: a marker of the role before three quarters of them, chosen by a hash."""
    h = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(1200))
    text: Column = F.lit("")
    for role, names in MARKERS.items():
        pick = F.element_at(F.array(*map(F.lit, names)), (F.floor(h / 4) % len(names)).cast("int") + 1)
        text = F.when(F.col("role") == role, pick).otherwise(text)
    return rows.select("conv_id", "turn", F.concat(F.when(h % 4 == 0, "").otherwise(text), F.coalesce("text", F.lit(""))).alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of the conversations, their roles recovered and turns rendered."""
    return recover(as_transcript(conversations), fit(conversations))
