"""Chat formatting: roles of raw transcripts by a hidden Markov model, and canonical rendering of the turns.

A transcript is a text of lines. Hidden states are a role and whether the line begins a turn of it or goes on with one. A line is observed by
five features: its speaker marker (a role's name, another name, none; blank), what stands before it, its length, its ending, and whether its
marker names the speaker of the last marked line. Emissions and transitions are counted on labelled conversations and smoothed by prior
counts, which alone make a usable model. Viterbi decoding finds the likeliest states of the whole transcript; a marker is taken off only
where a turn begins, so a line such as ``Note:`` inside a turn stays text. Turns are rendered ``<|role|>\\n text <|end|>``.

A transcript of one row is decoded in one piece. A conversation of many rows comes in segments of up to 256 turns, cut from rows that are range-sorted by conversation, turn,
role and text, so that one hot conversation fills many tasks; its decoding is still the one likeliest path through all of it. For that, what a segment hands on (the last
speaker and whether its last line is blank) is summed over the segments before it; each segment is reduced to the best score from every state before it to every state at its
end, an 8 x 8 matrix; a stream over these matrices carries the best scores on, one back finds each segment's first and last state, and the segments are decoded between
them in parallel. What one task streams of a hot conversation is a matrix for each of its segments; nothing is gathered. A turn that goes on into the next segment is
put together again.

Defined cases: a null transcript counts as empty and has no turns; text before any marker goes to the likeliest role; rows alike are turns of their own; null turns come
first; rows of a null conversation are conversations of their own, equal ones too; a role that is none of the known has no marker, and its turn no label in training; other
columns pass through and input columns named like an output column, in any letters, are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Settled, Taken, portions, small_batches, text_of

ROLES = ("system", "user", "assistant", "tool")
STATES = [(role, begins) for role in range(len(ROLES)) for begins in (True, False)]
SIZES = (8, 3, 5, 4, 3)  # values of each feature
BLANK, OTHER = 6, 5
#: Turns of a segment at most.
SEGMENT = 256
#: Names that markers give to the roles.
NAMES = {
    "system": 1, "instruction": 1, "instructions": 1, "context": 1,
    "user": 2, "human": 2, "you": 2, "question": 2, "q": 2, "customer": 2, "prompt": 2,
    "assistant": 3, "ai": 3, "bot": 3, "answer": 3, "a": 3, "agent": 3, "model": 3, "chatbot": 3,
    "tool": 4, "function": 4, "observation": 4, "result": 4,
}
MARK = re.compile(r"\s*(?:(?P<open>#{1,4}|\*\*|\[|<\|?|\()\s*)?(?P<name>[^\W\d_][\w'.-]{0,23}(?: [\w'.-]{1,12})?)\s*(?P<shut>\*\*|\]|\|?>|\))?(?P<sep>\s*:\s?|\s*$|\s)")


def marker(line: str) -> tuple[int, str, int]:
    """Kind (0 none, 1 to 4 a role, OTHER), the speaker's name, and the characters that the marker takes."""
    m = MARK.match(line)
    if not m:
        return 0, "", 0
    colon, name = ":" in m["sep"], m["name"].lower()
    framed = bool(m["open"]) and (bool(m["shut"]) or m["open"].startswith("#") and not m["sep"].strip())
    if not colon and not (framed and name in NAMES):
        return 0, "", 0
    if name in NAMES:
        return NAMES[name], name, m.end()
    return (OTHER, name, m.end()) if m["name"][0].isupper() else (0, "", 0)


#: What stands before the first line: no speaker, and no line that is blank or isn't.
FIRST = "", 2


def observed(lines: list[str], speaker: str = FIRST[0], blank: int = FIRST[1]) -> tuple[np.ndarray, list[int]]:
    """(lines, features) values, and the characters of each line's marker, after a line that is blank (1) or not (0) and a marker of this speaker."""
    out, cuts = [], []
    for line in lines:
        kind, name, cut = marker(line)
        body = line[cut:].strip()
        same = 0 if not kind else 1 if name == speaker else 2
        end = 0 if not body else 1 if body[-1] == "?" else 2 if body[-1] in ".!" else 3
        out.append((kind if kind or body else BLANK, blank, min(4, int(np.log2(1 + len(body) / 16))), end, same))
        cuts.append(cut)
        speaker, blank = (name if kind else speaker), int(not line.strip())
    return np.array(out, np.int64).reshape(-1, len(SIZES)), cuts


@dataclass(frozen=True)
class Model:
    """Logarithms: start (states), move (states, states), emit (one array (states, values) for each feature)."""

    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]


def prior() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Counts before any data: a turn begins with its role's marker, users and assistants take turns, a system line comes first."""
    n = len(STATES)
    start, move, emit = np.zeros(n), np.zeros((n, n)), [np.full((n, v), 1.0) for v in SIZES]
    for s, (role, begins) in enumerate(STATES):
        start[s] = (0.01, (8, 20, 2, 0.2)[role])[begins]
        emit[0][s, role + 1] += 60 * begins
        emit[0][s, OTHER] += 10 * begins
        emit[0][s, 0] += 10 if begins else 90
        emit[0][s, BLANK] += 0 if begins else 20
        for t, (next_role, next_begins) in enumerate(STATES):
            if next_begins:
                move[s, t] = ((0, 30, 3, 1), (1, 3, 40, 3), (1, 40, 2, 5), (1, 3, 40, 3))[role][next_role]
            else:
                move[s, t] = 50 if next_role == role else 0
    return start, move, emit


def model_of(start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> Model:
    def log(x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(x, 1e-9) / np.maximum(x.sum(axis=-1, keepdims=True), 1e-9))

    return Model(log(start), log(move), tuple(log(e) for e in emit))


def viterbi(model: Model, seen: np.ndarray) -> list[int]:
    """Likeliest states; of equals the first."""
    if not len(seen):
        return []
    said = sum(e[:, seen[:, k]].T for k, e in enumerate(model.emit))
    back = np.zeros(said.shape, np.int64)
    best = model.start + said[0]
    for t in range(1, len(seen)):
        way = best[:, None] + model.move
        back[t] = way.argmax(axis=0)
        best = way[back[t], np.arange(len(STATES))] + said[t]
    state = int(best.argmax())
    out = [state]
    for t in range(len(seen) - 1, 0, -1):
        state = int(back[t][state])
        out.append(state)
    return out[::-1]


def last_marked(lines: list[str]) -> str | None:
    """Speaker of the last marked line."""
    return next((name for kind, name, _ in map(marker, reversed(lines)) if kind), None)


def reach(model: Model, seen: np.ndarray, first: bool) -> np.ndarray:
    """Best scores (states, states) from each state before these lines to each at their end; of the first lines, those of the start in every row."""
    said = sum(e[:, seen[:, k]].T for k, e in enumerate(model.emit))
    best = (np.tile(model.start, (len(STATES), 1)) if first else model.move) + said[0]
    for t in range(1, len(seen)):
        best = (best[:, :, None] + model.move).max(axis=1) + said[t]
    return best


def between(model: Model, seen: np.ndarray, entry: int | None, end: int) -> list[int]:
    """Likeliest states of lines after the state ``entry`` (None: the start), the last being ``end``."""
    said = sum(e[:, seen[:, k]].T for k, e in enumerate(model.emit))
    back = np.zeros(said.shape, np.int64)
    best = (model.start if entry is None else model.move[entry]) + said[0]
    for t in range(1, len(seen)):
        way = best[:, None] + model.move
        back[t] = way.argmax(axis=0)
        best = way[back[t], np.arange(len(STATES))] + said[t]
    out = [end]
    for t in range(len(seen) - 1, 0, -1):
        out.append(int(back[t][out[-1]]))
    return out[::-1]


def turns_of(model: Model, text: str) -> list[tuple[str, str]]:
    """(role, content) of the turns of a transcript."""
    lines = text.split("\n") if text else []
    seen, cuts = observed(lines)
    out: list[tuple[int, list[str]]] = []
    for line, cut, state in zip(lines, cuts, viterbi(model, seen), strict=True):
        role, begins = STATES[state]
        if begins or not out or out[-1][0] != role:
            out.append((role, [line[cut:] if begins else line]))
        else:
            out[-1][1].append(line)
    return [(ROLES[role], "\n".join(body).strip()) for role, body in out]


def rendered(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{body}<|end|>\n" for role, body in turns)


def train(known: DataFrame) -> Model:
    """known: turns array<struct<role, text>>, the lines of a labelled transcript (or segment of one) by turn, markers included, and, of segments, ``first`` (whether it
    begins a conversation). Counts are summed in executors over (feature, state, value); what reaches the driver is one number for each of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, move, emit = (np.zeros_like(x) if isinstance(x, np.ndarray) else [np.zeros_like(e) for e in x] for x in prior())
        for x in batches:
            for turns, first in zip(x["turns"], x["first"], strict=True):
                lines, truth = [], []
                for turn in turns:
                    if turn["role"] not in ROLES:
                        continue
                    own = (turn["text"] or "").split("\n")
                    lines += own
                    truth += [2 * ROLES.index(turn["role"]) + int(k > 0) for k in range(len(own))]
                seen, _ = observed(lines)
                if truth:
                    start[truth[0]] += first
                    np.add.at(move, (truth[:-1], truth[1:]), 1)
                    for k, e in enumerate(emit):
                        np.add.at(e, (truth, seen[:, k]), 1)
        flat = np.concatenate([start, move.ravel(), *(e.ravel() for e in emit)])
        yield pd.DataFrame({"k": np.flatnonzero(flat), "n": flat[np.flatnonzero(flat)]})

    start, move, emit = prior()
    flat = np.concatenate([start, move.ravel(), *(e.ravel() for e in emit)])
    known = known.select("turns", (F.col("first") if "first" in known.columns else F.lit(True)).alias("first"))
    for row in known.mapInPandas(run, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
        flat[row.k] += row.n
    n = len(STATES)
    cuts = np.cumsum([n, n * n, *(n * v for v in SIZES)])
    parts = np.split(flat, cuts[:-1])
    return model_of(parts[0], parts[1].reshape(n, n), [p.reshape(n, v) for p, v in zip(parts[2:], SIZES, strict=True)])


def parse(transcripts: DataFrame, model: Model | None = None, column: str = "transcript") -> DataFrame:
    """A row for each turn of each transcript: the columns of ``transcripts`` without the text, turn (from 0), role, content and formatted."""
    model, own = model or model_of(*prior()), Taken(transcripts)
    names = own.stay(("turn", "role", "content", "formatted"), (column,))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in portions(batches, "body"):
            found = [turns_of(model, t) for t in x["body"]]
            out = x[names].loc[np.repeat(x.index, [len(f) for f in found])].reset_index(drop=True)
            flat = [(k, *t) for f in found for k, t in enumerate(f)]
            out["turn"] = [f[0] for f in flat]
            out["role"], out["content"] = [f[1] for f in flat], [f[2] for f in flat]
            out["formatted"] = [rendered([f[1:]]) for f in flat]
            yield out

    return own.mapped(run, names, "turn int, role string, content string, formatted string", body=text_of(own.at(column)))


def streamed(rows: DataFrame, order, step, schema: str) -> DataFrame:
    """Rows of each conversation (conv) in one stream, in this order. ``step(state, row)`` gives the new state and a row; the state is None where a conversation begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv = state = None
        for x in batches:
            out = []
            for row in x.itertuples(index=False):
                if row.conv != conv:
                    conv, state = row.conv, None
                state, new = step(state, row)
                out.append(new)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.repartition("conv").sortWithinPartitions("conv", order).mapInPandas(run, schema)


def parse_segments(segments: DataFrame, model: Model) -> DataFrame:
    """A row for each turn of each conversation in segments (conv string, segment long, transcript): conv, turn, role, content, formatted. Conversations of one segment are
    parsed as they are; of the others, the segments of each are decoded together."""
    done = Settled(segments.sparkSession, "turns")
    counts = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    all_ = segments.select("conv", "segment", "transcript").join(counts.hint("merge"), "conv")
    short = parse(all_.filter("n = 1").select("conv", "transcript"), model)
    parts = done.keep(all_.filter("n > 1").drop("n"), "segments")
    if parts.isEmpty():
        return short

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in filter(len, batches):
            lines = [t.split("\n") for t in x["transcript"]]
            yield x[["conv", "segment"]].assign(speaker=[last_marked(y) for y in lines], blank=[int(not y[-1].strip()) for y in lines])

    before = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.mapInPandas(tails, "conv string, segment long, speaker string, blank int")
    handed = handed.select("conv", "segment", F.coalesce(F.last("speaker", True).over(before), F.lit(FIRST[0])).alias("speaker"), F.coalesce(F.last("blank").over(before), F.lit(FIRST[1])).alias("blank"))
    ready = done.keep(parts.join(handed.hint("merge"), ["conv", "segment"]), "ready")

    def seen_of(row) -> tuple[list[str], np.ndarray, list[int], bool]:
        lines = row.transcript.split("\n")
        return lines, *observed(lines, row.speaker, row.blank), row.blank == FIRST[1]

    def reaches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in filter(len, batches):
            rows = (seen_of(r) for r in x.itertuples(index=False))
            yield x[["conv", "segment"]].assign(reach=[reach(model, seen, first).ravel() for _, seen, _, first in rows])

    n = len(STATES)

    def onward(best, row):
        best = np.zeros(n) if best is None else best
        ways = row.reach.reshape(n, n)
        return (best[:, None] + ways).max(axis=0), (row.conv, row.segment, best, row.reach)

    def backward(end, row):
        ways = row.best[:, None] + row.reach.reshape(n, n)
        end = int(ways.max(axis=0).argmax()) if end is None else end
        entry = int(ways[:, end].argmax())
        return entry, (row.conv, row.segment, entry, end)

    forth = streamed(ready.mapInPandas(reaches, "conv string, segment long, reach array<double>"), F.asc("segment"), onward, "conv string, segment long, best array<double>, reach array<double>")
    ends = streamed(forth, F.desc("segment"), backward, "conv string, segment long, entry int, end int")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for row in x.itertuples(index=False):
                lines, seen, cuts, first = seen_of(row)
                role_before = None if first else STATES[row.entry][0]
                for line, cut, state in zip(lines, cuts, between(model, seen, None if first else row.entry, row.end), strict=True):
                    role, begins = STATES[state]
                    if begins or role != role_before:
                        out.append([row.conv, row.segment, 1, ROLES[role], [line[cut:] if begins else line]])
                    elif out and out[-1][:2] == [row.conv, row.segment]:
                        out[-1][4].append(line)
                    else:  # goes on with the last turn of the segment before
                        out.append([row.conv, row.segment, 0, ROLES[role], [line]])
                    role_before = role
            if out:
                yield pd.DataFrame([(c, s, new, r, "\n".join(b)) for c, s, new, r, b in out], columns=["conv", "segment", "opens", "role", "body"])

    # Turns are numbered within a segment by their place, which the order of rows keeps, and then over the segments before.
    rows = ready.join(ends.hint("merge"), ["conv", "segment"])
    cut = rows.mapInPandas(pieces, "conv string, segment long, opens int, role string, body string").withColumn("place", F.monotonically_increasing_id())
    cut = done.keep(cut, "pieces")
    own = cut.groupBy("conv", "segment").agg(F.sum("opens").alias("opened"), F.min("place").alias("low"), F.max("place").alias("high"), F.min_by("opens", "place").alias("opens_first"))
    own = own.select("conv", "segment", "low", "high", "opens_first", F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("ahead"))
    cut = cut.join(own.hint("merge"), ["conv", "segment"]).withColumn("turn", (F.col("ahead") + F.col("place") - F.col("low") + F.col("opens_first") - 1).cast("int"))
    # Only the first and the last piece of a segment can have others beside them.
    edge = F.col("place").isin(F.col("low")) | (F.col("place") == F.col("high"))
    joined = cut.filter(edge).groupBy("conv", "turn", "role").agg(F.sort_array(F.collect_list(F.struct("segment", "place", "body"))).alias("z"))
    joined = joined.select("conv", "turn", "role", F.array_join(F.transform("z", lambda z: z["body"]), "\n").alias("body"))

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in portions(batches, "body"):
            content = [b.strip() for b in x["body"]]
            yield x[["conv", "turn", "role"]].assign(content=content, formatted=[rendered([t]) for t in zip(x["role"], content, strict=True)])

    long = cut.filter(~edge).select("conv", "turn", "role", "body").unionByName(joined)
    return short.unionByName(long.mapInPandas(formatted, "conv string, turn int, role string, content string, formatted string"))


#: Ways in which raw transcripts mark user, assistant, system and tool; the last names people.
STYLES = (("User: ", "Assistant: ", "System: ", "Tool: "), ("Human: ", "AI: ", "Instructions: ", "Function: "), ("### User:\n", "### Assistant:\n", "### System:\n", "### Tool:\n"),
          ("[user] ", "[assistant] ", "[system] ", "[tool] "), ("Ada: ", "Ben: ", "System: ", "Tool: "))


def raw_segments(conversations: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as raw transcripts in segments of up to ``most`` turns: conv_id and conv, its name (null; and of each row of a null
    conversation one of its own), segment, transcript, the labelled turns, and first. Markers follow one of STYLES by the conversation.

    Rows are range-sorted by conversation, turn, role and text, and rows alike in all of these by their place, so whatever a third of all rows has in common is split. Which
    of the rows alike comes first changes nothing. The segments are written to the shared folder."""
    own, spark = Taken(conversations), conversations.sparkSession
    conv, turn, role, said = (F.col(own.at(c)) for c in ("conv_id", "turn", "role", "text"))
    name = conv.cast("string")
    style = F.pmod(F.xxhash64(name), F.lit(len(STYLES)))
    mark: Column = F.lit("")
    for k, marks in enumerate(STYLES):
        for r, m in zip(("user", "assistant", "system", "tool"), marks, strict=True):
            mark = F.when((style == k) & (role == r), F.lit(m)).otherwise(mark)
    rows = own.rows.select(name.alias("conv"), turn.alias("turn"), role.cast("string").alias("role"), F.concat(mark, F.coalesce(said.cast("string"), F.lit(""))).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = ["conv", "turn", "role", "hash", "place"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []

        def segment() -> tuple:
            nonlocal k
            k += 1
            conv = held[0][0]
            return conv, (f"n{part + k}" if conv is None else f"c{conv}"), part + k, "\n".join(t for _, _, t in held), [{"role": r, "text": t} for _, r, t in held]

        for x in batches:
            out = []
            for row in x[["conv", "role", "text"]].astype(object).where(x.notna(), None).itertuples(index=False, name=None):
                if held and (row[0] is None or row[0] != held[0][0] or len(held) >= most):
                    out.append(segment())
                    held.clear()
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=["conv_name", "conv", "segment", "transcript", "turns"])
        if held:
            yield pd.DataFrame([segment()], columns=["conv_name", "conv", "segment", "transcript", "turns"])

    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")
    cut = cut.mapInPandas(run, "conv_name string, conv string, segment long, transcript string, turns array<struct<role: string, text: string>>")
    cut = Settled(spark, "transcripts").keep(cut, "segments")
    firsts = cut.groupBy("conv").agg(F.min("segment").alias("least"))
    kind = conversations.schema[own.name(own.at("conv_id"))].dataType
    return cut.join(firsts.hint("merge"), "conv").select(F.col("conv_name").cast(kind).alias("conv_id"), "conv", "segment", "transcript", "turns", (F.col("segment") == F.col("least")).alias("first"))


def op9(spark, sf_dir: str) -> DataFrame:
    """A row for each recovered turn: conv_id, turn, role, n_chars, content_sha256, formatted_sha256. The model is trained on the
    conversations whose crc32 isn't divisible by 5."""
    small_batches(spark)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole = raw_segments(table)
    model = train(whole.filter(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0))
    turns = parse_segments(whole, model)
    conv = F.when(F.col("conv").startswith("c"), F.substr("conv", F.lit(2))).cast(table.schema["conv_id"].dataType)
    return turns.select(conv.alias("conv_id"), "turn", "role", F.char_length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"), F.sha2("formatted", 256).alias("formatted_sha256"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
