"""Language-model scoring by a hidden Markov model over words.

Words are runs of other characters than ``[\\x20\\x09-\\x0D]``, with A-Z in lower case; a text is its words and an end. Each position has one of ``STATES`` latent states; a state gives
the next state and a symbol. The ``WORDS`` most frequent training words and the end are symbols of their own; every other word is of one of 32 shapes (length, kinds of characters),
and a shape is a symbol that is followed by the choice of a word of this shape, (c + 1) / (N + V + 1) by its training count, N and V being those of the shape's other words. So the score is a
probability over all texts, known words or not, and only as many words as are bounded here are handed to the tasks; the counts of all others join by word. None of these others can
be a hot key, as each is rarer than ``WORDS`` words.

Training is Baum-Welch over whole training texts: in each iteration tasks add up the expected counts of their texts, Spark sums them by symbol, and the driver divides (tables of bounded
size). It begins with states from a spectral clustering of the bigrams of the most frequent words, so a few iterations are enough.

The recursions are exact for texts of any length. A text is cut into pieces of 64 words that are worked on side by side: a piece is first reduced to the 8 x 8 matrix that leads from the
states before it to those at its end; these matrices carry the forward vector on and the backward vector back over the pieces of a text; then the scaled recursions
run in all pieces at once, each between its two vectors. The sum of the scales' logarithms is the likelihood.

Defined cases: a null text counts as empty, and has an end only; rows with a null id are training rows; repeated rows count as often as they occur; without any training text all words are
unknown and states are uniform; other columns pass through, and input columns named like an output column, in any letters, are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Settled, Taken, small_batches, text_of

STATES, WORDS, SHAPES = 8, 1 << 16, 32
#: Words whose bigrams the first states come from.
FIRST = 256
ITERATIONS = 3
#: Words of a piece, and pieces worked on side by side.
PIECE, SIDE = 64, 4096
#: Occurrences that every symbol is given in advance, shared by the states as the words are, and moves that each pair of states is given.
PRIOR, PRIOR_STATES = 2.0, 1.0
#: Words of the texts that a task holds at a time; a longer text is held alone.
HELD = 1_000_000
NEW = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the number of its text for each."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(pa.large_string()))
    flat, text = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    some = pc.not_equal(flat, "")  # before and after white space at the ends
    return flat.filter(some).cast(pa.large_binary()), text[some.to_numpy(zero_copy_only=False)]


def shape_of(word: bytes) -> int:
    kind = 0 if word.isalpha() else 2 if not word.isascii() else 1 if word.translate(None, b"0123456789") != word else 3
    return min((len(word) - 1) // 2, 7) * 4 + kind


class Symbols(dict):
    """Symbol of every word: 0 is the end, 1 to n the frequent words, and the shapes follow."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(1, len(words) + 1), strict=True))
        self.shapes = len(words) + 1

    def __missing__(self, word: bytes) -> int:
        return self.shapes + shape_of(word)


@dataclass
class Vocabulary:
    """What is known of the training words: counts of all (word, n; null is the end) and, in bounded tables, of the frequent ones and of the shapes of the others."""

    counts: DataFrame
    words: list[bytes]
    n: np.ndarray  # by symbol: of the end, the frequent words, and each shape's other words together
    kinds: np.ndarray  # by shape, of its other words
    tokens: int
    distinct: int

    def others(self) -> DataFrame:
        """Counts of the words that aren't symbols."""
        rows = self.counts.filter("word IS NOT NULL")
        if not self.words:
            return rows
        last = int(self.n[len(self.words)])
        return rows.filter((F.col("n") < last) | (F.col("n") == last) & (F.col("word") > F.lit(bytearray(self.words[-1]))))


@dataclass
class Model:
    vocabulary: Vocabulary
    start: np.ndarray
    moves: np.ndarray
    gives: np.ndarray  # by symbol and state


def counted(docs: DataFrame, text: str, done: Settled) -> DataFrame:
    """word, n over all rows; the null word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], 0, 0

        def told() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held, pa.large_binary()))
            words, n = found.field(0).cast(pa.binary()), found.field(1)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([None], pa.binary()), words]), pa.concat_arrays([pa.array([texts], pa.int64()), n])], names=["word", "n"])

        for x in batches:
            held.append(words_of(x["body"])[0])
            texts += x.num_rows
            size += len(held[-1])
            if size > 4 * HELD:
                yield told()
                held, texts, size = [], 0, 0
        if texts:
            yield told()

    rows = docs.select(text_of(text).alias("body")).mapInArrow(run, "word binary, n long")
    return done.keep(rows.groupBy("word").agg(F.sum("n").alias("n")), "counts")


def vocabulary(docs: DataFrame, text: str, done: Settled, most: int = WORDS) -> Vocabulary:
    counts = counted(docs, text, done)
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter("word IS NULL").first()
    # Bounded: ``most`` words at most.
    top = counts.filter("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(most).toArrow()
    words = top["word"].to_pylist()
    out = Vocabulary(counts, words, np.r_[ends.n if ends else 0, top["n"].to_numpy(), np.zeros(SHAPES)].astype(np.int64), np.zeros(SHAPES, np.int64), tokens, distinct)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kinds = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for x in batches:
            k = np.array([shape_of(w) for w in x["word"].to_pylist()], np.int64)
            n += np.bincount(k, weights=x["n"].to_numpy(), minlength=SHAPES).astype(np.int64)
            kinds += np.bincount(k, minlength=SHAPES)
        yield pa.RecordBatch.from_pydict({"shape": np.arange(SHAPES), "n": n, "kinds": kinds})

    for r in out.others().mapInArrow(shapes, "shape long, n long, kinds long").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        out.n[len(words) + 1 + r["shape"]], out.kinds[r["shape"]] = r["n"], r["kinds"]
    return out


def encoded(rows: DataFrame, body: Column, words: list[bytes], names: list[str]) -> DataFrame:
    """The columns ``names`` with ``symbols`` of the words and the end, and the words that are no symbols (``others``) with their ``times``."""
    rows = rows.select(*names, body.alias("body"))
    schema = T.StructType([*rows.select(*names).schema.fields, *T._parse_datatype_string("symbols array<int>, others array<binary>, times array<int>").fields])
    shared = rows.sparkSession.sparkContext.broadcast(words)  # WORDS of them at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(shared.value)
        for x in batches:
            if not x.num_rows:
                continue
            words, text = words_of(x["body"])
            coded = words.dictionary_encode()
            distinct, code = coded.dictionary, coded.indices.to_numpy()
            of = np.array(list(map(symbols.__getitem__, distinct.to_pylist())), np.int32)
            mine = of[code] if len(code) else np.zeros(0, np.int32)
            n = np.bincount(text, minlength=x.num_rows)
            ends = np.cumsum(n + 1)  # with the end of each text, whose symbol is 0
            flat = np.zeros(ends[-1], np.int32)
            flat[np.arange(len(mine)) + text] = mine
            other = mine >= symbols.shapes
            pair, times = np.unique(text[other].astype(np.int64) * max(len(distinct), 1) + code[other], return_counts=True)
            own = np.searchsorted(pair // max(len(distinct), 1), np.arange(x.num_rows + 1)).astype(np.int32)
            others = distinct.take(pa.array(pair % max(len(distinct), 1))).cast(pa.binary())
            out = [pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), pa.array(flat)), pa.ListArray.from_arrays(own, others), pa.ListArray.from_arrays(own, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*[x[c] for c in names], *out], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


@dataclass
class Pieces:
    """Texts cut into pieces: where each begins and how long it is, whether it begins or ends a text, and its text."""

    symbols: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray  # first piece of each text
    number: np.ndarray  # pieces of each text

    @staticmethod
    def of(symbols: np.ndarray, offsets: np.ndarray, piece: int) -> Pieces:
        size = np.diff(offsets)
        number = -(-size // piece)
        first = np.cumsum(number) - number
        inside = np.arange(number.sum()) - np.repeat(first, number)
        starts = np.repeat(offsets[:-1], number) + inside * piece
        return Pieces(symbols, starts, np.minimum(piece, np.repeat(offsets[1:], number) - starts), first, number)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def side_by_side(p: Pieces, which: np.ndarray, side: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pieces in groups of ``side``, the longest first: their numbers, their symbols by position, and how many have a symbol at each position."""
    which = which[np.argsort(-p.lengths[which], kind="stable")]
    for at in range(0, len(which), side):
        mine = which[at : at + side]
        length = p.lengths[mine]
        steps = np.arange(length[0])
        yield mine, p.symbols[np.minimum(p.starts[mine] + steps[:, None], len(p.symbols) - 1)], np.searchsorted(-length, -steps, "left")


def between(p: Pieces, start: np.ndarray, moves: np.ndarray, gives: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece the forward vector before it (scaled; of a first piece, not used), the backward vector after it (in any scale), and whether it is a first one."""
    s, n = len(start), len(p.starts)
    begins = np.zeros(n, bool)
    begins[p.first[p.number > 0]] = True
    before, after = np.full((n, s), 1 / s), np.ones((n, s))
    rounds = int(p.number.max(initial=0))
    if rounds < 2:
        return before, after, begins
    matrix = np.empty((n, s, s))
    for mine, symbols, active in side_by_side(p, np.flatnonzero(np.repeat(p.number > 1, p.number)), side):
        m = np.broadcast_to(moves, (len(mine), s, s)) * gives[symbols[0]][:, None, :]
        m[begins[mine]] = (start * gives[symbols[0, begins[mine]]])[:, None, :]  # alike from all states
        for t in range(1, len(symbols)):
            k = active[t]
            m[:k] = (m[:k].reshape(-1, s) @ moves).reshape(k, s, s) * gives[symbols[t, :k]][:, None, :]
            if t % 16 == 0:
                m /= m.sum((1, 2), keepdims=True)
        matrix[mine] = m / m.sum((1, 2), keepdims=True)
    for r in range(1, rounds):
        k = p.first[p.number > r] + r
        before[k] = scaled(np.einsum("ni,nij->nj", before[k - 1], matrix[k - 1]))
        k = p.first[p.number > r] + p.number[p.number > r] - r
        after[k - 1] = scaled(np.einsum("nij,nj->ni", matrix[k], after[k]))
    return before, after, begins


def expected(p: Pieces, start: np.ndarray, moves: np.ndarray, gives: np.ndarray, side: int = SIDE, learn: bool = True) -> tuple[np.ndarray, ...]:
    """Natural logarithm of each piece's likelihood given the text before it; if asked, the expected counts of starts, moves and (symbol, state) are those over all pieces."""
    s = len(start)
    before, after, begins = between(p, start, moves, gives, side)
    logs = np.zeros(len(p.starts))
    starts, moved, gave = np.zeros(s), np.zeros((s, s)), np.zeros(gives.shape)
    for mine, symbols, active in side_by_side(p, np.arange(len(p.starts)), side):
        steps, new = len(symbols), begins[mine]
        forward, scale = np.zeros((steps, len(mine), s)), np.ones((steps, len(mine)))
        x = np.where(new[:, None], start, before[mine] @ moves) * gives[symbols[0]]
        for t in range(steps):
            k = active[t]
            if t:
                x = (forward[t - 1, :k] @ moves) * gives[symbols[t, :k]]
            scale[t, :k] = x.sum(1)
            np.divide(x, scale[t, :k, None], out=forward[t, :k])
        logs[mine] = np.log(scale).sum(0)
        if not learn:
            continue
        back = np.array(after[mine])
        last = forward[p.lengths[mine] - 1, np.arange(len(mine))]
        back /= (last * back).sum(1, keepdims=True)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            b = back[:k]
            ahead = gives[symbols[t, :k]] * b / scale[t, :k, None]
            forward[t, :k] *= b  # now the posterior of the states
            if t:
                moved += forward[t - 1, :k].T @ ahead
                back[:k] = ahead @ moves.T
            else:
                moved += np.where(new[:, None], 0, before[mine]).T @ ahead
                starts += forward[0][new].sum(0)
        there = np.arange(len(mine)) < active[:, None]
        flat = symbols[there]
        posterior = forward[there]
        for j in range(s):
            gave[:, j] += np.bincount(flat, weights=posterior[:, j], minlength=len(gives))
    return logs, starts, moved * moves, gave


def texts_of(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their symbols and offsets into these; as many rows of a batch as hold ``most`` symbols together, or a single one."""
    for x in batches:
        offsets = x["symbols"].offsets.to_numpy()
        at = 0
        while at < x.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            part = x.slice(at, stop - at)
            yield part, part["symbols"].flatten().to_numpy(), offsets[at : stop + 1] - offsets[at]
            at = stop


def first_states(rows: DataFrame, v: Vocabulary, states: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, moves and gives before the first iteration, by clustering the most frequent symbols by their neighbours."""
    size = min(first, len(v.words) + 1)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size)
        for _, symbols, offsets in texts_of(batches):
            a, b = symbols[:-1], symbols[1:]
            near = (a < size) & (b < size)
            near[offsets[1:-1] - 1] = False  # from one text to the next
            total += np.bincount(a[near].astype(np.int64) * size + b[near], minlength=size * size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": some, "n": total[some]})

    c = np.zeros(size * size)
    got = rows.select("symbols").mapInArrow(bigrams, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    c[got["pair"].to_numpy()] = got["n"].to_numpy()
    return clustered(c.reshape(size, size), v.n, states)


def clustered(c: np.ndarray, n: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, moves and gives from the bigrams of the first symbols and the counts of all."""
    size = len(c)
    # Neighbours on either side, less what frequency alone would give.
    total = max(c.sum(), 1.0)
    left, right = np.maximum(c.sum(1), 1), np.maximum(c.sum(0), 1)
    excess = c * total / np.outer(left, right)
    excess = np.log1p(np.hstack([excess, excess.T]))
    u, d, _ = np.linalg.svd(excess - excess.mean(0), full_matrices=False)
    points = u[:, :states] * d[:states]
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    weight = np.sqrt(np.maximum(n[:size], 1))
    centres = points[[int(np.argmax(weight))]]
    while len(centres) < states:  # the frequent and far first
        far = ((points[:, None] - centres) ** 2).sum(2).min(1)
        centres = np.vstack([centres, points[int(np.argmax(far * weight))]])
    for _ in range(20):
        label = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([np.average(points[label == k], axis=0, weights=weight[label == k]) if (label == k).any() else centres[k] for k in range(states)])
    gives = np.repeat(((n + 1) / (n + 1).sum())[:, None], states, 1)
    gives[np.arange(size), label] *= 10
    hot = np.eye(states)[label]
    moves = scaled(hot.T @ c @ hot + 0.01 * total / states**2 + 1)
    return np.full(states, 1 / states), moves, gives / gives.sum(0)


def divided(starts: np.ndarray, moves: np.ndarray, gives: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities from expected counts."""
    share = scaled(gives.sum(0) + 1)
    gives = gives + PRIOR * share
    return scaled(starts + PRIOR_STATES), scaled(moves + PRIOR_STATES), gives / gives.sum(0)


def train_on(rows: DataFrame, v: Vocabulary, states: int = STATES, iterations: int = ITERATIONS, first: int = FIRST, piece: int = PIECE) -> Model:
    """Model from the ``symbols`` of training texts, a written table."""
    start, moves, gives = first_states(rows, v, states, first)
    columns = [f"c{j}" for j in range(states)]
    for _ in range(iterations):
        shared = rows.sparkSession.sparkContext.broadcast((start, moves, gives))  # WORDS and SHAPES rows of STATES numbers

        def counts(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, moves, gives = shared.value
            total = np.zeros((1 + states + len(gives), states))  # starts, moves, gives
            for _, symbols, offsets in texts_of(batches):
                _, *got = expected(Pieces.of(symbols, offsets, piece), start, moves, gives)
                for x, at in zip(got, (slice(0, 1), slice(1, 1 + states), slice(1 + states, None)), strict=True):
                    total[at] += x
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, j]) for j in range(states)]], names=["row", *columns])

        got = rows.select("symbols").mapInArrow(counts, ", ".join(["row long", *[f"{c} double" for c in columns]])).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        total = np.zeros((1 + states + len(gives), states))
        total[got["row"].to_numpy()] = np.stack([got[c].to_numpy() for c in columns], 1)
        start, moves, gives = divided(total[0], total[1 : 1 + states], total[1 + states :])
        shared.unpersist()
    return Model(v, start, moves, gives)


def score_on(rows: DataFrame, model: Model, names: list[str], piece: int = PIECE) -> DataFrame:
    """Columns ``names`` and those of NEW. rows: a written table with ``row``, a number of its own for each, and what ``encoded`` gives."""
    v = model.vocabulary
    edge = len(v.words) + 1
    logs = np.log10(v.n + 1.0)
    logs[edge:] = 0  # by the join
    inside = np.zeros(len(logs))
    inside[edge:] = -np.log10(v.n[edge:] + v.kinds + 1.0)
    known = np.r_[v.n[:edge] > 0, np.zeros(SHAPES, bool)].astype(float)
    base = -np.log10(v.tokens + v.distinct + 1.0)
    shared = rows.sparkSession.sparkContext.broadcast((model.start, model.moves, model.gives))
    tokens = v.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, symbols, offsets in texts_of(batches):
            p = Pieces.of(symbols, offsets, piece)
            log, *_ = expected(p, *shared.value, learn=False)
            text = np.repeat(np.arange(x.num_rows), np.diff(offsets))
            by = lambda values: np.bincount(text, weights=values[symbols], minlength=x.num_rows)  # noqa: B023, E731
            hidden = np.bincount(np.repeat(np.arange(x.num_rows), p.number), weights=log, minlength=x.num_rows) / np.log(10)
            n = np.diff(offsets).astype(np.int64)
            new = [n, by(known).astype(np.int64), np.full(len(n), tokens, np.int64), by(logs) + base * n, hidden + by(inside)]
            yield pa.RecordBatch.from_arrays([x["row"], *[x[c] for c in names], *map(pa.array, new)], names=["row", *names, *NEW])

    fields = [rows.schema["row"], *[rows.schema[c] for c in names], *T._parse_datatype_string(", ".join(f"{k} {t}" for k, t in NEW.items())).fields]
    out = rows.select("row", *names, "symbols").mapInArrow(run, T.StructType(fields))
    rest = rows.select("row", F.explode(F.arrays_zip("others", "times")).alias("x")).select("row", F.col("x.others").alias("word"), "x.times").join(v.others().hint("merge"), "word")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("lift"), F.sum("times").alias("seen"))
    lift = F.coalesce("lift", F.lit(0.0))
    return out.join(rest.hint("merge"), "row", "left").select(
        *names, "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), "train_tokens", (F.col("base_score") + lift).alias("base_score"), (F.col("score") + lift).alias("score")
    )


def scored(docs: DataFrame, training: Column, text: str = "text", states: int = STATES, iterations: int = ITERATIONS, words: int = WORDS, first: int = FIRST, piece: int = PIECE) -> DataFrame:
    """``docs`` with the columns of NEW, by a model of those rows for which ``training``, a condition on the columns of ``docs``, holds: the words, those of them known, the training
    tokens, and the logarithms (base 10) of the text's probability by add-one unigrams and by the model."""
    own = Taken(docs)
    names = own.stay(list(NEW))
    rows = docs.withColumn(_TRAINS, F.coalesce(training, F.lit(False))).toDF(*own.rows.columns, "trains")
    body, done = text_of(own.at(text)), Settled(docs.sparkSession, "hidden")
    v = vocabulary(rows.filter("trains").select(body.alias("body")), "body", done, words)
    rows = done.keep(encoded(rows, body, v.words, [*names, "trains"]).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = train_on(rows.filter("trains"), v, states, iterations, first, piece)
    return own.back(score_on(rows, model, names, piece), names, list(NEW))


_TRAINS = "row of the training set"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op12(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return scored(docs, ~F.col("held_out")).select("doc_id", "held_out", *NEW)
