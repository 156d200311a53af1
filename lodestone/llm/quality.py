"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics describe the text alone. They are standardised by the training rows' means and deviations and mapped by random Fourier features,
whose inner products approximate a Gaussian kernel; the random numbers come from a fixed seed, so the map is the same everywhere. Each
partition sums its part of the normal equations, partial sums are added 16 by 16 until at most 16 are left, and the driver solves one system of a fixed size. Raw scores
are counted in 512 equal cells with the labels they hold; pool-adjacent-violators over the cells gives a rising curve, and scores are read
off it between the centres of its steps. Labelled rows outside the training rows never enter.

All labelled rows are used; there is no sample bound. What reaches the driver is bounded: at most 16 arrays of FEATURES squared numbers, and of 512 cells.

Defined cases: a null or empty text has statistics of its own (all zero) and is scored like any other; labels of a null id or a null label are
left out; several labels of one id count by their mean; a null id is never held out; with no training rows every score is 0.5, with one class
only it is that class; other columns pass through and input columns named like an output column, in any letters, are replaced; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled, Taken, portions, small_batches, text_of

FEATURES, RIDGE, SEED, CELLS, THRESHOLD = 256, 1e-3, 20, 512, 0.3
STATS = 24


@cache
def byte_kinds() -> np.ndarray:
    """Indicator matrix (256, kinds) of the kinds of bytes that are counted."""
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:?", "!", "'\"()", "#$%&*@^~", "|", "<>{}[]\\/=+_`", "-"]
    out = np.zeros((256, len(kinds) + 1))
    for k, chars in enumerate(kinds):
        out[[ord(c) for c in chars], k] = 1
    out[128:, -1] = 1
    return out


def statistics(text: str) -> np.ndarray:
    """STATS numbers that describe a text; all zero for an empty one."""
    out = np.zeros(STATS)
    words = text.split()
    if not words:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(raw, minlength=256) @ byte_kinds() / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, len(words))
    n, forms = len(words), set(words)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(w[-1] in ".?!" for w in words)
    marked = sum(not (w[-1].isalnum() or w[-1] in ".,;:?!)\"'") for w in words)
    out[:13] = share
    out[13:] = [
        np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        len(forms) / n**0.8, max(seen.values()) / n, same / n, ends / n - marked / n,
    ]
    return out


@cache
def fourier(features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases; the kernel's width is the root of the number of statistics, about the distance of standardised rows."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((STATS, features)) / np.sqrt(STATS), rng.uniform(0, 2 * np.pi, features)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    heights: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        d, phase = fourier(FEATURES, SEED)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ d + phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.round(np.clip(np.interp(self.raw(stats), self.centres, self.heights), 0, 1), 9)


def rising(total: np.ndarray, ones: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: centres and heights of the steps of the rising curve nearest to ones / total."""
    steps: list[list[float]] = []
    for n, y, x in zip(total, ones, at, strict=True):
        if n <= 0:
            continue
        steps.append([n, y, x * n])
        while len(steps) > 1 and steps[-2][1] / steps[-2][0] >= steps[-1][1] / steps[-1][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    return np.array([x / n for n, _, x in steps]), np.array([y / n for n, y, _ in steps])


#: Partial sums that one task adds, and that the driver takes at most.
FAN = 16


def added_up(parts: DataFrame, count: int) -> np.ndarray | None:
    """Sum of the arrays in column v over all rows, one from each of at most ``count`` partitions. Partial sums are added in executors, FAN by FAN, until the driver takes FAN
    arrays at most; so no task adds a number of arrays that grows with the partitions."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for x in batches:
            for v in x["v"]:
                if out is None:
                    out = v.copy()
                else:
                    out += v
        if out is not None:
            yield pd.DataFrame({"v": [out]})

    while count > FAN:
        count = -(-count // FAN)
        parts = parts.repartition(count, F.spark_partition_id()).mapInPandas(total, "v array<double>")
    rows = parts.collect()
    return sum((np.array(r.v) for r in rows[1:]), np.array(rows[0].v)) if rows else None


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with stats array<double>."""
    own = Taken(docs)
    names = own.stay(("stats",), (text,))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in portions(batches, "body"):
            yield x[names].assign(stats=[statistics(t) for t in x["body"]])

    return own.mapped(run, names, "stats array<double>", body=text_of(own.at(text)))


def fit(rows: DataFrame) -> Model:
    """rows: stats array<double> and label double (0 to 1), training rows only."""

    def stack(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.vstack(x["stats"].to_list()), x["label"].to_numpy(float)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for x in batches:
            if len(x):
                s, y = stack(x)
                own = np.r_[len(s), y.sum(), s.sum(0), (s * s).sum(0)]
                out = own if out is None else out + own
        if out is not None:
            yield pd.DataFrame({"v": [out]})

    count = rows.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    sums = added_up(rows.mapInPandas(moments, "v array<double>"), count)
    flat = np.zeros(STATS)
    if sums is None:
        return Model(flat, flat + 1, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    n, mean = sums[0], sums[2 : 2 + STATS] / sums[0]
    scale = np.sqrt(np.maximum(sums[2 + STATS :] / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    start = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for x in batches:
            if len(x):
                s, y = stack(x)
                z = np.hstack([start.features(s), y[:, None]])
                if out is None:
                    out = z.T @ z
                else:
                    out += z.T @ z
        if out is not None:
            yield pd.DataFrame({"v": [out.ravel()]})

    size = FEATURES + 2
    both = added_up(rows.mapInPandas(normal, "v array<double>"), count).reshape(size, size)
    left = both[:-1, :-1] + RIDGE * n * np.diag(np.r_[np.ones(FEATURES) / FEATURES, 0])
    model = Model(mean, scale, np.linalg.solve(left + 1e-9 * np.eye(FEATURES + 1), both[:-1, -1]), np.zeros(1), np.zeros(1))
    low, high = -0.5, 1.5

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, CELLS))
        for x in batches:
            if len(x):
                s, y = stack(x)
                k = np.clip(((model.raw(s) - low) / (high - low) * CELLS).astype(int), 0, CELLS - 1)
                total += np.stack([np.bincount(k, minlength=CELLS), np.bincount(k, weights=y, minlength=CELLS)])
        yield pd.DataFrame({"v": [total.ravel()]})

    total, ones = added_up(rows.mapInPandas(cells, "v array<double>"), count).reshape(2, CELLS)
    centres, heights = rising(total, ones, low + (np.arange(CELLS) + 0.5) * (high - low) / CELLS)
    return Model(mean, scale, model.weights, centres, heights)


def train_on(described: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Model from documents with statistics (doc_id, stats), those that are labelled and whose crc32 of the id isn't divisible by 5."""
    told = Taken(labels)
    i, y = F.col(told.at(doc_id)), F.col(told.at(label))
    known = told.rows.select(i.alias("id"), y.cast("double").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id")).groupBy("id").agg(F.avg("y").alias("label"))
    done = Settled(described.sparkSession, "quality")
    try:
        # Rows of statistics meet the labels, not texts; each pass of the fit reads this table.
        return fit(done.keep(described.select(F.col("doc_id").alias("id"), "stats").join(known.hint("merge"), "id").select("stats", "label"), "rows"))
    finally:
        done.close()


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Model from the labelled documents whose crc32 of the id isn't divisible by 5."""
    own = Taken(docs)
    rows = own.rows.select(F.col(own.at(doc_id)).alias("doc_id"), F.col(own.at(text)).alias("text"))
    return train_on(with_statistics(rows.filter(F.col("doc_id").isNotNull() & ~held_out())), labels, doc_id, label)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score double and predicted int."""
    own = Taken(docs)
    names = own.stay(("score", "predicted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in portions(batches, "body"):
            s = model.score(np.vstack([statistics(t) for t in x["body"]]))
            yield x[names].assign(score=s, predicted=(s >= threshold).astype("int32"))

    return own.mapped(run, names, "score double, predicted int", body=text_of(own.at(text)))


def score_described(described: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """As ``score``, of documents with statistics (stats), which are left out."""
    own = Taken(described)
    names = own.stay(("score", "predicted"), ("stats",))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                s = model.score(np.vstack(x["given"].to_list()))
                yield x[names].assign(score=s, predicted=(s >= threshold).astype("int32"))

    return own.mapped(run, names, "score double, predicted int", given=F.col(own.at("stats")))


def op4(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Statistics are computed once and written; training and scoring read them."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    described = Settled(spark, "described").keep(with_statistics(docs), "stats")
    model = train_on(described, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_described(described.select("doc_id", held_out().alias("held_out"), "stats"), model).select("doc_id", "held_out", "score", "predicted")
