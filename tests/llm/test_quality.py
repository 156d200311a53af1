import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import quality

from .conftest import clashing

LABEL = "doc_id long, quality int, toxic int"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out(spark):
    ids = [*range(200), None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", quality.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op4(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(rows) > 30 and auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.95
    assert (rows.predicted[rows.quality == 1] == 1).mean() > 0.97 and (rows.predicted == (rows.score >= 0.3)).all()


def test_labels_decide_nothing_else(spark, table):
    """Labels of held-out rows, and all columns but the text, leave the scores alone."""
    docs, labels = table("documents").filter("doc_id < 120"), table("labels")
    one = quality.score(docs, quality.train(docs, labels))
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    two = quality.score(moved, quality.train(moved, other))
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (one, two))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0), (6, 0, 0), (8, 1, 0), (12, 0, 0)], LABEL)
    out = quality.score(clashing(odd, "score", "predicted", "stats"), quality.train(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.stats for r in out} == {"mine"}
    blank = {r.score for r in out if not (r.text or "").strip()}
    assert len(blank) == 1
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score(none, quality.train(none, labels)).count() == 0


@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0, 1)), min_size=1, max_size=30))
def test_rising(cells):
    n, share = np.array([c[0] for c in cells], float), np.array([c[1] for c in cells])
    centres, heights = quality.rising(n, n * share, np.arange(len(cells), dtype=float))
    assert (np.diff(heights) > -1e-12).all() and (np.diff(centres) > 0).all()
    assert heights.min() >= share.min() - 1e-9 and heights.max() <= share.max() + 1e-9


def test_statistics_of_any_text():
    for t in ("", " ", "a", "\n\n", "|||", "é" * 9, "a b" * 50_000, "\ud800"):
        s = quality.statistics(t)
        assert s.shape == (quality.STATS,) and np.isfinite(s).all()


def rising_by_formula(total, ones):
    """The nearest rising curve to the means: at each cell the largest, over starts, of the smallest, over ends, of the means between."""
    n = len(total)
    mean = lambda a, b: ones[a : b + 1].sum() / total[a : b + 1].sum()
    return np.array([max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)])


def test_model_by_hand(spark, sf_dir):
    """Statistics, standardising, features, ridge and calibration of one partition's rows in a few lines of numpy."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    model = quality.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(quality.statistics(t or ""), known[i]) for i, t in docs if i in known and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([s for s, _ in rows]), np.array([q for _, q in rows], float)
    scale = np.where(x.std(0) > 1e-9, x.std(0), 1)
    d, phase = quality.fourier(quality.FEATURES, quality.SEED)
    z = np.c_[np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - x.mean(0)) / scale, -8, 8) @ d + phase), np.ones(len(x))]
    ridge = np.diag(np.r_[np.full(quality.FEATURES, quality.RIDGE * len(x) / quality.FEATURES), 0]) + 1e-9 * np.eye(quality.FEATURES + 1)
    w = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    assert np.allclose(z @ w, model.raw(x), atol=1e-6)
    cell = np.clip(((z @ w + 0.5) / 2 * quality.CELLS).astype(int), 0, quality.CELLS - 1)
    total, ones = np.bincount(cell, minlength=quality.CELLS), np.bincount(cell, weights=y, minlength=quality.CELLS)
    used = np.flatnonzero(total)
    curve = rising_by_formula(total[used], ones[used])
    centres, heights = quality.rising(total, ones, np.arange(quality.CELLS))
    assert np.allclose(np.unique(curve), np.unique(heights)) and np.all(np.diff(heights) > 0)
    assert np.allclose(model.heights, heights) and len(centres) == len(model.centres)


def test_sums_in_a_tree(spark):
    parts = spark.range(0, 700, 1, 300).selectExpr("array(CAST(id AS DOUBLE), 1D) AS v")
    assert quality.added_up(parts, 300).tolist() == [sum(range(700)), 700] and quality.added_up(parts.limit(0), 300) is None
