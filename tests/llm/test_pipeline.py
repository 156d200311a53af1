"""Each stage on what the one before kept, against brute-force versions."""

from collections import Counter

import pytest

import corpus_pipeline
from lodestone.llm import common, mixing, pieces, quality

from .test_exact_dedup import brute as exact_brute
from .test_near_dedup import classes

@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    done, docs = common.Settled(spark, "test"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(done.keep(f(spark, out[-1], sf_dir), name))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    assert all(x.columns == stages[0].columns for x in stages[:5])


def test_quality(spark, sf_dir, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in quality.score(stages[0], model).filter("score >= 0.3").collect()}
    assert {r.doc_id for r in stages[1].collect()} == want
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    assert labels.join(stages[1], "doc_id", "left_anti").join(stages[0], "doc_id", "left_semi").count() == 0


def test_exact(stages):
    want = sorted(i for i, _, _, kept in exact_brute([(r.doc_id, r.text) for r in stages[1].collect()]) if kept)
    assert sorted(r.doc_id for r in stages[2].collect()) == want


def test_near(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    first = {}
    for (i, _), c in zip(rows, classes(rows), strict=True):
        first[c] = min(i, first.get(c, i))
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(first.values())


def test_mixing(stages):
    want = Counter({r.doc_id: r.repeats for r in mixing.plan(stages[3]).collect() if r.repeats})
    assert Counter(r.doc_id for r in stages[4].collect()) == want


def test_encoding(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    model = pieces.loaded(pieces.model_path())
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r.n_tokens == len(model.library.encode(texts[r.doc_id], add_eos=True)) for r in rows)


def test_run(spark, sf_dir, stages):
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[5])
