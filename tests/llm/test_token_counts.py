import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import token_counts as tc

from .conftest import ODD, clashing


@pytest.fixture(scope="module")
def tokenizer():
    return tc.loaded(P.path(tc.RANKS), P.PATTERN)


def brute(tokenizer, text, starts, rule):
    """Counts by walking over the tokens' bytes one at a time."""
    encoding, _ = tokenizer
    owner = [max(k for k, s in enumerate(starts) if s <= c) for c, ch in enumerate(text) for _ in ch.encode()]
    n, crossing, at = [0] * len(starts), [0] * len(starts), 0
    for token in encoding.encode_ordinary(text):
        own = owner[at : at + len(encoding.decode_single_token_bytes(token))]
        at += len(own)
        k = own[0] if rule == "start" else own[-1] if rule == "end" else min(set(own), key=lambda s: (-own.count(s), s))
        n[k] += 1
        crossing[k] += len(set(own)) > 1
    return n, crossing


@settings(max_examples=120, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab \n"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=50), st.lists(st.integers(1, 49), max_size=5), st.sampled_from(tc.RULES))
def test_attribution(tokenizer, text, cuts, rule):
    starts = np.array(sorted({0, *(c for c in cuts if c < len(text))}))
    ids = tokenizer[0].encode_ordinary(text)
    n, crossing, spans = tc.attribute(text, tokenizer[1][ids], starts, rule)
    assert (n.tolist(), crossing.tolist()) == brute(tokenizer, text, starts.tolist(), rule) and n.sum() == len(ids)
    assert spans[0, 0] == 0 and spans[-1, 1] == len(text)


def test_lines():
    assert tc.line_starts("").tolist() == [0] and tc.line_starts("a\nb\n").tolist() == [0, 2] and tc.line_starts("\n\nx").tolist() == [0, 1, 2]


def test_odd_rows(tokenizer, odd, none):
    rows = tc.count(clashing(odd, "section", "n_tokens")).collect()
    totals = sorted(len(tokenizer[0].encode_ordinary(r[1] or "")) for r in ODD)
    assert sorted(r.doc_tokens for r in rows if r.section == 0) == totals and sum(r.n_tokens for r in rows) == sum(totals)
    assert tc.count(none).count() == 0
    with pytest.raises(ValueError):
        tc.count(odd, rule="never")


def test_given_sections(spark, tokenizer):
    text = "Hello wonderful world, internationalization"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("cuts", F.array(F.lit(0), F.lit(8), F.lit(25)))
    for rule in tc.RULES:
        rows = sorted(tc.count(df, sections="cuts", rule=rule).collect(), key=lambda r: r.section)
        assert [r.n_tokens for r in rows] == brute(tokenizer, text, [0, 8, 25], rule)[0] and [(r.start, r.end) for r in rows] == [(0, 8), (8, 25), (25, len(text))]


def test_query(spark, sf_dir, table, tokenizer):
    rows = tc.op8(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in table("documents").collect()}
    total, sections = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        sections[r.doc_id] = sections.get(r.doc_id, 0) + 1
    assert total == {k: len(tokenizer[0].encode_ordinary(t)) for k, t in texts.items()}
    assert sections == {k: len(tc.line_starts(t)) for k, t in texts.items()}


def test_any_section_starts(spark):
    rows = [(1, "alpha beta gamma", []), (2, "alpha beta gamma", [6]), (3, "alpha beta gamma", [11, 0, 6, 6, None, -4, 99]), (4, "", [3]), (5, None, [0])]
    got = tc.count(spark.createDataFrame(rows, "doc_id long, text string, cuts array<int>"), sections="cuts").collect()
    by = {k: [(r.section, r.start, r.end) for r in sorted(got, key=lambda r: r.section) if r.doc_id == k] for k in range(1, 6)}
    assert by == {1: [(0, 0, 16)], 2: [(0, 0, 6), (1, 6, 16)], 3: [(0, 0, 6), (1, 6, 11), (2, 11, 16)], 4: [(0, 0, 0)], 5: [(0, 0, 0)]}
    assert all(sum(r.n_tokens for r in got if r.doc_id == k) == next(r.doc_tokens for r in got if r.doc_id == k) for k in by)
