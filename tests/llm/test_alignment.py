import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.llm import alignment

from .conftest import DOCS, ODD, clashing

ODD_TEXTS = [
    "a ▁ b", "x▁y z", " leading", "trailing ", "two  spaces   three", "tab\there and\nlines\r\n end", "it's we'll I'M 's", "<|endoftext|> is text <s> </s> <unk> <0x41>", "é́ 日本語 😀 𐍈", " nbsp x  em y", "\x1c\x1d a \x1f b\x85c", "ﬁ ＡＢＣ ½",
    "\0 nul \0", "a", " ", "   ", "\n", "1234567 89,000.5 -- ==>", "word " * 300, "İstanbul ẞ ǆ", "x" * 3000, "def f(x):\n        return x  # doc\n", "!a b! ~ c",
]


def ids(texts):
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = alignment.bytes_of_characters()
    for t in texts:
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        xs = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        yield (x, xs, y, ys) if t and b"".join(xs) == b"".join(ys) == b" " + t.encode() else ([], [], [], [])


def brute(rows):
    """Every pair of tokens is compared."""
    total, docs = Counter(), []
    for x, xs, y, ys in ids([r[1] or "" for r in rows]):
        xe, ye = np.cumsum([len(t) for t in xs]), np.cumsum([len(t) for t in ys])
        links = [(i, j) for i, e, t in zip(x, xe, xs, strict=True) for j, f, u in zip(y, ye, ys, strict=True) if e - len(t) < f and f - len(u) < e] if len(xs) * len(ys) < 4e6 else None
        assert links is not None
        ends = sorted({*xe.tolist()} & {*ye.tolist()})
        groups, low = [], 0
        for e in ends:
            groups.append((",".join(str(i) for i, k in zip(x, xe, strict=True) if low < k <= e), ",".join(str(i) for i, k in zip(y, ye, strict=True) if low < k <= e)))
            low = e
        total.update(links)
        docs.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if x else ""))
    best = defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    return sorted([(r[0], a, b, g, len(links), sum(total[p] == best[p[1]] for p in links), sum(total[p] for p in links), sha) for r, (a, b, g, links, sha) in zip(rows, docs, strict=True)], key=str)


def result(docs, **how):
    return sorted(map(tuple, alignment.align(docs, **how).select("doc_id", *alignment.OUT).collect()), key=str)


@pytest.fixture(scope="module")
def small():
    rows = [(*r[:1], r[1] and r[1][:4000], *r[2:]) for r in ODD] + [(100 + k, t, "en", "s", len(t)) for k, t in enumerate(ODD_TEXTS)]
    return rows, brute(rows)


def test_odd_rows(spark, small, none):
    rows, want = small
    docs = spark.createDataFrame(rows, DOCS)
    assert result(docs) == want
    # Portions of a few texts, and a head of a few pairs: all other counts come by the join.
    assert result(docs, portion=100, head=5) == want
    assert result(clashing(docs, "N_a", "pairs", "row", "times", "rest", "body", "groups")) == want
    assert result(none) == []


def test_whole_texts_and_other_library(spark, small):
    """The slower library for A, and pieces that would span words: texts stay whole."""
    rows, want = small
    docs = spark.createDataFrame(rows, DOCS)
    assert result(docs, a_path=public_tokenizers.path("byte_bpe_50k.json")) == want
    both = alignment.loaded(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), None, None)
    texts = [r[1] for r in rows]
    cut = alignment.Aligner(both).align(texts)
    try:
        both.cuts = False
        whole = alignment.Aligner(both).align(texts)
    finally:
        both.cuts = True
    assert cut[:2] == whole[:2] and all((a == b).all() for k in (2, 3) for a, b in zip(cut[k], whole[k], strict=True))


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n'▁.,<>|sé日  "), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=8))
def test_stretches_encode_alike(texts):
    """Tokens of stretches, joined, are those of whole texts by both libraries."""
    both = alignment.loaded(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    aligner = alignment.Aligner(both, keep=3)
    aligner.align(texts[:2])  # some stretches are known, or were dropped again
    sums, groups, _, _ = aligner.align(texts)
    for k, (x, _, y, _) in enumerate(ids(texts)):
        told = [g.split("|") for g in groups[k].split(";")] if groups[k] else []
        assert [int(i) for g in told for i in g[0].split(",")] == x and [int(i) for g in told for i in g[1].split(",")] == y and (sums["n_a"][k], sums["n_b"][k], sums["n_groups"][k]) == (len(x), len(y), len(told))


def test_groups_are_given(spark):
    rows = alignment.align(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), groups=True).collect()
    assert rows[0].groups.count(";") == rows[0].n_groups - 1 and rows[0].groups_sha256 == hashlib.sha256(rows[0].groups.encode()).hexdigest()


def test_query(spark, sf_dir, table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    short = [r for r in docs if len(r[1] or "") < 2500]
    assert result(spark.createDataFrame(short, "doc_id long, text string")) == brute(short)
    got = {r.doc_id: r for r in alignment.op13(spark, sf_dir).collect()}
    assert sorted(got) == sorted(d for d, _ in docs)
    for d, (x, _, y, _) in zip(docs, ids([t or "" for _, t in docs]), strict=True):
        assert (got[d[0]].n_a, got[d[0]].n_b) == (len(x), len(y))
