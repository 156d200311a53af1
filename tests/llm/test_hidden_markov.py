import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hidden_markov as hm
from lodestone.llm.common import Settled

from .conftest import DOCS, ODD, clashing


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def unigrams(rows, train):
    """n_tokens, n_known, train_tokens, base_score of each row."""
    counts = Counter(t for r, yes in zip(rows, train, strict=True) if yes for t in tokens(r[1]))
    n = sum(counts.values())
    return [(len(t), sum(counts[x] > 0 for x in t), n, sum(np.log10((counts[x] + 1) / (n + len(counts) + 1)) for x in t)) for t in (tokens(r[1]) for r in rows)], counts


def forward_backward(symbols, start, moves, gives):
    """One text, step by step: log likelihood and the posteriors of states and of moves."""
    n = len(symbols)
    a, b, c = np.zeros((n, len(start))), np.ones((n, len(start))), np.zeros(n)
    for t in range(n):
        a[t] = (start if t == 0 else a[t - 1] @ moves) * gives[symbols[t]]
        c[t] = a[t].sum()
        a[t] /= c[t]
    for t in range(n - 2, -1, -1):
        b[t] = moves @ (gives[symbols[t + 1]] * b[t + 1]) / c[t + 1]
    xi = sum((np.outer(a[t], gives[symbols[t + 1]] * b[t + 1] / c[t + 1]) * moves for t in range(n - 1)), np.zeros_like(moves))
    return np.log(c).sum(), a * b, xi


def learned(spark, rows, words, piece=hm.PIECE, iterations=2, states=3):
    done = Settled(spark, "test")
    docs = spark.createDataFrame([(r[1],) for r in rows], "c0 string")
    v = hm.vocabulary(docs.select(F.coalesce("c0", F.lit("")).alias("b")), "b", done, words)
    coded = done.keep(hm.encoded(docs, F.coalesce("c0", F.lit("")), v.words, ["c0"]), "encoded")
    return v, hm.train_on(coded, v, states, 0), hm.train_on(coded, v, states, iterations, piece=piece)


def brute_model(rows, v, first, iterations, states=3):
    symbols = hm.Symbols(v.words)
    coded = [[0 if t is None else symbols[t.encode()] for t in tokens(r[1])] for r in rows]
    start, moves, gives = first.start, first.moves, first.gives
    for _ in range(iterations):
        s, m, g = np.ones(states), np.ones((states, states)), np.zeros((len(v.n), states))
        for x in coded:
            _, post, xi = forward_backward(x, start, moves, gives)
            s += post[0]
            m += xi
            np.add.at(g, x, post)
        g += hm.PRIOR * (g.sum(0) + 1) / (g.sum(0) + 1).sum()
        start, moves, gives = s / s.sum(), m / m.sum(1, keepdims=True), g / g.sum(0)
    return start, moves, gives


def brute_scores(rows, train, model, v, counts):
    symbols, out = hm.Symbols(v.words), []
    own = {w: counts[w.decode()] for w in v.words}
    rest = {w.encode(): n for w, n in counts.items() if w is not None and w.encode() not in own}
    for r in rows:
        t = tokens(r[1])
        x = [0 if w is None else symbols[w.encode()] for w in t]
        score = forward_backward(x, *model)[0] / np.log(10)
        for w in t[:-1]:
            if w.encode() not in own:
                shape = [k for k in rest if hm.shape_of(k) == hm.shape_of(w.encode())]
                score += np.log10((rest.get(w.encode(), 0) + 1) / (sum(rest[k] for k in shape) + len(shape) + 1))
        out.append(score)
    return out


@pytest.mark.parametrize("words, piece", [(20, 4), (1000, 7)])
def test_training_and_scores_equal_brute_force(spark, words, piece):
    short = [(*r[:1], r[1] and r[1][:900], *r[2:]) for r in ODD]
    train = [r[0] is None or r[0] % 3 != 0 for r in short]
    told = [r for r, yes in zip(short, train, strict=True) if yes]
    v, first, model = learned(spark, told, words, piece)
    want = brute_model(told, v, first, 2)
    for a, b in zip((model.start, model.moves, model.gives), want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)
    base, counts = unigrams(short, train)
    got = hm.scored(spark.createDataFrame(short, DOCS), F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)), states=3, iterations=2, words=words, piece=piece).collect()
    scores = brute_scores(short, train, want, v, counts)
    key = lambda x: (str(x[0]), *x[1:])
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got], key=key)
    assert got == sorted([(r[0], a, b, c, round(d, 6), round(s, 6)) for r, (a, b, c, d), s in zip(short, base, scores, strict=True)], key=key)


def test_long_texts_are_one_sequence():
    """Pieces of any length give what one pass over the whole text gives, also for learning."""
    rng = np.random.default_rng(1)
    start, moves, gives = (hm.scaled(rng.random(shape)) for shape in ((4,), (4, 4), (4, 30)))
    gives = gives.T.copy()
    texts = [rng.integers(0, 30, n) for n in (1, 2, 63, 64, 65, 500, 128, 1)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    logs, posts, xis = zip(*[forward_backward(t, start, moves, gives) for t in texts], strict=True)
    for piece, side in ((1, 3), (5, 2), (64, 4096), (1000, 1)):
        p = hm.Pieces.of(np.concatenate(texts), offsets, piece)
        log, starts, moved, gave = hm.expected(p, start, moves, gives, side)
        np.testing.assert_allclose([x.sum() for x in np.split(log, p.first[1:])], logs)
        np.testing.assert_allclose(moved, sum(xis))
        np.testing.assert_allclose(starts, sum(x[0] for x in posts))
        want = np.zeros_like(gives)
        np.add.at(want, np.concatenate(texts), np.concatenate(posts))
        np.testing.assert_allclose(gave, want)


def test_probabilities_add_up(spark):
    """Over all symbols, each state's choices add up to one; over the words of a shape, with one unknown, so do theirs."""
    v, _, model = learned(spark, ODD, 15)
    assert np.allclose(model.gives.sum(0), 1) and np.allclose(model.moves.sum(1), 1) and np.isclose(model.start.sum(), 1)
    rest = {bytes(r.word): r.n for r in v.others().collect()}
    for shape in range(hm.SHAPES):
        own = [n for w, n in rest.items() if hm.shape_of(w) == shape]
        assert sum(own) == v.n[len(v.words) + 1 + shape] and len(own) == v.kinds[shape]
        assert np.isclose(sum((n + 1) / (sum(own) + len(own) + 1) for n in [*own, 0]), 1)


def test_edges(spark, odd, none):
    assert hm.scored(none, F.lit(True)).count() == 0
    got = hm.scored(odd, F.lit(False), states=2, iterations=1).collect()  # nothing to learn from
    assert len(got) == len(ODD) and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in got)
    plain = hm.scored(odd, F.lit(True), states=2, iterations=1)
    extra = hm.scored(clashing(odd, "symbols", "Others", "trains", "row", "times", "SCORE", "body"), F.lit(True), states=2, iterations=1)
    key = lambda d: sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in d.collect()), key=str)
    assert key(plain) == key(extra)


def test_query(spark, sf_dir, table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    held = [zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in docs]
    base, _ = unigrams(docs, [not h for h in held])
    got = {r.doc_id: r for r in hm.op12(spark, sf_dir).collect()}
    for r, h, b in zip(docs, held, base, strict=True):
        x = got[r[0]]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (h, *b[:3]) and abs(x.base_score - b[3]) < 1e-6 * b[0] + 1e-9
    # On texts that weren't learned from, the states tell more than counts do.
    assert sum(got[r[0]].score for r, h in zip(docs, held, strict=True) if h) > sum(got[r[0]].base_score for r, h in zip(docs, held, strict=True) if h)
