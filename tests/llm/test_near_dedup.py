from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_dedup as nd

from .conftest import ODD, clashing


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows):
    """Class number of every row, by comparing all pairs."""
    bags, parent = [bag(t) for _, t, *_ in rows], list(range(len(rows)))
    words = [tuple((t or "").lower().split()) for _, t, *_ in rows]

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if words[i] == words[j] or both and both / sum((bags[i] | bags[j]).values()) >= 0.8:
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(rows))]


def check(df, rows):
    """Class sizes and smallest ids are those of the brute force, and one row of each class is kept."""
    by = defaultdict(list)
    for k, c in enumerate(classes(rows)):
        by[c].append(rows[k][0])
    want = sorted((min((i for i in ids if i is not None), default=None), len(ids), i) for ids in by.values() for i in sorted(ids, key=str)) if all(r[0] is not None for r in rows) else None
    got = df.collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(by)
    if want is not None:
        assert sorted((r.class_id, r.class_size, r.doc_id) for r in got) == want
    else:
        assert Counter((r.class_id, r.class_size) for r in got) == Counter((min((i for i in ids if i is not None), default=None), len(ids)) for ids in by.values() for _ in ids)


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"e{rng.integers(1 << 40)}" for w in words)


def test_signature_is_unbiased():
    rng, z = np.random.default_rng(3), []
    for _ in range(120):
        items = rng.integers(0, 1 << 63, rng.integers(3, 150)).astype(np.uint64)
        a = rng.integers(0, 9, len(items))
        b = np.where(rng.random(len(items)) < 0.8, a, rng.integers(0, 9, len(items)))
        if not a.any() or not b.any():
            continue
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        sig = [nd.bag_minhash(items[w > 0], w[w > 0], np.zeros((w > 0).sum(), np.int64), 1) for w in (a, b)]
        z.append(((sig[0] == sig[1]).mean() - true) / max((true * (1 - true) / nd.M) ** 0.5, 0.01))
    assert abs(np.mean(z)) < 0.35 and np.std(z) < 1.4


def test_large_counts_and_short_documents():
    one = np.array([5], np.uint64)
    for w in (1, 2, 3, 1000, 123_457):
        assert np.isfinite(nd.bag_minhash(one, np.array([w]), np.zeros(1, np.int64), 1)).all()
    a, b = (nd.bag_minhash(one, np.array([w]), np.zeros(1, np.int64), 1) for w in (600, 1000))
    assert (a == b).mean() == pytest.approx(0.6, abs=0.1)


def test_planted_group(spark):
    """A large group of edited copies: most are near the original and few near each other; unrelated documents share a passage with them."""
    rng = np.random.default_rng(7)
    base = [f"w{rng.integers(1 << 30)}" for _ in range(220)]
    rows = [(k + 1, edited(rng, base, 0.03)) for k in range(300)] + [(0, " ".join(base))]
    passage = base[:60]
    rows += [(1000 + k, " ".join(passage + [f"u{rng.integers(1 << 40)}" for _ in range(120)])) for k in range(60)]
    rows += [(2000 + k, " ".join(f"v{rng.integers(1 << 40)}" for _ in range(40))) for k in range(60)]
    check(nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_chains(spark):
    """Links between different texts lead through texts that aren't near each other."""
    rng = np.random.default_rng(9)
    words = [f"c{k}" for k in range(150)]
    rows, k = [], 0
    while k < 30:
        rows.append((k, " ".join(words)))
        at = int(rng.integers(5, 140))
        words = [*words[:at], f"n{k}", *words[at + 1 :]]
        k += 1
    check(nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_repeats_weigh(spark):
    line = "a b c d e f g h "
    rows = [(1, line * 10), (2, line * 12), (3, line * 2), (4, line * 100)]
    check(nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_odd_rows(odd, none):
    check(nd.near_classes(odd), ODD)
    assert nd.near_classes(none).count() == 0 and nd.near_dedup(none).count() == 0


def test_one_row_of_each_class_stays(odd):
    out = nd.near_dedup(clashing(odd, "class_id", "kept"))
    assert out.count() == len(set(classes(ODD))) and set(out.columns) == {*odd.columns, "class_id", "kept"}
    assert out.filter(F.col("text").contains("alpha")).select("doc_id").first().doc_id == 1


def test_query(spark, sf_dir, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    check(nd.op2(spark, sf_dir), rows)


def test_recall_against_all_pairs(spark):
    """Every pair of the 10,000 documents of sf0.1 with an overlap of 0.8 or more, found by prefixes of their rarest shingles, is linked."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    bags = {}
    for _, t in docs:
        bags.setdefault(" ".join((t or "").lower().split()), bag(t))
    rare = Counter(s for b in bags.values() for s in b)
    # Repetitions of a shingle are items of their own; two multisets at 0.8 share one of the first n - 0.8 n + 1 in the order of rarity.
    pairs, lists, names = set(), defaultdict(list), list(bags)
    for i, name in enumerate(names):
        items = sorted(((rare[s], s, k) for s, n in bags[name].items() for k in range(n)))
        for item in items[: len(items) - int(np.ceil(0.8 * len(items))) + 1]:
            pairs.update((j, i) for j in lists[item[1:]] if 0.8 * len(items) <= sum(bags[names[j]].values()) <= len(items) / 0.8)
            lists[item[1:]].append(i)
    near = [(a, b) for a, b in pairs if sum((bags[names[a]] & bags[names[b]]).values()) >= 0.8 * sum((bags[names[a]] | bags[names[b]]).values())]
    of = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    first = {}
    for i, t in docs:
        first.setdefault(" ".join((t or "").lower().split()), i)
    assert len(near) > 40 and all(of[first[names[a]]] == of[first[names[b]]] for a, b in near)
    parent = list(range(len(names)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in near:
        parent[root(a)] = root(b)
    assert len({root(k) for k in range(len(names))}) == len(set(of.values()))
