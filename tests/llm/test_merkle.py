import hashlib
import zlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.llm import merkle

from .conftest import DOCS, ODD, clashing

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def digest(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def tree(nodes):
    """Levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, k):
    """For each level, the sibling ('' if none) and whether it stands to the left."""
    for level in levels[:-1]:
        yield (level[k ^ 1] if k ^ 1 < len(level) else ""), bool(k & 1)
        k >>= 1


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, digest(r), r))
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in langs}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            path = [*siblings(trees[k], i), *siblings(top, j)]
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                at = digest((*r[:4], None if r[4] is None else r[4] + 1))
            for other, left in path:
                at = H(other, at) if left else H(at, other)
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], H(*[x for x, _ in path]), at, at == top[-1][0]))
    return sorted(out, key=str)


def result(docs, **how):
    rows = merkle.verify(merkle.manifest(docs, tamper=merkle.tampered, **how))
    return sorted(map(tuple, rows.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_odd_rows(odd, none):
    assert result(odd) == brute(ODD)
    assert result(clashing(odd, "digest", "k", "Place", "other", "n", "proof", "LANG2", "tie", "part")) == brute(ODD)
    assert result(none) == []


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 60)), st.sampled_from([None, "", "a", "é b"]), st.sampled_from([None, "", "en", "de", "Z"]), st.sampled_from([None, "s"]), st.one_of(st.none(), st.integers(0, 9))), max_size=70), st.integers(1, 4))
def test_property(spark, rows, levels):
    """Blocks of 2 to 16 nodes, so several traversals follow each other."""
    assert result(spark.createDataFrame(rows, DOCS), levels=levels) == brute(rows)


def test_keys_of_every_size(spark):
    rows = [(k, str(k), f"l{n}", "s", k) for n in (1, 2, 3, 4, 5, 8, 9, 16, 17, 64, 65) for k in range(n)]
    assert result(spark.createDataFrame(rows, DOCS), levels=2) == brute(rows)


def test_ids_beyond_doubles(spark):
    rows = [(2**53 + k, "t", "en", None, None) for k in range(3)] + [(None, "t", "en", None, None)]
    assert result(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_same_under_other_partitions(spark, table):
    docs = table("documents")
    want = result(docs)
    assert result(docs.repartition(7), levels=3) == want and sum(not r[-1] for r in want) == sum(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in want)


def test_query(spark, sf_dir, table):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table("documents").collect()]
    assert sorted(map(tuple, merkle.op11(spark, sf_dir).collect()), key=str) == brute(rows)
