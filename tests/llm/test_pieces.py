import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces

from .conftest import ODD, clashing


@pytest.fixture(scope="module")
def model():
    return pieces.loaded(pieces.model_path())


def trie(keys):
    """Units of a double-array trie of these keys (bytes to value), laid out one node after another in blocks of 256."""
    nodes, children = [(b"", 0)], {}
    for key in sorted(keys):
        for k in range(1, len(key) + 1):
            children.setdefault(key[: k - 1], set()).add(key[:k])
    units, place, block = {}, {b"": 0}, 1
    todo = [b""]
    while todo:
        node = todo.pop()
        base = block * 256
        block += 1
        offset = place[node] ^ base
        own = keys.get(node)
        label = node[-1] if node else 0
        units[place[node]] = (offset << 10) | (int(own is not None) << 8) | label
        if own is not None:
            units[base] = own | 1 << 31
        for child in sorted(children.get(node, ())):
            place[child] = base ^ child[-1]
            todo.append(child)
    del nodes
    size = max(units) + 256
    return [units.get(k, 0) for k in range(size)]


def charmap(rules):
    texts, at, keys = b"", 0, {}
    for key, new in rules.items():
        keys[key] = at
        texts += new + b"\0"
        at = len(texts)
    units = trie(keys)
    return struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + texts


def test_longest_prefix():
    m = pieces.CharMap(charmap({b"a": b"1", b"ab": b"22", "é".encode(): b"e", b"abcd": b""}))
    assert m.longest(b"xab", 1) == (2, b"22") and m.longest(b"abc", 0) == (2, b"22") and m.longest(b"abcde", 0) == (4, b"")
    assert m.longest(b"ac", 0) == (1, b"1") and m.longest("é".encode(), 0) == (2, b"e") and m.longest(b"b", 0) is None and m.longest(b"a\0", 0) == (1, b"1")


def test_alignment_of_replacements(model):
    m = object.__new__(pieces.Pieces)
    m.__dict__.update(model.__dict__)
    m.map = pieces.CharMap(charmap({"ﬁ".encode(): b"fi", "　".encode(): b" "}))
    raw = "xﬁ　y".encode()
    data, start, end = m.normalise(raw)
    assert data.decode() == "▁xfi▁y"
    spans = list(zip(start.tolist(), end.tolist(), strict=True))
    assert spans == [(0, 0)] * 3 + [(0, 1), (1, 4), (1, 4)] + [(4, 7)] * 3 + [(7, 8)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tabé▁　€日𐍈"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_spans_are_those_of_the_library(model, text):
    proto = model.library.encode(text, return_type="proto")
    ids = np.array([p.id for p in proto.pieces], np.int64)
    a, b = model.spans(text.encode(), ids)
    raw = text.encode()
    assert ids.tolist() == model.library.encode(text)
    # The library gives all bytes of a character to the last of its byte pieces.
    for p, x, y in zip(proto.pieces, a, b, strict=True):
        if not p.piece.startswith("<0x"):
            assert (x, y) == (p.begin, p.end)
    assert b"".join(raw[x:y] for x, y in zip(a, b, strict=True)) == raw
    assert (np.diff(a) >= 0).all() and (np.diff(b) >= 0).all()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def want(model, text):
    ids = model.library.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(model.library.decode(ids))


def test_texts(model, odd, none):
    rows = pieces.encode(clashing(odd, "n_tokens", "ids_sha256"), keep="digests").collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want(model, r[1]) for r in ODD)
    assert sorted(r.covered_bytes for r in rows) == sorted(len((r[1] or "").encode()) for r in ODD)
    full = pieces.encode(odd.filter("doc_id = 11")).first()
    assert full.ids[-1] == 2 and full.starts[-1] == full.ends[-1] == len(full.text.encode()) and full.decoded == model.library.decode(list(full.ids))
    assert pieces.encode(none).count() == 0


def test_query(spark, sf_dir, table, model):
    texts = {r.doc_id: r.text for r in table("documents").collect()}
    rows = pieces.op6(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(model, texts[r.doc_id]) for r in rows)
