import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import media

from .conftest import ODD, clashing


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.integers(0, 1 << 30))
def test_round_trip(h, w, n, seed):
    p = np.random.default_rng(seed).integers(0, 256, (h, w, n)).astype(np.uint8)
    assert (media.decode(media.encode(p if n > 1 else p[:, :, 0])) == p).all()


def filtered(p, kinds, n):
    """Lines of samples by given filters, one sample at a time."""
    out = []
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(p.shape[1]):
            a = int(p[y, x - n]) if x >= n else 0
            b = int(p[y - 1, x]) if y else 0
            c = int(p[y - 1, x - n]) if y and x >= n else 0
            e = a + b - c
            paeth = a if abs(e - a) <= abs(e - b) and abs(e - a) <= abs(e - c) else b if abs(e - b) <= abs(e - c) else c
            line.append((int(p[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out.append(line)
    return np.array(out, np.uint8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.sampled_from([1, 3]), st.integers(0, 1 << 30))
def test_all_filters(kinds, n, seed):
    p = np.random.default_rng(seed).integers(0, 256, (len(kinds), 5 * n)).astype(np.uint8)
    assert (media.unfilter(filtered(p, kinds, n), n) == p).all()


def test_damage_is_found():
    png = media.encode(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for k in range(len(png)):
        with pytest.raises(media.BadImage):
            media.decode(png[:k] + bytes([png[k] ^ 1]) + png[k + 1 :])
    for k in (0, 7, 8, 20, len(png) - 1):
        with pytest.raises(media.BadImage):
            media.decode(png[:k])
    head = media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0))
    with pytest.raises(media.BadImage):
        media.decode(head + media.chunk(b"IDAT", zlib.compress(b"\0\1")) + media.chunk(b"IEND", b""))


def test_hash():
    waves = np.random.default_rng(4).normal(0, 1, (8, 8))
    soft = media.basis(8, 64).T @ waves @ media.basis(8, 64)
    soft = (127 + 100 * soft / np.abs(soft).max()).astype(np.uint8)
    bits = lambda h: bin(int(h, 16)).count("1")
    same = media.cosine_hash(soft[:, :, None])
    noisy = np.clip(soft.astype(int) + np.random.default_rng(1).integers(-4, 5, soft.shape), 0, 255).astype(np.uint8)
    assert bits(hex(int(same, 16) ^ int(media.cosine_hash(noisy[:, :, None]), 16))) <= 6
    assert bits(hex(int(same, 16) ^ int(media.cosine_hash(np.random.default_rng(2).integers(0, 256, (64, 64, 1)).astype(np.uint8)), 16))) > 12


def want(text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_texts(odd, none):
    out = media.unpack(media.pack(clashing(odd, "png", "feature")))
    rows = out.collect()
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want(r[1]) for r in ODD)
    assert all(r.media_bytes == len(r.png) and r.media_sha256 == hashlib.sha256(r.png).hexdigest() and r.error is None for r in rows)
    assert len({(r.payload_sha256, r.feature, r.media_sha256) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert media.unpack(media.pack(none)).count() == 0


def test_bad_columns(spark):
    rows = media.unpack(spark.createDataFrame([(1, None), (2, bytearray(b"no image"))], "k int, png binary")).orderBy("k").collect()
    assert rows[0].error == "no image" and rows[1].error and rows[1].media_bytes == 8 and rows[1].payload_sha256 is None


def test_query(spark, sf_dir, table):
    texts = {r.doc_id: r.text for r in table("documents").collect()}
    rows = media.op5(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want(texts[r.doc_id]) for r in rows)


def test_no_more_is_inflated_than_the_header_tells():
    head = media.chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 2, 8, 0, 0, 0, 0))
    for body in (zlib.compress(bytes(50_000_000)), zlib.compress(bytes(130))[:-2], zlib.compress(bytes(129)), zlib.compress(bytes(131))):
        with pytest.raises(media.BadImage):
            media.decode(media.SIGNATURE + head + media.chunk(b"IDAT", body) + media.chunk(b"IEND", b""))
    assert media.decode(media.SIGNATURE + head + media.chunk(b"IDAT", zlib.compress(bytes(130))) + media.chunk(b"IEND", b"")).shape == (2, 64, 1)
