"""Media columns: PNG images in binary columns, written and read by our own codec, and low-frequency cosine-transform hashes of them.

The codec covers 8-bit greyscale, RGB, RGBA and grey-alpha images without interlacing. A file is a chain of length-tagged chunks; each has a CRC-32
over its type and data, which the reader tests, as it tests the signature, the header, the Adler-32 inside the zlib stream and the number of
samples. All five row filters are undone; runs of None, Sub and Up rows as whole arrays, Average and Paeth rows pixel by pixel. The writer
takes for each row the filter of None, Sub and Up with the least sum of absolute residues.

The hash: pooled to 32 x 32 means, transformed by a cosine basis, the 8 x 8 lowest frequencies compared with their median (without the
constant term): 64 bits, as 16 hex digits.

Defined cases: null text counts as empty and becomes one row of 64 zeros; a null or damaged image decodes to null columns and an error message,
not a failure of the job; an image is inflated to the size that its header tells and no further; other columns pass through, and input columns named like an output column,
in any letters, are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, portions, small_batches, text_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 64
#: Bytes of an image's samples beyond which it isn't read: what a binary column can hold.
LARGEST = 1 << 31


class BadImage(ValueError):
    """The bytes aren't an image that the codec reads."""


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(pixels: np.ndarray, level: int = 3) -> bytes:
    """uint8 array (height, width) or (height, width, channels) as PNG."""
    h, w = pixels.shape[:2]
    n = 1 if pixels.ndim == 2 else pixels.shape[2]
    rows = np.ascontiguousarray(pixels, dtype=np.uint8).reshape(h, w * n)
    tried = np.zeros((3, h, w * n), np.uint8)
    tried[0] = rows
    tried[1, :, :n], tried[1, :, n:] = rows[:, :n], rows[:, n:] - rows[:, :-n]
    tried[2, 0], tried[2, 1:] = rows[0], rows[1:] - rows[:-1]
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((h, 1 + w * n), np.uint8)
    lines[:, 0], lines[:, 1:] = best, tried[best, np.arange(h)]
    kind = {v: k for k, v in CHANNELS.items()}[n]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at = 8
    while at < len(png):
        if len(png) - at < 12:
            raise BadImage("cut short inside a chunk")
        size, kind = struct.unpack_from(">I4s", png, at)
        if at + 12 + size > len(png):
            raise BadImage(f"cut short inside {kind!r}")
        data = png[at + 8 : at + 8 + size]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise BadImage(f"checksum of {kind!r} is wrong")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise BadImage("no IEND")


def unfilter(lines: np.ndarray, n: int) -> np.ndarray:
    """Samples (height, width x n) from filtered lines, whose first byte names the filter."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise BadImage("unknown row filter")
    h = len(kinds)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if h else np.array([], int)
    for a, b in zip(starts, [*starts[1:], h], strict=True):
        kind = kinds[a]
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b].reshape(b - a, -1, n), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(a, b):
                row = out[y].astype(int).tolist()
                up = out[y - 1].astype(int).tolist() if y else [0] * len(row)
                for x in range(len(row)):
                    left, above, corner = (row[x - n], up[x], up[x - n]) if x >= n else (0, up[x], 0)
                    if kind == 3:
                        guess = (left + above) // 2
                    else:
                        guess = min((left, above, corner), key=lambda v, p=left + above - corner: abs(p - v))
                    row[x] = (row[x] + guess) & 255
                out[y] = row
    return out


def decode(png: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG that passes every test."""
    head, body = None, []
    for kind, data in chunks(png):
        if kind == b"IHDR":
            w, h, depth, colour, packing, filtering, lace = struct.unpack(">IIBBBBB", data)
            if depth != 8 or colour not in CHANNELS or packing or filtering or lace or not w or not h:
                raise BadImage("not an 8-bit image without palette and interlacing")
            head = (h, w, CHANNELS[colour])
        elif kind == b"IDAT":
            body.append(data)
        elif not kind[0] & 32 and kind not in (b"IEND", b"PLTE"):
            raise BadImage(f"unknown critical chunk {kind!r}")
    if head is None:
        raise BadImage("no header")
    h, w, n = head
    try:
        # A byte more than the header tells, so a small file can't fill the memory.
        stream = zlib.decompressobj()
        size = h * (1 + w * n)
        if size >= LARGEST:
            raise BadImage("more samples than the codec reads")
        raw = stream.decompress(b"".join(body), size + 1)
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(raw) == size and not stream.eof:
        # What is left may be the checksum alone.
        try:
            raw += stream.decompress(stream.unconsumed_tail, 1)
        except zlib.error as e:
            raise BadImage(str(e)) from e
        if not stream.eof:
            raise BadImage("cut short or too many samples")
    if len(raw) != size:
        raise BadImage("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(h, 1 + w * n), n).reshape(h, w, n)


@cache
def basis(low: int, n: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(low), 2 * np.arange(n) + 1) / (2 * n))


def pooled(grey: np.ndarray, n: int) -> np.ndarray:
    """Means over an n x n grid; a side shorter than n is repeated."""
    for axis in (0, 1):
        size = grey.shape[axis]
        if size < n:
            grey = np.take(grey, np.arange(n) * size // n, axis=axis)
        elif size > n:
            cuts = np.arange(n) * size // n
            width = np.diff(np.r_[cuts, size])
            grey = np.add.reduceat(grey, cuts, axis=axis) / (width[:, None] if axis == 0 else width)
    return grey


def cosine_hash(pixels: np.ndarray, grid: int = 32, low: int = 8) -> str:
    low_pass = basis(low, grid) @ pooled(pixels.mean(axis=2) if pixels.shape[2] > 1 else pixels[:, :, 0].astype(float), grid) @ basis(low, grid).T
    values = np.round(low_pass.ravel(), 6)
    return np.packbits(values > np.median(values[1:])).tobytes().hex()


def pack(docs: DataFrame, text: str = "text", into: str = "png") -> DataFrame:
    """``docs`` with the text's UTF-8 bytes, zeros appended up to a positive multiple of 64, as a greyscale PNG 64 pixels wide in column
    ``into``, and ``n_bytes`` before padding. The text column is left out."""
    own = Taken(docs)
    names = own.stay(("n_bytes", into), (text,))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in portions(batches, "body"):
            raw = [t.encode("utf-8", "surrogatepass") for t in x["body"]]
            out = x[names].copy()
            out["n_bytes"] = [len(r) for r in raw]
            out[into] = [encode(np.frombuffer(r + bytes((-len(r)) % WIDTH or WIDTH * (not r)), np.uint8).reshape(-1, WIDTH)) for r in raw]
            yield out

    return own.mapped(run, names, f"n_bytes long, `{into}` binary", body=text_of(own.at(text)))


READ = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "error": "string"}


def unpack(images: DataFrame, column: str = "png") -> DataFrame:
    """``images`` with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and error, from the stored bytes alone."""
    own = Taken(images)
    names = own.stay(tuple(READ))

    def read(png: bytes | None) -> tuple:
        if png is None:
            return None, None, None, None, None, None, "no image"
        media = len(png), hashlib.sha256(png).hexdigest()
        try:
            pixels = decode(bytes(png))
        except BadImage as e:
            return None, None, None, *media, None, str(e)
        payload = pixels.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *media, cosine_hash(pixels), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [read(p) for p in x["image"]]
            yield pd.concat([x[names], pd.DataFrame({c: pd.Series([r[i] for r in found], index=x.index, dtype=object) for i, c in enumerate(READ)})], axis=1)

    return own.mapped(run, names, ", ".join(f"{k} {v}" for k, v in READ.items()), image=F.col(own.at(column)))


def op5(spark, sf_dir: str) -> DataFrame:
    """One row per document: its text stored as PNG, and what is read back from the stored bytes."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return unpack(pack(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
