"""SentencePiece encoding and decoding with offsets.

The normaliser is ours: at each place of the text the longest key of the model's compiled character map (a double-array trie followed by the
replacement strings) that matches is replaced, a character that no key matches stays, and every normalised byte records which original bytes
it comes from. Then white space becomes the meta symbol and the dummy prefix is put in front, each with its own source range. The library
merges the pieces; their lengths in the normalised bytes are summed and looked up in the alignment, which projects every piece to a span of
original UTF-8 bytes. Spans never overlap backwards: they start and end in text order, and the pieces of one replaced stretch share its span.

What a model's pieces can't be laid over (their lengths don't add up to the normalised text) has null spans; ids and decoding don't depend on them.

Defined cases: a null text counts as empty (its ids are the end id alone); repeated rows are encoded alike; other columns pass through, and
input columns named like an output column, in any letters, are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import Taken, portions, small_batches, text_of

META = "▁".encode()
MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CharMap:
    """A compiled character map: 4 bytes with the size of the trie, its 32-bit units, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units, self.texts = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this byte, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(0, units[0])
        for i in range(at, len(data)):
            byte = data[i]
            if byte == 0:  # ends a key in the trie, so can't be in one
                break
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1 and node < len(units):
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << (unit >> 6 & 8))


class Pieces:
    """A model with its normaliser and the byte length of every piece."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.rules = proto.normalizer_spec
        self.map = CharMap(self.rules.precompiled_charsmap)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        kinds = type(proto).SentencePiece
        unknown, control = kinds.UNKNOWN, kinds.CONTROL
        # A byte piece stands for one byte; an unknown one for as much as no other piece takes, which is found from the pieces beside it.
        self.lengths = np.array([0 if p.type == control else -1 if p.type == unknown else 1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces])

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each the start and the end of the original bytes it comes from."""
        if self.map.units or self.rules.remove_extra_whitespaces:
            data, start, end = self._mapped(raw)
        else:
            data, start = np.frombuffer(raw, np.uint8), np.arange(len(raw))
            end = start + 1
        space = data == 32
        if self.rules.escape_whitespaces and space.any():
            width = np.where(space, len(META), 1)
            ends = np.cumsum(width)
            out = np.repeat(data, width)
            for k, byte in enumerate(META):
                out[ends[space] - len(META) + k] = byte
            data, start, end = out, np.repeat(start, width), np.repeat(end, width)
        mark = META if self.rules.escape_whitespaces else b" "
        if self.rules.add_dummy_prefix and len(data):
            ahead = np.frombuffer(mark, np.uint8)
            edge = np.full(len(mark), len(raw) if self.suffix else 0)
            parts = [(ahead, edge, edge), (data, start, end)]
            data, start, end = (np.concatenate(x) for x in zip(*(parts[::-1] if self.suffix else parts), strict=True))
        return data.tobytes(), start, end

    def _mapped(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out, start, end, at = bytearray(), [], [], 0
        squash = self.rules.remove_extra_whitespaces
        while at < len(raw):
            if hit := self.map.longest(raw, at):
                taken, new = hit
            else:
                lead = raw[at]
                taken = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at : at + taken]
            if squash and new.startswith(b" "):
                new = new.lstrip(b" ") if not out or out[-1] == 32 else b" " + new.lstrip(b" ")
            out += new
            # A character that stays keeps its own bytes apart; a replaced stretch is the source of all its new bytes.
            if hit is None and len(new) == taken:
                start += range(at, at + taken)
                end += range(at + 1, at + taken + 1)
            else:
                start += [at] * len(new)
                end += [at + taken] * len(new)
            at += taken
        while squash and out and out[-1] == 32:
            out.pop(), start.pop(), end.pop()
        return np.frombuffer(bytes(out), np.uint8), np.array(start, np.int64), np.array(end, np.int64)

    def spans(self, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Original byte span [start, end) of every id; control ids have an empty one. None where the pieces don't add up to the normalised text."""
        data, start, end = self.normalise(raw)
        length = self.lengths[ids]
        if (length < 0).any():
            length = self._unknown(data, ids, length)
        stop = np.cumsum(length)
        if len(stop) and stop[-1] != len(data):
            return None
        first = stop - length
        head, tail = np.append(start, len(raw)), np.append(0, end)
        a = head[first]
        return a, np.maximum(np.where(length > 0, tail[stop], a), a)

    def _unknown(self, data: bytes, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """An unknown piece reaches to the next place where the following known piece stands."""
        length, at = length.copy(), 0
        for k, n in enumerate(length):
            if n < 0:
                ahead = next((self.library.id_to_piece(int(i)).encode() for i, m in zip(ids[k + 1 :], length[k + 1 :], strict=True) if m > 0), None)
                n = length[k] = (data.find(ahead, at + 1) if ahead else len(data)) - at
            at += n
        return length


@cache
def loaded(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, keep: str = "") -> DataFrame:
    """``docs`` with ids array<int> (end id only), starts and ends array<int> (original bytes of each piece, null where a model's pieces can't be placed), and decoded, the
    library's decoding of the ids. ``keep="digests"``: without the text, and with the digests of op6 in place of the arrays."""
    path = path or model_path()
    new = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered_bytes long" if keep else "ids array<int>, starts array<int>, ends array<int>, decoded string"
    own = Taken(docs)
    names = own.stay([c.split()[0] for c in new.split(", ")], (text,) if keep else ())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for x in portions(batches, "body"):
            texts = x["body"].tolist()
            ids = model.library.encode(texts, add_eos=True, num_threads=1)
            decoded = model.library.decode(ids)
            spans = [model.spans(t.encode("utf-8"), np.array(i, np.int64)) for t, i in zip(texts, ids, strict=True)]
            out = x[names].copy()
            if keep:
                out["n_tokens"] = [len(i) for i in ids]
                out["ids_sha256"] = [sha(" ".join(map(str, i)).encode()) for i in ids]
                out["decoded_sha256"] = [sha(d.encode()) for d in decoded]
                out["spans_sha256"] = [s and sha(np.stack(s).astype("<i8").tobytes()) for s in spans]
                out["covered_bytes"] = pd.array([s and int((s[1] - np.maximum(s[0], np.r_[0, np.maximum.accumulate(s[1])[:-1]])).clip(0).sum()) for s in spans], "Int64")
            else:
                out["ids"], out["decoded"] = ids, decoded
                out["starts"], out["ends"] = [s and s[0].tolist() for s in spans], [s and s[1].tolist() for s in spans]
            yield out

    return own.mapped(run, names, new, body=text_of(own.at(text)))


def op6(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the digest of the byte spans with the bytes they cover."""
    small_batches(spark)
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep="digests")
