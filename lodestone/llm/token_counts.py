"""Token counts of sections, by offset-mapped attribution.

A whole document is encoded once; ids are never counted section by section, which would give other merges at the edges. The byte lengths of
the tokens, summed, are their byte spans; the text's byte-to-character map turns these into character spans, and an interval join by binary
search over the sorted sections gives each token its section. A token that crosses a boundary is allocated by an explicit rule:

- ``start``: to the section that holds its first character (the default);
- ``end``: to the section that holds its last one;
- ``majority``: to the section with most of its bytes, the earlier of equals.

A token that holds part of a character belongs where that character is. Sections cover the text without gaps, so section counts add up to
the document's count.

Defined cases: a null or empty text has one empty section and no tokens; a null list of boundaries means lines; a list of boundaries is sorted, and
nulls, repeated ones and those outside the text are left out, the first section beginning at 0 always (so an empty list is one section); repeated rows are counted
alike; other columns pass through and input columns named like an output column, in any letters, are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, portions, small_batches, text_of

RANKS = "byte_bpe_50k.tiktoken"
RULES = ("start", "end", "majority")


@cache
def loaded(path: str, pattern: str) -> tuple:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_starts(text: str) -> np.ndarray:
    """Characters at which lines begin; a line holds its line feed, and a last feed begins no further line."""
    if not text:
        return np.array([0])
    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return np.r_[0, feeds[feeds < len(text)]]


def attribute(text: str, lengths: np.ndarray, starts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lengths: bytes of each token; starts: first character of each section, the first being 0. Tokens by section, those of them that cross
    a boundary, and the character span (n, 2) of every token."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1  # character of each byte
    stop = np.cumsum(lengths)
    begin = stop - lengths
    first, last = of_byte[begin], of_byte[stop - 1]
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    crossing = a != b
    chosen = b if rule == "end" else a
    if rule == "majority" and crossing.any():
        chosen = a.copy()
        edge_byte = np.searchsorted(of_byte, starts)  # first byte of each section
        for k in np.flatnonzero(crossing):
            edges = np.r_[begin[k], edge_byte[a[k] + 1 : b[k] + 1], stop[k]]
            chosen[k] = a[k] + int(np.argmax(np.diff(edges)))
    n = len(starts)
    return np.bincount(chosen, minlength=n), np.bincount(chosen[crossing], minlength=n), np.stack([first, last + 1], 1)


def sorted_starts(given, size: int) -> np.ndarray:
    """Section starts as they are used: sorted, each once, without nulls and those outside the text, and 0 first."""
    return np.unique([0, *(int(k) for k in given if k is not None and 0 < k < size)])


def count(docs: DataFrame, text: str = "text", sections: str | None = None, rule: str = "start", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """A row for each section of each document: its columns without the text, and section, start, end (characters), n_tokens, n_crossing
    (tokens allocated to it that reach into another), and doc_tokens. ``sections``: a column array<int> of section starts; lines otherwise."""
    import public_tokenizers

    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ranks, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    new = {"section": "int", "start": "long", "end": "long", "n_tokens": "long", "n_crossing": "long", "doc_tokens": "long"}
    own = Taken(docs)
    names = own.stay(tuple(new), (text,))
    given = F.col(own.at(sections)).cast("array<int>") if sections else F.lit(None).cast("array<int>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, lengths = loaded(ranks, pattern)
        for x in portions(batches, "body"):
            parts, rows = [], []
            for body, told in zip(x["body"], x["starts"], strict=True):
                ids = np.array(encoding.encode_ordinary(body), np.int64)
                starts = line_starts(body) if told is None else sorted_starts(told, len(body))
                n, crossing, _ = attribute(body, lengths[ids], starts, rule)
                rows.append(len(starts))
                parts.append((np.arange(len(starts)), starts, np.r_[starts[1:], len(body)], n, crossing, np.full(len(starts), len(ids))))
            out = x[names].loc[np.repeat(x.index, rows)].reset_index(drop=True)
            for k, c in enumerate(new):
                out[c] = np.concatenate([p[k] for p in parts])
            yield out

    return own.mapped(run, names, ", ".join(f"`{k}` {v}" for k, v in new.items()), body=text_of(own.at(text)), starts=given)


def op8(spark, sf_dir: str) -> DataFrame:
    """A row for each line of each document: doc_id, section, start, end, n_tokens, n_crossing, doc_tokens."""
    small_batches(spark)
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
