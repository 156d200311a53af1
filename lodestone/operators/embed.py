"""Embedding of texts in Arrow batches, by a pluggable embedder; a failing item gets a zero vector."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of a zero vector where no item of a batch succeeded.
EMPTY_DIM = 1024
WORD = re.compile(r"[^\W_]+")
RETRIED = (429, 500, 502, 503, 504)


class BadRequest(ValueError):
    """The service refused a batch (HTTP 400); its items are then sent one by one."""


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


@lru_cache(1 << 16)
def hashed(word: str) -> int:
    """The hash of a word; that of frequent words is kept."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


@dataclass(frozen=True)
class HashEmbedder:
    """Vectors of unit length from hashed words, the same everywhere; needs no service."""

    dim: int = 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, text in enumerate(texts):
            words = Counter(WORD.findall(text.lower()))
            h = np.fromiter(map(hashed, words), np.uint64, len(words))
            n = np.fromiter(words.values(), float, len(words))
            out[k] = np.bincount((h % np.uint64(self.dim)).astype(int), np.where(h >> np.uint64(63), n, -n), self.dim)
            norm = np.linalg.norm(out[k])
            out[k] /= norm if norm else 1
        return out.tolist()


@dataclass(frozen=True)
class HttpEmbedder:
    """Client of an embedding service: POST {model, input} to ``/api/embed``; retries with doubling pauses on overload and server errors."""

    url: str
    model: str
    timeout_s: float = 120.0
    retries: int = 3
    pause_s: float = 0.5

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        got = self.call("/api/embed", {"model": self.model, "input": texts}).get("embeddings")
        if not isinstance(got, list):
            raise ValueError("the answer has no list of embeddings")
        return got

    def call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(self.url.rstrip("/") + path, data, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code == 400:
                    raise BadRequest(str(e)) from e
                if e.code not in RETRIED or attempt == self.retries:
                    raise
            time.sleep(self.pause_s * 2**attempt)
        raise AssertionError

    def generate(self, prompt: str, model: str | None = None) -> str:
        return self.call("/api/generate", {"model": model or self.model, "prompt": prompt, "stream": False}).get("response", "")

    def list_models(self) -> list[str]:
        return [m["name"] for m in self.call("/api/tags").get("models", [])]

    def is_model_available(self, name: str) -> bool:
        return name in self.list_models()


def embed_batch(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """Vectors of a batch. A refused batch is tried item by item: failed ones are zero vectors as long as the first success, or EMPTY_DIM."""
    if not texts:
        return []
    try:
        out = embedder(texts)
    except BadRequest:
        single: list[list[float] | None] = []
        for text in texts:
            try:
                single.append(embedder([text])[0])
            except (OSError, ValueError, IndexError):
                single.append(None)
        dim = next((len(v) for v in single if v is not None), EMPTY_DIM)
        return [v if v is not None else [0.0] * dim for v in single]
    if len(out) != len(texts):
        raise ValueError(f"{len(texts)} texts, {len(out)} embeddings")
    return out


def embedding_of(embedder: Embedder) -> Callable[[Column], Column]:
    """Column function that embeds a text column."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(embed_batch(embedder, x.fillna("").tolist()), index=x.index, dtype=object)

    return run


def is_zero(embedding: Column) -> Column:
    return F.forall(embedding, lambda v: v == 0)
