"""Alignment of two tokenizers: byte groups that both cut out, links between overlapping tokens, and corpus-wide counts of linked ids.

A (byte-level BPE) encodes a space and the text, B (SentencePiece) the text, to which it adds the space itself; so the tokens of both tile the same bytes. Where tokens of both end,
a group ends. A link is a pair of an A and a B token whose byte ranges overlap.

Each Arrow partition is worked on in portions of some millions of characters, each by DuckDB: the tokens of a portion are two interval tables; an ASOF join finds the B token
in which each A token begins, and where both begin a group does; a window sum numbers the groups; an ASOF join of B tokens with the groups' starts puts them into these; a range join
inside groups gives the links, which are counted by document and id pair. The pairs' counts are summed up portion by portion, then merged in Spark, and every document gets back the
counts of its own pairs: the most frequent ``HEAD`` pairs are handed to the tasks (a table of this size at most), all others by a join.

A text is cut at single spaces between other characters than white space: A begins a new word there by its pattern, and no piece of B may hold a space after another character (else,
and this is looked up in the model, texts stay whole). So both encode what lies between cuts alike wherever it stands, and each distinct stretch is encoded and aligned once in a
task, as long as the task remembers it (``KEEP`` stretches).

Defined cases: texts that are null or empty, or whose tokens' bytes are not those of the text (B normalises, or U+2581 is in the text), have no tokens and no groups; strings of special
tokens are plain text; repeated rows count as often as they occur; other columns pass through, and input columns named like an output column, in any letters, are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Settled, Taken, small_batches, text_of

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that a task works on at a time (a longer text is worked on alone), and stretches that it remembers from one time to the next.
PORTION, KEEP = 2_000_000, 800_000
#: Pairs that are handed to every task: 2 MB.
HEAD = 1 << 17
#: Characters that are encoded in one call.
CALL = 4_000
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Other white space beside a space.
BESIDE = re.compile(r"[^\S ] | [^\S ]")
OUT = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}
FOUND = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}
#: A pair is one number, the A id times this and the B id.
BASE = 1 << 32


def bytes_of_characters() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: visible Latin-1 ones for themselves, the others from U+0100 on in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Both:
    """The two tokenizers with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str, ranks: str | None, pattern: str | None):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary = told["model"]["vocab"] | {x["content"]: x["id"] for x in told.get("added_tokens", ())}
        of = bytes_of_characters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, k in vocabulary.items():
            self.a_bytes[k] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes))
        self.encode_a = None
        if ranks:  # the same vocabulary in a library that is four times as fast
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            if all(self.a_bytes[k] == x for x, k in table.items()):
                self.encode_a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        if not self.encode_a:
            import tokenizers

            a = tokenizers.Tokenizer.from_file(a_path)
            a.encode_special_tokens = True
            self.encode_a = lambda text: a.encode(text, add_special_tokens=False).ids
        # An id as text, as it stands in groups: first of all, after an id of its side, first of another group or side.
        written = lambda side, mark: np.array([f"{mark}{k}" for k in range(len(side))], object)
        self.a_text = {m: written(self.a_bytes, m) for m in ("", ",", ";")}
        self.b_text = {m: written(self.b_bytes, m) for m in (",", "|")}


@cache
def loaded(*paths) -> Both:
    return Both(*paths)


def stretches(text: str) -> list[str]:
    """The text cut at single spaces between other characters than white space."""
    if "  " in text or text[0] == " " or text[-1] == " " or BESIDE.search(text):
        return CUT.split(text)
    return text.split(" ")  # all spaces are such


class Stretches(dict):
    """Numbers of stretches, given in the order in which they are first asked for."""

    def __missing__(self, text: str) -> int:
        self[text] = k = len(self)
        return k


TOKENS = """
CREATE OR REPLACE TEMP TABLE met AS SELECT a.k, a.id, a.c, a.s, a.e, a.s = b.s AS cut FROM a ASOF JOIN b ON a.s >= b.s;
CREATE OR REPLACE TEMP TABLE in_a AS SELECT k, id, c, s, e, cut, sum(cut::INT) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)::INT - 1 AS g FROM met;
CREATE OR REPLACE TEMP TABLE in_b AS SELECT b.k, b.id, b.s, b.e, x.g FROM b ASOF JOIN (SELECT g, s FROM in_a WHERE cut) x ON b.s >= x.s;
CREATE OR REPLACE TEMP TABLE fresh AS SELECT in_a.c, in_a.id::BIGINT * 4294967296 + in_b.id AS pair FROM in_a JOIN in_b USING (g) WHERE in_a.s < in_b.e AND in_b.s < in_a.e;
INSERT INTO linked SELECT * FROM fresh;
"""
#: d: documents, c: stretches, times: how often.
PAIRS = "SELECT d, pair, sum(times)::BIGINT AS n FROM used JOIN linked USING (c) GROUP BY ALL ORDER BY d, pair"


def connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    con.execute("SET preserve_insertion_order = false")
    return con


class Aligner:
    """Aligns texts of one task. Stretches seen before are kept, until there are ``keep`` of them; then all are dropped."""

    def __init__(self, both: Both, keep: int = KEEP):
        self.both, self.keep, self.con = both, keep, connection()
        self._clear()

    def _clear(self) -> None:
        self.index, self.texts = Stretches(), []
        self.counts = {k: np.zeros(0, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        self.con.execute("CREATE OR REPLACE TEMP TABLE linked (c INT, pair BIGINT)")

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B over the parts in order, and the bytes of each part with the space before it; a part that the tokens don't give back has 0 and no tokens."""
        both = self.both
        size = np.array([len(p.encode()) + 1 for p in parts], np.int64)
        ids_a, ids_b, raw, at = [], [], " " + " ".join(parts), 0
        # Several in one call, with the spaces that they begin with; one that doesn't begin and end with other characters than white space stands alone.
        for group in joined(parts, both.cuts):
            text = " ".join(group)
            ids_a.append(both.encode_a(" " + text))
            ids_b.append(both.b.encode(text))
        a, b = (np.fromiter(chain.from_iterable(x), np.int32) for x in (ids_a, ids_b))
        if both.a_length[a].sum() == size.sum() and b"".join(map(both.b_bytes.__getitem__, b.tolist())) == raw.encode():
            return a, b, size
        out_a, out_b = [], []
        for at, p in enumerate(parts):  # some have other bytes: each by itself
            x, y, own = both.encode_a(" " + p), both.b.encode(p), b" " + p.encode()
            if b"".join([both.a_bytes[i] for i in x]) == own == b"".join([both.b_bytes[i] for i in y]):
                out_a += x
                out_b += y
            else:
                size[at] = 0
        return np.array(out_a, np.int32), np.array(out_b, np.int32), size

    def _learn(self, parts: list[str], first: int) -> None:
        """Align new stretches, numbered from ``first`` on."""
        a, b, size = self._encoded(parts)
        both, ends = self.both, np.cumsum(size)
        stop_a, stop_b = np.cumsum(both.a_length[a]), np.cumsum(both.b_length[b])
        ends_a, ends_b = np.searchsorted(stop_a, ends, "right"), np.searchsorted(stop_b, ends, "right")
        count = lambda x: np.diff(x, prepend=0)
        of_a = np.repeat(np.arange(len(parts), dtype=np.int32), count(ends_a))
        small = lambda x: x.astype(np.int32) if ends[-1] < 1 << 31 else x
        for name, ids, stop, length in (("a", a, stop_a, both.a_length), ("b", b, stop_b, both.b_length)):
            columns = {"k": np.arange(len(ids), dtype=np.int32), "id": ids, "s": small(stop - length[ids]), "e": small(stop)} | ({"c": of_a + np.int32(first)} if name == "a" else {})
            self.con.register(name, pa.table(columns))
        self.con.execute(TOKENS)
        group_a, group_b = (self.con.execute(f"SELECT g FROM {t} ORDER BY k").fetchnumpy()["g"] for t in ("in_a", "in_b"))
        links = np.bincount(self.con.execute("SELECT c FROM fresh").fetchnumpy()["c"] - first, minlength=len(parts))
        new = {"n_a": count(ends_a), "n_b": count(ends_b), "n_groups": count(np.r_[0, group_a + 1][ends_a]), "n_links": links}
        self.counts = {k: np.r_[v, new[k]] for k, v in self.counts.items()}
        self.texts += strings(both, a, group_a, b, group_b, ends_a, ends_b)
        for t in ("a", "b"):
            self.con.unregister(t)

    def align(self, texts: list[str | None]) -> tuple[dict[str, list], list[str], list[np.ndarray], list[np.ndarray]]:
        """Columns n_a, n_b, n_groups, n_links of the texts, their groups as text, and the pairs of each with their links."""
        if len(self.index) > self.keep:
            self._clear()
        n, known = len(texts), len(self.index)
        split = [[] if not t else stretches(t) if self.both.cuts else [t] for t in texts]
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64)
        doc = np.repeat(np.arange(n), [len(x) for x in split])
        if len(self.index) > known:
            self._learn(list(islice(self.index, known, None)), known)
        # A text with a stretch that the tokens don't give back has no tokens at all.
        ok = np.ones(n, bool)
        ok[doc[self.counts["n_a"][codes] == 0]] = False
        codes, doc = codes[ok[doc]], doc[ok[doc]]
        sums = {k: np.bincount(doc, weights=v[codes], minlength=n).astype(np.int64).tolist() for k, v in self.counts.items()}
        edge, listed = np.searchsorted(doc, np.arange(n + 1)).tolist(), codes.tolist()
        groups = [";".join(map(self.texts.__getitem__, listed[x:y])) for x, y in pairwise(edge)]
        m = len(self.index)
        used, often = np.unique(doc * m + codes, return_counts=True)
        self.con.register("used", pa.table({"d": used // max(m, 1), "c": used % max(m, 1), "times": often}))
        got = self.con.execute(PAIRS).fetchnumpy()
        self.con.unregister("used")
        edge = np.searchsorted(got["d"], np.arange(n + 1)).tolist()
        return sums, groups, *([got[k][x:y] for x, y in pairwise(edge)] for k in ("pair", "n"))


def joined(parts: list[str], cuts: bool) -> Iterator[list[str]]:
    """The parts in order, in groups that are encoded in one call."""
    group, size = [], 0
    for p in parts:
        alone = not cuts or not p or p[0].isspace() or p[-1].isspace()
        if group and (alone or size > CALL):
            yield group
            group, size = [], 0
        if alone:
            yield [p]
        else:
            group.append(p)
            size += len(p) + 1
    if group:
        yield group


def strings(both: Both, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[str]:
    """Of each part, its groups as text. ends: number of tokens up to the end of each part."""
    items = np.empty(len(a) + len(b), object)
    first_a, first_b = np.diff(a_group, prepend=-1) > 0, np.diff(b_group, prepend=-1) > 0
    before = np.r_[0, ends_a[:-1]]
    begins = before[ends_a > before]
    text = both.a_text[","][a]
    text[first_a] = both.a_text[";"][a[first_a]]
    text[begins] = both.a_text[""][a[begins]]
    items[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = text
    text = both.b_text[","][b]
    text[first_b] = both.b_text["|"][b[first_b]]
    items[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = text
    items, ends = items.tolist(), (ends_a + ends_b).tolist()
    return ["".join(items[x:y]) for x, y in pairwise([0, *ends])]


def gathered(batches: Iterator[pa.RecordBatch], most: int = PORTION) -> Iterator[pa.Table]:
    """The rows in order, in tables whose texts hold at most ``most`` characters together, or are a single one."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.utf8_length(batch["body"]).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(lengths):
            stop = max(at + (not held), at + int(np.searchsorted(np.cumsum(lengths[at:]), most - size, "right")))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(lengths[at:stop].sum())
            if stop < len(lengths):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = stop
    if held:
        yield pa.Table.from_batches(held)


def lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def found(docs: DataFrame, text: str, paths: tuple, portion: int, groups: bool) -> tuple[DataFrame, Taken, list[str]]:
    """The alignment of each row, without corpus counts: c-columns, the columns of FOUND (and ``groups``), pairs and times."""
    own = Taken(docs)
    names = own.stay([*OUT, "groups"] if groups else list(OUT))
    new = FOUND | ({"groups": "string"} if groups else {}) | {"pairs": "array<long>", "times": "array<long>"}
    rows = own.rows.select(*names, text_of(own.at(text)).alias("body"))
    schema = T.StructType([*rows.select(*names).schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in new.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for x in gathered(batches, portion):
            aligner = aligner or Aligner(loaded(*paths))
            sums, told, pairs, times = aligner.align(x["body"].to_pylist())
            out = x.drop_columns(["body"])
            columns = sums | {"groups_sha256": [t and hashlib.sha256(t.encode()).hexdigest() for t in told]} | ({"groups": told} if groups else {})
            for k, v in columns.items():
                out = out.append_column(k, pa.array(v, pa.string() if k.startswith("groups") else pa.int64()))
            yield from out.append_column("pairs", lists(pairs)).append_column("times", lists(times)).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema), own, names


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links that hold it, over all rows), best (n is the highest of its B id). rows: pairs and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for x in batches:
            con = con or connection()
            con.register("x", pa.Table.from_batches([x]))
            got = con.execute("SELECT pair, sum(n)::BIGINT AS n FROM (SELECT unnest(pairs) AS pair, unnest(times) AS n FROM x) GROUP BY pair").fetchnumpy()
            con.unregister("x")
            yield pa.RecordBatch.from_pydict({k: pa.array(np.asarray(got[k], np.int64)) for k in ("pair", "n")})

    sums = rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.col("pair") % F.lit(BASE)))
    return sums.select("pair", "n", (F.col("n") == best).alias("best"))


def align(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None, ranks: str | None = None, pattern: str | None = None, portion: int = PORTION, head: int = HEAD, groups: bool = False) -> DataFrame:
    """``docs`` with the columns of OUT: tokens of both sides, groups, links, links whose pair is the most frequent of its B id, the sum of the links' counts, and the digest of the
    groups as text (``groups``: the text itself as well). ``ranks`` and ``pattern``: A's vocabulary for the faster library, used if its entries are those of ``a_path``."""
    import public_tokenizers

    if not a_path:
        ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    paths = (a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE), ranks, pattern)
    done = Settled(docs.sparkSession, "align")
    rows, own, names = found(docs, text, paths, portion, groups)
    rows = done.keep(rows.withColumn("row", F.monotonically_increasing_id()), "found")
    counts = done.keep(pair_counts(rows), "counts")
    # Bounded: ``head`` rows at most come to the driver and go to the tasks.
    top = counts.orderBy(F.desc("n"), "pair").limit(head).toArrow()
    at = np.argsort(top["pair"].to_numpy())
    keys, n, best = (top[c].to_numpy()[at] for c in ("pair", "n", "best"))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = T.StructType([*rows.select(*kept).schema.fields, *T._parse_datatype_string("n_best long, count_sum long, rest array<struct<pair: long, times: long>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            offsets = x["pairs"].offsets.to_numpy()
            offsets = offsets - offsets[0]
            pairs, times = x["pairs"].flatten().to_numpy(), x["times"].flatten().to_numpy()
            k = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[k] == pairs if len(keys) else np.zeros(len(pairs), bool)
            row = np.repeat(np.arange(x.num_rows), np.diff(offsets))
            worth = np.zeros(len(pairs), np.int64)
            worth[hit] = times[hit] * n[k[hit]]
            good = np.zeros(len(pairs), np.int64)
            good[hit] = times[hit] * best[k[hit]]
            summed = lambda v: np.diff(np.r_[0, np.cumsum(v)][offsets])
            left = pa.ListArray.from_arrays(np.searchsorted(row[~hit], np.arange(x.num_rows + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(pairs[~hit]), pa.array(times[~hit])], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*[x[c] for c in kept], pa.array(summed(good)), pa.array(summed(worth)), left], schema=_arrow(schema))

    out = rows.select(*rows.columns).mapInArrow(run, schema)
    if top.num_rows == head and counts.count() > head:
        out = done.keep(out, "headed")
        rest = out.select("row", F.explode("rest").alias("x")).select("row", "x.pair", "x.times").join(counts.hint("merge"), "pair")
        rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("worth"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("good"))
        out = out.join(rest.hint("merge"), "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("good", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("worth", F.lit(0))})
    return own.back(out, names, [*OUT, *(["groups"] if groups else [])])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def op13(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    small_batches(spark)
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", *OUT)
