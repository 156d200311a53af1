"""Merkle manifest of a dataset: a digest for every row, a tree over them, one root, and for each row the proof that it is in the tree.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as their hex text. A leaf is H of the manifest's fields: ``-`` for null, else the number of
UTF-8 bytes, ``:`` and the value. Per key (``lang``) leaves ascend by id; while several nodes remain, every two consecutive ones, or a last single one, become their H. What
remains is the key's subroot, and the subroots, ordered by key (null first, bytewise), become the root in the same way.

The tree is built in blocks of 1,024 aligned nodes. A block is traversed recursively in postorder: a call returns its subtree's digest, and while the calls unwind, each
child's digest is appended to the proofs of the leaves below its sibling. The blocks' roots are the nodes of the next distributed traversal, until each key has one
node; the subroots are one more sequence of nodes and go the same way. Proofs of upper levels then join down by block, so a task holds 1,024 nodes whatever the size of a
key. Places in the order come from a range sort whose rows are written with their partition and their place in it, and sums of the partitions before: no task numbers
a whole key, and rereading the table gives the same places.

Defined cases: null ids come first in their key (and are never tampered with in the query); rows of equal id follow each other by their digest, and rows alike in all fields are
interchangeable; null keys are a key of their own, the first, and an empty key is another; empty and very long texts are hashed whole; a tree of one leaf has that leaf as its root
and an empty proof; an empty table gives an empty result; columns other than those of the manifest don't count and are left out by ``manifest``'s output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Settled, Taken, small_batches

#: Levels of a block; a block has 2 ** LEVELS nodes.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 32


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a row."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def node(*digests: bytes) -> bytes:
    """The digest over digests, in binary."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def block_proofs(leaves: list[bytes], levels: int) -> tuple[bytes, list[bytearray]]:
    """The digest of a block, brought to ``levels`` levels, and for each of its leaves the siblings on the way, from the leaf upwards."""
    proofs = [bytearray() for _ in leaves]

    def walk(start: int, stop: int, level: int) -> bytes:
        if level == 0:
            return leaves[start]
        middle = start + (1 << level - 1)
        left = walk(start, min(middle, stop), level - 1)
        if middle >= stop:
            return node(left)
        right = walk(middle, stop, level - 1)
        for k in range(start, middle):
            proofs[k] += right
        for k in range(middle, stop):
            proofs[k] += left
        return node(left, right)

    return walk(0, len(leaves), levels), proofs


def folded(digest: bytes, proof: bytes, place: int, count: int) -> tuple[bytes, int]:
    """The root that a digest at ``place`` of ``count`` nodes and its siblings lead to, and the number of siblings used."""
    used = 0
    while count > 1:
        if place ^ 1 < count:
            other = proof[used * WIDTH : (used + 1) * WIDTH]
            used += 1
            digest = node(other, digest) if place & 1 else node(digest, other)
        else:
            digest = node(digest)
        place, count = place >> 1, (count + 1) >> 1
    return digest, used


def placed(rows: DataFrame, key: str, order: Sequence[str], done: Settled, name: str) -> DataFrame:
    """``rows`` with ``place``, their number from 0 within the key in the given order, and ``n``, the rows of the key. ``rows`` must be a written table."""
    by = [key, *order, "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # spreads what is alike in all of the order
    # The low 33 bits of the id number a task's rows in the order that the sort gives.
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = done.keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumns({"part": F.spark_partition_id(), "at": at}), name)
    # A row for each key and each partition that holds some of it; summed over the partitions of a key.
    parts = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first"))
    here = Window.partitionBy(key)
    before = F.coalesce(F.sum("m").over(here.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(key, "part", (before - F.col("first")).alias("shift"), F.sum("m").over(here).alias("n"))
    return rows.join(parts.hint("merge"), [key, "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def climbed(nodes: DataFrame, key: str, done: Settled, name: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """nodes: key, place, n, digest and others; with ``block`` (number of its block) and ``proof`` (within the block), and a table of (key, block) with ``upper``, the rest of the
    proof up to the key's root, and ``root``."""
    rounds: list[DataFrame] = []
    todo, size = nodes, 1 << levels

    def block(x: pa.Table) -> pa.Table:
        x = x.sort_by("place")
        top, proofs = block_proofs(x["digest"].to_pylist(), min(levels, (x["n"][0].as_py() - 1).bit_length()))
        return x.append_column("proof", pa.array([bytes(p) for p in proofs], pa.binary())).append_column("top", pa.array([top] * len(proofs), pa.binary()))

    while True:
        todo = todo.withColumn("block", F.shiftright("place", levels))
        schema = T.StructType([*todo.schema.fields, T.StructField("proof", T.BinaryType()), T.StructField("top", T.BinaryType())])
        here = done.keep(todo.groupBy(key, "block").applyInArrow(block, schema), f"{name}{len(rounds)}")
        rounds.append(here)
        # The first node of a block tells the block's root; keys of one block are done.
        todo = here.filter((F.col("place") == F.col("block") * size) & (F.col("n") > size))
        if todo.isEmpty():
            break
        todo = todo.select(key, F.col("block").alias("place"), F.shiftright(F.col("n") + (size - 1), levels).alias("n"), F.col("top").alias("digest"))
    upper = None
    for here in reversed(rounds):
        heads = here.filter(F.col("place") == F.col("block") * size).select(key, "block", F.col("block").alias("place"), "top")
        if upper is not None:
            heads = heads.join(upper.hint("merge"), [key, "place"], "left")
        else:
            heads = heads.withColumns({"upper": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary")})
        blocks = heads.select(key, "block", F.coalesce("upper", F.lit(b"")).alias("upper"), F.coalesce("root", "top").alias("root"))
        upper = here.select(key, "block", "place", "proof").join(blocks.hint("merge"), [key, "block"]).select(key, "place", F.concat("proof", "upper").alias("upper"), "root")
    return rounds[0].drop("top"), blocks


def manifest(docs: DataFrame, key: str = "lang", doc_id: str = "doc_id", fields: Sequence[str] = FIELDS, levels: int = LEVELS, tamper: Callable[[dict[str, Column]], Column] | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, leaf, subroot and root (hex); place and count of the leaf in its key, key_place and keys of the key among all; proof (the siblings from
    the leaf to the root, 32 bytes each), and ``other``, the digest of the row as tampered with, null if it isn't: what ``tamper`` makes of the fields' columns."""
    own = Taken(docs)
    k = F.col(own.at(key)).cast("string")
    columns = {f: F.col(own.at(f)) for f in fields}
    leaves = own.rows.select(
        F.col(own.at(doc_id)).alias("id"), F.when(k.isNull(), "").otherwise(F.concat(F.lit("+"), k)).alias("k"),
        F.unhex(leaf_of(list(columns.values()))).alias("digest"), F.unhex(tamper(columns) if tamper else F.lit(None).cast("string")).alias("other"),
    )
    done = Settled(docs.sparkSession, "merkle")
    leaves = done.keep(leaves, "leaves")
    low, blocks = climbed(placed(leaves, "k", ["id", "digest"], done, "sorted"), "k", done, "nodes", levels)
    blocks = done.keep(blocks, "blocks")
    # The subroots are the nodes of one more sequence.
    heads = done.keep(blocks.filter("block = 0").select(F.lit("").alias("one"), "k", F.col("root").alias("digest")), "heads")
    top, tops = climbed(placed(heads, "one", ["k"], done, "heads_sorted"), "one", done, "keys", levels)
    roots = top.join(tops.hint("merge"), ["one", "block"]).select("k", F.col("place").alias("key_place"), F.col("n").alias("keys"), F.concat("proof", "upper").alias("last"), F.col("root").alias("all_root"))
    full = blocks.join(roots.hint("merge"), "k").select("k", "block", F.concat("upper", "last").alias("rest"), F.col("root").alias("subroot"), F.col("all_root").alias("root"), "key_place", "keys")
    full = done.keep(full, "full")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return low.withColumnRenamed("digest", "leaf").join(full.hint("merge"), ["k", "block"]).select(
        "id", text("leaf"), text("subroot"), text("root"), "place", F.col("n").alias("count"), "key_place", "keys", F.concat("proof", "rest").alias("proof"), "other"
    )


@F.pandas_udf(T.StringType())
def refolded(leaf: pd.Series, other: pd.Series, proof: pd.Series, place: pd.Series, count: pd.Series, key_place: pd.Series, keys: pd.Series) -> pd.Series:
    """The root that the tampered, else the original leaf and its siblings lead to."""
    out = []
    for a, b, p, i, n, j, m in zip(leaf, other, proof, place, count, key_place, keys, strict=True):
        digest, used = folded(bytes.fromhex(a) if b is None else b, p, int(i), int(n))
        out.append(folded(digest, p[used * WIDTH :], int(j), int(m))[0].hex())
    return pd.Series(out, dtype=object)


def verify(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with proof_sha256, folded_root (what the tampered, else the original leaf leads to by the proof) and verified."""
    rows = rows.withColumns({"proof_sha256": F.sha2(F.lower(F.hex("proof")).cast("binary"), 256), "folded_root": refolded("leaf", "other", "proof", "place", "count", "key_place", "keys")})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(fields: dict[str, Column]) -> Column:
    """Where 7 divides the id's crc32, the digest with 1 more in n_chars."""
    changed = fields | {"n_chars": fields["n_chars"] + 1}
    return F.when(F.crc32(fields["doc_id"].cast("string").cast("binary")) % 7 == 0, leaf_of(list(changed.values())))


def op11(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one document in seven has 1 added to its n_chars."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    rows = verify(manifest(docs, tamper=tampered))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP11_SQL = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                            n_chars, coalesce(strlen(text) || ':' || text, '-') AS z FROM documents),
b AS (SELECT doc_id, coalesce('+' || lang, '') AS k, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || z) AS leaf,
             sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || z) AS other FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY k) AS n FROM b),
c AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                                     lambda r, x: list_reduce(range(8), lambda v, j: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END), xor(r, x)), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
      FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
t AS (SELECT k, 0 AS lev, place AS i, leaf AS h, n FROM d
      UNION ALL
      SELECT k, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY k, lev, i // 2, n),
s AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, place AS i, subroot AS h, n FROM s
      UNION ALL
      SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lev, i // 2, n),
steps AS (SELECT l.k, l.lev, l.i, CASE WHEN r.h IS NULL THEN 'R' WHEN l.i % 2 = 1 THEN 'L' || r.h ELSE 'R' || r.h END AS step
          FROM t l LEFT JOIN t r ON l.k = r.k AND l.lev = r.lev AND r.i = xor(l.i, 1::BIGINT) WHERE l.n > 1),
up AS (SELECT l.lev, l.i, CASE WHEN r.h IS NULL THEN 'R' WHEN l.i % 2 = 1 THEN 'L' || r.h ELSE 'R' || r.h END AS step
       FROM u l LEFT JOIN u r ON l.lev = r.lev AND r.i = xor(l.i, 1::BIGINT) WHERE l.n > 1),
low AS (SELECT d.k, d.place, coalesce(list(step ORDER BY lev) FILTER (WHERE step IS NOT NULL), []) AS steps FROM d LEFT JOIN steps ON d.k = steps.k AND steps.i = d.place >> steps.lev GROUP BY d.k, d.place),
high AS (SELECT s.k, s.subroot, coalesce(list(step ORDER BY lev) FILTER (WHERE step IS NOT NULL), []) AS steps FROM s LEFT JOIN up ON up.i = s.place >> up.lev GROUP BY s.k, s.subroot),
p AS (SELECT d.doc_id, d.leaf, high.subroot, (SELECT h FROM u WHERE n = 1) AS root, low.steps || high.steps AS steps,
             CASE WHEN c.crc % 7 = 0 THEN d.other ELSE d.leaf END AS start
      FROM d JOIN low USING (k, place) JOIN high USING (k) LEFT JOIN c USING (doc_id)),
o AS (SELECT *, list_reduce(steps, lambda x, y: sha256(CASE WHEN y[1] = 'L' THEN y[2:] || x ELSE x || y[2:] END), start) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda y: y[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o
"""
