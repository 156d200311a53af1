"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. A round splits the groups of rows that
agree so far by their next bytes (64 at first, sixteen times as many each round). A group that becomes a single row is done, and so are rows
that end within the digit: what shares their group, digit and end has the same bytes throughout. So equality rests on the bytes themselves;
the SHA-256 that a query returns decides nothing. A round shuffles the rows still undecided once. Counts are combined before the shuffle, and
the join that hands out the new groups is an ordinary equi-join, which adaptive execution splits where a group of copies is hot.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null id sorts last among equal lengths; rows repeated in
full are told apart by their place in the written table, so exactly one stays; an empty table gives an empty result; input columns named like
an output column, in any letters, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled, Taken, text_of

#: Bytes of the first digit, and the factor from one round's digit to the next.
FIRST, GROWTH = 64, 16
SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeeze(text: Column) -> Column:
    """The text without white space."""
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def classes(rows: DataFrame, text: str, carry_text: bool = True) -> DataFrame:
    """rows: columns named c0, c1, ... and ``len``; with ``row`` (unique), and ``round`` and ``class``, which together name the class of equal texts and are null for a
    text that occurs once. ``carry_text=False`` empties the text of decided rows, which then costs nothing to keep."""
    done = Settled(rows.sparkSession, "radix")
    todo = rows.withColumns({"gid": F.lit(0).cast("long"), "at": F.lit(0).cast("long")})
    names, out, k, width = rows.columns, [], 0, FIRST
    while True:
        raw = squeeze(text_of(text)).cast("binary")
        cut = todo.withColumns({"digit": F.substring(raw, F.col("at") + 1, F.lit(width)), "end": F.octet_length(raw) <= F.col("at") + width})
        key = ["gid", "digit", "end"]
        groups = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key, F.monotonically_increasing_id().alias("next"))
        groups = done.keep(groups, f"groups{k}")
        more = F.col("next").isNotNull() & ~F.col("end")
        # Always by shuffle: what moves is then in proportion to the input at every size.
        split = cut.join(groups.hint("merge"), key, "left").select(
            *[F.when(more, F.col(c)).alias(c) if c == text and not carry_text else F.col(c) for c in names],
            F.when(F.col("next").isNotNull() & F.col("end"), F.col("next")).alias("class"),
            F.lit(k).alias("round"), F.when(more, F.col("next")).alias("gid"), (F.col("at") + width).alias("at"),
            # Written with the rows, so every reading has the same, whatever machines are there.
            F.concat_ws("-", F.lit(k), F.monotonically_increasing_id()).alias("row"),
        )
        split = done.keep(split, f"rows{k}")
        done.drop(f"groups{k}")
        out.append(split.filter("gid is null").select(*names, "class", "round", "row"))
        todo = split.filter("gid is not null").select(*names, "gid", "at")
        if todo.isEmpty():
            break
        k, width = k + 1, width * GROWTH
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry_text: bool = True) -> DataFrame:
    """Each row of ``docs`` with ``keep_id`` (id of the row of its class that stays: the longest original text in code points, then the
    smallest id), ``group_size`` and ``kept``. ``carry_text=False`` leaves the texts null."""
    own, new = Taken(docs), ("keep_id", "group_size", "kept")
    body, i = own.at(text), own.at(doc_id)
    rows = classes(own.rows.withColumn("len", F.char_length(text_of(body))), body, carry_text)
    order = F.struct((-F.col("len")).alias("l"), F.col(i).isNull().alias("u"), F.col(i).alias("i"), F.col("row").alias("r"))
    best = rows.filter("class is not null").groupBy("round", "class").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    names = own.stay(new)
    alone = rows.filter("class is null").select(*names, F.col(i).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    many = rows.filter("class is not null").join(best.hint("merge"), ["round", "class"]).select(*names, F.col("best.i").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"))
    return own.back(alone.unionByName(many), names, new)


def op3(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(squeeze(text_of()).cast("binary"), 256))
    return exact_dedup(docs, carry_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
