"""Positional postings: for each term and block of documents, which documents hold it, how often and where; phrase search by intersecting positions.

A document has a number; its high bits name a block of ``BLOCK`` documents, its low bits its place in it. A row holds for a term and a block the documents' places, their lengths, the
term's occurrences in each, and its positions, places and positions as differences to the one before. Fields of a document are a position apart, so no phrase crosses them. Rows are
built batch by batch where documents are read, so a block that is read in parts has several rows for a term.

A phrase's rows meet by block, a few thousand documents at most, where positions are intersected from the rarest term on. What a search reads and shuffles are the rows of its terms. Every
block with all terms is intersected, as the weight of a phrase depends on how many documents hold it; no score bound could spare that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import search

BITS = 12
BLOCK = 1 << BITS
#: Characters of token lines that are turned into rows at a time.
PORTION = 1 << 22
LISTS = ("places", "lengths", "times", "positions")
ROW = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in LISTS]])


def differences(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the value before; where ``first``, the value itself."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The inverse of ``differences``; first: indices."""
    total = np.cumsum(values)
    base = total[first] - values[first]
    return total - np.repeat(base, np.diff(np.r_[first, len(values)]))


def listed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Lists that begin at the indices ``first``."""
    return pa.ListArray.from_arrays(np.r_[first, len(values)].astype(np.int32), pa.array(values.astype(np.int32)))


def rows_of(words: pa.Array, numbers: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, list[pa.Array]]:
    """term, group and the lists of each posting row; documents of a row are those of one group."""
    split = pc.split_pattern(words, " ")
    doc, flat = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    offsets = split.offsets.to_numpy()
    position = np.arange(len(flat)) - (offsets[:-1] - offsets[0])[doc]
    coded = flat.dictionary_encode()
    # What stands between fields keeps its position, but is no term.
    real = np.array([bool(t) and "|" not in t for t in coded.dictionary.to_pylist()], bool)
    code = coded.indices.to_numpy()
    keep = real[code]
    code, doc, position = code[keep], doc[keep], position[keep]
    order = np.lexsort((position, numbers[doc], groups[doc], code))
    code, doc, position = code[order], doc[order], position[order]
    group, place = groups[doc], numbers[doc] & (BLOCK - 1)
    new_row = np.r_[True, (np.diff(code) != 0) | (np.diff(group) != 0)] if len(code) else np.zeros(0, bool)
    new_doc = new_row | np.r_[True, np.diff(doc) != 0] if len(code) else new_row
    at_doc = np.flatnonzero(new_doc)
    row_at = np.flatnonzero(new_row[at_doc])  # among documents
    of_positions = np.flatnonzero(new_row)
    own = place[at_doc]
    lists = [listed(differences(own, row_at), row_at), listed(lengths[doc[at_doc]], row_at), listed(np.diff(np.r_[at_doc, len(code)]), row_at), listed(differences(position, at_doc), of_positions)]
    return coded.dictionary.take(pa.array(code[of_positions])), group[of_positions], lists


def build(docs: DataFrame, number: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Posting rows of ``docs`` (words and length as from ``search.tokenized``, a number each, and columns ``keys``, by which rows are kept apart): the keys and the columns of ROW."""
    keys = list(keys)
    ready = docs.select(*keys, F.col(number).cast("long").alias("number"), "words", F.col("length").cast("int").alias("length"))
    form = T.StructType([*[ready.schema[k] for k in keys], *ROW.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch["words"]).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION, "right")))
                x = batch.slice(at, stop - at)
                at = stop
                numbers = x["number"].to_numpy()
                named = pd.DataFrame({**{k: x[k].to_pandas() for k in keys}, "__block": numbers >> BITS})
                group = named.groupby(list(named.columns), dropna=False, sort=False).ngroup().to_numpy()
                _, first = np.unique(group, return_index=True)
                term, group, lists = rows_of(x["words"], numbers, x["length"].to_numpy(), group)
                of = pa.array(first[group])
                yield pa.RecordBatch.from_arrays([*[x[k].take(of) for k in keys], term.cast(pa.string()), pa.array(numbers[first[group]] >> BITS), *lists], names=form.fieldNames())

    return ready.mapInArrow(run, form)


def decoded(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a term in a block: its occurrences, as place * 2^32 + position, sorted, and the places of its documents with their lengths."""
    flat = {c: rows[c].combine_chunks() for c in LISTS}
    own = {c: pc.list_flatten(v).to_numpy().astype(np.int64) for c, v in flat.items()}
    starts = lambda c: np.r_[0, np.cumsum(pc.list_value_length(flat[c]).to_numpy())[:-1]]
    place = sums(own["places"], starts("places"))
    position = sums(own["positions"], np.r_[0, np.cumsum(own["times"])[:-1]])
    return np.sort((np.repeat(place, own["times"]) << 32) + position), place, own["lengths"]


def matched(rows: pa.Table, phrases: dict[str, list[str]]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """query, places, times and lengths of the documents of a block that hold each phrase."""
    names = np.array(rows["term"].to_pylist(), object)
    terms: dict[str, tuple] = {}
    for query, phrase in phrases.items():
        if not set(phrase) <= set(names):
            continue
        for t in phrase:
            if t not in terms:
                terms[t] = decoded(rows.filter(pa.array(names == t)))
        rare = sorted(range(len(phrase)), key=lambda k: len(terms[phrase[k]][0]))
        found = terms[phrase[rare[0]]][0] - rare[0]  # where the phrase would begin
        for k in rare[1:]:
            found = np.intersect1d(found, terms[phrase[k]][0] - k, assume_unique=True)
        if len(found):
            place, times = np.unique(found >> 32, return_counts=True)
            _, own, length = terms[phrase[rare[0]]]
            order = np.argsort(own)
            yield query, place, times, length[order][np.searchsorted(own[order], place)]


def asked(phrases: dict[str, str]) -> dict[str, list[str]]:
    return {k: t for k, p in phrases.items() if (t := search.plain_tokens(p))}


def hits(postings: DataFrame, phrases: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """query_id, the keys, number, tf and length of the documents that hold each phrase."""
    keys, wanted = list(keys), asked(phrases)
    form = T.StructType([T.StructField("query_id", T.StringType()), *[postings.schema[k] for k in keys], *T.StructType.fromDDL("number long, tf int, length int").fields])

    def run(group: pa.Table) -> pa.Table:
        block, parts = group["block"][0].as_py(), []
        for query, place, times, length in matched(group, wanted):
            same = [pa.array([group[k][0].as_py()] * len(place), group.schema.field(k).type) for k in keys]
            parts.append(pa.table([pa.array([query] * len(place)), *same, pa.array((block << BITS) + place), pa.array(times.astype(np.int32)), pa.array(length.astype(np.int32))], names=form.fieldNames()))
        return pa.concat_tables(parts) if parts else pa.table({f: pa.array([], t) for f, t in zip(form.fieldNames(), [pa.string(), *[group.schema.field(k).type for k in keys], pa.int64(), pa.int32(), pa.int32()], strict=True)})

    terms = sorted({t for p in wanted.values() for t in p})
    return postings.filter(F.col("term").isin(terms)).groupBy(*keys, "block").applyInArrow(run, form)


def bm25(found: DataFrame, n_docs: Column, mean_length: Column) -> DataFrame:
    """``found`` as from ``hits`` with rank; the documents that hold a phrase are counted over all of ``found``."""
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    by = counts.agg(F.map_from_entries(F.collect_list(F.struct("query_id", "n_hits"))).alias("m")).scalar()
    return found.withColumn("rank", search.rank_of(F.col("tf"), F.col("length"), n_docs, mean_length, F.element_at(by, F.col("query_id"))))
