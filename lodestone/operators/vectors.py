"""Inverted-file index of vectors: each vector is in the list of its nearest centroid, a query looks into the lists of its nearest centroids and ranks what they hold exactly.

Centroids are fitted by k-means on a bounded sample, the rows whose keys have the smallest hashes, ``SAMPLE_VALUES`` numbers at most; every vector is put into a list, wherever the sample came from.
Lists are partitions, so those that aren't asked for are not read. ``probes`` says how many lists a query looks into; None is all of them, which is the exact way. Vectors that are null or
of another length than the centroids are in the list -1, which is near nothing.

Many queries meet the vectors by shelf: neighbouring small lists share one, a large list has several, and a query is sent once to each shelf that holds any of its lists. So what is sent
grows with the shelves, not with the lists, and a large list is worked on in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import search

#: Numbers in the sample that centroids are fitted on (16 MB), and lists at most.
SAMPLE_VALUES, MOST_LISTS = 1 << 22, 4096
ROUNDS = 12
LIST = T.StructField("list_no", T.IntegerType())


def dots(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, less what is the same for all centroids."""
    return (centroids**2).sum(1) - 2 * vectors @ centroids.T


def closest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its ``dots``, some rows at a time."""
    own, least = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
    step = max(1, search.STEP // max(1, len(centroids)))
    for k in range(0, len(vectors), step):
        d = dots(vectors[k : k + step], centroids)
        own[k : k + step] = d.argmin(1)
        least[k : k + step] = d.min(1)
    return own, least


def means(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by k-means from the first rows that differ; a list that loses all its rows gets the row that is farthest from its centroid."""
    centroids = np.unique(sample, axis=0, return_index=True)[1]
    centroids = sample[np.sort(centroids)[:lists]].copy()
    for _ in range(ROUNDS):
        own, least = closest(sample, centroids)
        n = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
        far = np.argsort(-(least + (sample**2).sum(1)), kind="stable")
        empty = np.flatnonzero(n == 0)
        centroids[empty] = sample[far[: len(empty)]]
    return centroids


def fit(vectors: DataFrame, lists: int | None = None, key: Sequence[str] = ("id",), values: int = SAMPLE_VALUES) -> np.ndarray:
    """Centroids of ``vectors`` (embedding, of which the most frequent length counts). ``lists``: the square root of the number of vectors, if not given."""
    known = vectors.filter("embedding IS NOT NULL")
    sizes = known.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None or not sizes["dim"]:
        return np.zeros((0, 0))
    n, dim = sizes["count"], sizes["dim"]
    lists = min(lists or max(1, round(n**0.5)), MOST_LISTS)
    rows = known.filter(F.size("embedding") == dim).orderBy(F.xxhash64(*key), *key).limit(max(1, values // dim)).select("embedding").toArrow()
    sample = pc.list_flatten(rows["embedding"]).to_numpy().reshape(-1, dim).astype(float)
    return means(sample, lists)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with list_no."""
    at = vectors.columns.index("embedding")
    form = T.StructType([*vectors.schema.fields, LIST])
    dim = centroids.shape[1] if len(centroids) else -2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = np.full(x.num_rows, -1, np.int32)
            if dim > 0:
                same, v = search.matrix(x.column(at), dim)
                out[same] = closest(v, centroids)[0]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out)], names=form.fieldNames())

    return vectors.mapInArrow(run, form)


def looked_into(query: Sequence[float], centroids: np.ndarray, probes: int | None) -> list[int]:
    """Lists of a query, the nearest centroids first."""
    q = np.asarray(query, float)
    if not len(centroids) or len(q) != centroids.shape[1]:
        return []
    return np.argsort(dots(q[None], centroids)[0], kind="stable")[:probes].tolist()


def nearest(lists: DataFrame, centroids: np.ndarray, queries: dict[str, Sequence[float]], k: int = 10, tie: Sequence[str] = ("id",), probes: int | None = None, **where) -> DataFrame:
    """``search.nearest`` of a few queries over the lists that any of them looks into (list_no among the columns of ``lists``)."""
    wanted = sorted({n for q in queries.values() for n in looked_into(q, centroids, probes)})
    return search.nearest(lists.filter(F.col("list_no").isin(wanted)), queries, k, tie, **where)


def shelves(sizes: dict[int, int], lists: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first shelf, and over how many it is dealt: a list of more than ``most`` vectors has shelves of its own, others share one up to that number."""
    first, parts = np.zeros(lists, int), np.ones(lists, int)
    shelf, held = 0, 0
    for n in range(lists):
        size = sizes.get(n, 0)
        if held and held + size > most:
            shelf, held = shelf + 1, 0
        first[n], held = shelf, held + size
        if size > most:
            parts[n] = -(-size // most)
            shelf, held = shelf + parts[n], 0
    return first, parts


def nearest_many(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """``search.nearest_many`` through the lists: query_id, id, distance, place of each of many queries (id, embedding). Shelves of lists meet groups of queries, each pair in a task
    of its own."""
    dim = centroids.shape[1] if len(centroids) else 0
    if not dim:
        return search.nearest_many(lists, queries, k).limit(0)
    held = {r["list_no"]: r["count"] for r in lists.filter("list_no >= 0").groupBy("list_no").count().collect()}
    first, parts = shelves(held, len(centroids), max(1, search.VECTOR_VALUES // dim))
    last = first + parts
    asked = queries.select(F.col("id").cast("long").alias("id"), "embedding").filter(F.size("embedding") == dim)
    q_groups = search.in_groups(asked.count(), dim, search.QUERY_VALUES)
    everything = probes is None or probes >= len(centroids)

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, ids = (x.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array((first[n] + (mixed % parts[n].astype(np.uint64)).astype(int)).astype(np.int32))], names=a_form.fieldNames())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = search.matrix(x.column(1), dim)[1]
            for j in range(0, len(v), most := max(1, search.STEP // len(centroids))):
                near = np.argsort(dots(v[j : j + most], centroids), axis=1, kind="stable")[:, :probes].astype(np.int32)
                for k, own in enumerate(near, j):
                    on = np.unique(np.concatenate([np.arange(first[n], last[n]) for n in own])).astype(np.int32)
                    at = pa.array(np.full(len(on), k))
                    yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at), pa.array([own.tolist()] * len(on), pa.list_(pa.int32())), pa.array(on)], names=b_form.fieldNames())

    kept = lists.filter("list_no >= 0").select("list_no", F.col("id").cast("long").alias("id"), "embedding")
    number = T.StructField("v_no", T.IntegerType())
    a_form = T.StructType([*kept.schema.fields, number])
    b_form = T.StructType([*asked.schema.fields, T.StructField("looks", T.ArrayType(T.IntegerType())), number])
    a = kept.mapInArrow(shelved, a_form).withColumn("q_no", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))))
    if everything:
        b = asked.withColumn("v_no", F.explode(F.sequence(F.lit(0), F.lit(int(last.max()) - 1))))
    else:
        b = asked.mapInArrow(spread, b_form)
    b = b.withColumn("q_no", F.pmod(F.xxhash64("id", "embedding"), F.lit(q_groups)).cast("int"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        (some, v), (at, q) = (search.matrix(x["embedding"], dim) for x in (left, right))
        ids, q_ids = left["id"].to_numpy()[some], right["id"].to_numpy()[at]
        if everything:
            one, near, d = search.first_of(ids, v, q, k)
            return search.near_table(q_ids[one], near, d)
        own = left["list_no"].to_numpy()[some]
        looks = right["looks"].combine_chunks()
        whose, wanted = pc.list_parent_indices(looks).to_numpy(), pc.list_flatten(looks).to_numpy()
        out = [search.near_table([], [], [])]
        for n in np.unique(own):
            inside, those = np.flatnonzero(own == n), whose[wanted == n]
            one, near, d = search.first_of(ids[inside], v[inside], q[those], k)
            out.append(search.near_table(q_ids[those][one], near, d))
        return pa.concat_tables(out)

    return search.met(a, b, meet, k)
