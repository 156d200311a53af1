"""Ranked retrieval: phrase BM25, exact k nearest vectors, and their weighted fusion. Many queries are answered in one plan."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text

# Constants of the ranking formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("workspace_id", "file_path", "symbol_name", "code", "docstring")


def plain_tokens(phrase: str) -> list[str]:
    """Tokens of a query, as ``text.tokens`` makes them of a column."""
    folding = str.maketrans(text.FOLD_FROM, text.FOLD_TO)
    return "".join(c if c.isalnum() and unicodedata.category(c)[0] in "LN" else " " for c in phrase.lower().translate(folding)).split()


def tokenized(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``docs`` with ``words``, the token lines of all fields with a bar between, and ``length``, their number of tokens. Worth storing where it is searched often."""
    lines = docs.withColumn("words", F.concat_ws("|", *[text.token_line(F.col(c)) for c in fields]))
    # A line of n tokens has n + 1 spaces.
    return lines.withColumn("length", text.token_count(F.col("words")) - F.size(F.filter(F.split("words", r"\|"), lambda x: x != "")))


def weight_of(tf, length, mean_length):
    """A document's part of the rank: the more occurrences and the shorter, the higher."""
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / mean_length))


def rank_of(tf: Column, length: Column, n_docs: Column, mean_length: Column, n_hits: Column) -> Column:
    idf = F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5))
    return -F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * weight_of(tf, length, mean_length)


def plain_rank(tf: int, length: int, n_docs: int, mean_length: float, n_hits: int) -> float:
    """``rank_of`` for collected hits."""
    idf = math.log((n_docs - n_hits + 0.5) / (n_hits + 0.5))
    return -(idf if idf > 0 else LEAST_IDF) * weight_of(tf, length, mean_length)


def bm25(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """For each query (id: phrase) the documents that hold the phrase in one field: query_id, the columns of docs, and rank (lower is better).
    Document counts and lengths are over all of ``docs``, whatever is filtered afterwards. ``docs`` as from ``tokenized``.

    One pass counts documents and hits of all phrases into a single row; another ranks the hits. Nothing but that row is shuffled."""
    asked = {k: " " + " ".join(t) + " " for k, p in phrases.items() if (t := plain_tokens(p))}
    if not asked:
        return docs.drop("words").withColumns({"query_id": F.lit(""), "tf": F.lit(0), "rank": F.lit(0.0)}).filter(F.lit(False))
    holds = {k: F.col("words").contains(p) for k, p in asked.items()}
    total = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"), F.array(*[F.count_if(h) for h in holds.values()]).alias("n_hits"))
    # Places where the phrase begins; the space before it is shared with the token before, so places may overlap.
    tf = [F.when(holds[k], F.struct(F.lit(k).alias("query_id"), F.lit(n).alias("q"), F.regexp_count("words", F.lit(f"(?={p})")).alias("tf"))) for n, (k, p) in enumerate(asked.items())]
    hits = docs.withColumn("hit", F.explode(F.array_compact(F.array(*tf)))).select(*[c for c in docs.columns if c != "words"], "hit.query_id", "hit.q", "hit.tf")
    hits = hits.withColumns({c: total.select(c).scalar() for c in ("n_docs", "mean_length", "n_hits")}).withColumn("n_hits", F.col("n_hits")[F.col("q")])
    rank = rank_of(*[F.col(c) for c in ("tf", "length", "n_docs", "mean_length", "n_hits")])
    return hits.withColumn("rank", rank).drop("n_docs", "mean_length", "n_hits", "q")


def language_filter(path: Column, language: str | None) -> Column:
    """Paths with the suffix that stands for the language, in any case of letters."""
    return F.lit(True) if not language else F.lower(path).endswith(paths.SEARCH_SUFFIX.get(language.lower(), f".{language.lower()}"))


def has_language(path: str, language: str | None) -> bool:
    """``language_filter`` for a collected path."""
    return not language or path.lower().endswith(paths.SEARCH_SUFFIX.get(language.lower(), f".{language.lower()}"))


def best(rows: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The first k rows of each query, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def best_of(rows: DataFrame, k: int, order: Sequence[Column], queries: int) -> DataFrame:
    """``best`` where the number of queries is known: the rows of a single query need no sort, only a heap of k in each task."""
    return best(rows.orderBy(*order).limit(k) if queries == 1 else rows, k, order)


def normalized(hits: DataFrame) -> DataFrame:
    """bm25_score from 1 for the best to 0 for the worst rank of a query; 1 where all ranks are equal."""
    w = Window.partitionBy("query_id")
    low, span = F.min("rank").over(w), F.max("rank").over(w) - F.min("rank").over(w)
    return hits.withColumn("bm25_score", 1 - (F.col("rank") - low) / F.when(span == 0, F.lit(1.0)).otherwise(span))


def bm25_search(docs: DataFrame, phrases: dict[str, str], workspace: str | None = None, language: str | None = None, k: int = 10) -> DataFrame:
    hits = bm25(docs, phrases).filter(language_filter(F.col("file_path"), language))
    if workspace is not None:
        hits = hits.filter(F.col("workspace_id") == workspace)
    return normalized(best_of(hits, k, [F.col("rank"), F.col("file_path"), F.col("symbol_name"), F.col("id")], len(phrases)))


#: Hits of all queries (k times their number, known beforehand) up to which they are sent to every task.
FEW_HITS = 10_000


def nearest(vectors: DataFrame, queries: dict[str, Sequence[float]], k: int = 10, tie: Sequence[str] = ("id",), workspace: str | None = None, language: str | None = None) -> DataFrame:
    """Exact k nearest rows of ``vectors`` (embedding) by squared distance, and vector_score = 1 - distance; workspace and language prune partitions. A vector that is null or
    of another length than the query is near nothing.

    Vectors meet the queries in numpy, batch by batch, with nothing of their rows but the columns ``tie``, which name a row; each task gives its k best for each query. The other
    columns are read for the k best of all, which are sent to every task if there are at most ``FEW_HITS``."""
    if workspace is not None:
        vectors = vectors.filter(F.col("workspace_id") == workspace)
    if language:
        vectors = vectors.filter(F.lower("language") == language.lower())
    tie, asked = list(tie), {q: np.asarray(v, float) for q, v in queries.items()}
    narrow = vectors.select(*tie, "embedding")
    form = T.StructType([T.StructField("query_id", T.StringType()), *[narrow.schema[t] for t in tie], T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.Table] = {}
        for x in batches:
            lists = x.column(len(tie))
            lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
            for q, query in asked.items():
                same = np.flatnonzero(lengths == len(query))
                if not len(same):
                    continue
                v = pc.list_flatten(lists if len(same) == len(lengths) else lists.take(pa.array(same))).to_numpy(zero_copy_only=False).reshape(-1, len(query)).astype(float)
                d = ((v - query) ** 2).sum(axis=1)
                near = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                own = pa.table([x.column(j).take(pa.array(same[near])) for j in range(len(tie))] + [pa.array(d[near])], names=[*tie, "distance"])
                own = pa.concat_tables([held[q], own]) if q in held else own
                held[q] = own.take(pc.sort_indices(own, [("distance", "ascending"), *[(t, "ascending") for t in tie]])[:k])
        for q, own in held.items():
            for part in own.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([q] * part.num_rows), *part.columns], names=form.fieldNames())

    if not asked:
        return vectors.drop("embedding").select(F.lit("").alias("query_id"), "*", F.lit(0.0).alias("distance"), F.lit(0).alias("place"), F.lit(0.0).alias("vector_score")).limit(0)
    hits = best(narrow.mapInArrow(run, form), k, [F.col("distance"), *[F.col(t) for t in tie]])
    rest = [c for c in vectors.columns if c not in ("embedding", *tie)]
    if rest:
        # At most k rows of each query.
        h, v = hits.hint("broadcast" if k * len(asked) <= FEW_HITS else "merge").alias("h"), vectors.select(*tie, *rest).alias("v")
        hits = v.join(h, [F.col(f"v.{t}").eqNullSafe(F.col(f"h.{t}")) for t in tie]).select("h.query_id", *[f"v.{c}" for c in (*tie, *rest)], "h.distance", "h.place")
        # Rows alike in what names them are all found by each of their hits.
        hits = best(hits.dropDuplicates(["query_id", "place"]), k, [F.col("place")])
    return hits.withColumn("vector_score", 1 - F.col("distance"))


#: Numbers of the vectors and of the queries that meet in one task, and distances, or numbers of candidates, that it holds at a time.
VECTOR_VALUES, QUERY_VALUES, STEP = 1 << 20, 1 << 19, 1 << 20
#: Distances are rounded to this many decimals, and equal ones ordered by id.
DECIMALS = 9
NEAR_FORM = "query_id bigint, id bigint, distance double"


def matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists that have ``dim`` numbers, and these numbers."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    same = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dim)
    flat = pc.list_flatten(lists if len(same) == len(lists) else lists.take(pa.array(same))).to_numpy(zero_copy_only=False)
    return same, flat.reshape(len(same), dim).astype(float)


def first_of(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k vectors nearest to each query: places of the queries, ids and squared distances, rounded; of equals the smaller ids. A product of matrices finds the candidates, with
    the error that it may have left in; their distances are then taken number by number, so the result is that of all differences."""
    none = np.zeros(0, int), ids[:0], np.zeros(0)
    if not len(ids) or not len(queries):
        return none
    out = [none]
    squares = np.einsum("ij,ij->i", vectors, vectors)
    known = squares[np.isfinite(squares)]
    error = 8 * (vectors.shape[1] + 8) * np.finfo(float).eps
    per = max(1, STEP // max(1, vectors.shape[1]))
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, len(queries), max(1, STEP // len(ids))):
            q = queries[at : at + max(1, STEP // len(ids))]
            d = squares - 2 * (q @ vectors.T)
            if len(ids) > k:
                slack = 1.01 * 10.0**-DECIMALS + error * (known.max(initial=0.0) + np.einsum("ij,ij->i", q, q))
                # What is no number is a candidate, and comes last.
                one, near = np.nonzero(~(d > (np.partition(d, k - 1, axis=1)[:, k - 1] + slack)[:, None]))
            else:
                one, near = (x.ravel() for x in np.indices(d.shape))
            exact = np.concatenate([((vectors[near[j : j + per]] - q[one[j : j + per]]) ** 2).sum(axis=1) for j in range(0, len(near), per)]).round(DECIMALS)
            order = np.lexsort((ids[near], exact, one))
            first = np.searchsorted(one, np.arange(len(q)))
            order = order[np.arange(len(order)) - first[one] < k]
            out.append((at + one[order], ids[near[order]], exact[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def in_groups(n: int, dim: int, values: int) -> int:
    """Groups for n rows of ``dim`` numbers, so that a group holds about ``values`` numbers."""
    return max(1, -(-n * max(1, dim) // values))


def sizes(rows: DataFrame) -> tuple[int, int]:
    """Number of vectors and the greatest length."""
    one = rows.agg(F.count("embedding"), F.max(F.size("embedding"))).first()
    return one[0], max(0, one[1] or 0)


def met(vectors: DataFrame, queries: DataFrame, meet, k: int) -> DataFrame:
    """The k nearest of all that ``meet``, a function of two Arrow tables, finds where groups of vectors meet groups of queries (both tables: v_no and q_no, the groups that meet)."""
    by = ["v_no", "q_no"]
    found = vectors.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(meet, NEAR_FORM)
    return best(found, k, [F.col("distance"), F.col("id")])


def near_table(query_ids: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query_ids, pa.int64()), "id": pa.array(ids, pa.int64()), "distance": pa.array(distances, pa.float64())})


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int = 10, id_: str = "id") -> DataFrame:
    """Exact k nearest vectors of each of many queries (both: id, embedding): query_id, id, distance, place. Vectors and queries are dealt to groups by hash, each group of vectors
    meets each group of queries in a task of its own, which gives its k best for each query, and the best of those are taken. So tasks grow in number, not in size."""
    ready = [x.select(F.col(id_).cast("long").alias("id"), "embedding").filter("embedding IS NOT NULL AND size(embedding) > 0") for x in (vectors, queries)]
    v_groups, q_groups = (in_groups(*sizes(x), most) for x, most in zip(ready, (VECTOR_VALUES, QUERY_VALUES), strict=True))
    group = lambda n: F.pmod(F.xxhash64("id", "embedding"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = ready[0].select("*", group(v_groups).alias("v_no"), all_of(q_groups).alias("q_no"))
    b = ready[1].select("*", group(q_groups).alias("q_no"), all_of(v_groups).alias("v_no"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for dim in np.unique(pc.list_value_length(right["embedding"]).to_numpy()):
            (some, v), (asked, q) = (matrix(x["embedding"], dim) for x in (left, right))
            one, ids, d = first_of(left["id"].to_numpy()[some], v, q, k)
            out.append(near_table(right["id"].to_numpy()[asked][one], ids, d))
        return pa.concat_tables(out) if out else near_table([], [], [])

    return met(a, b, meet, k)


def fused(words: DataFrame, vectors: DataFrame, k: int = 10, alpha: float = 0.6, beta: float = 0.4, file_filter: str | None = None, exclude_tests: bool = False, tags: Sequence[str] | None = None, tags_mode: str = "any") -> DataFrame:
    """Full join of both result lists on file and symbol; the least score of repeated hits; filters after the candidates were cut; weighted sum."""
    key = ["query_id", "file_path", "symbol_name"]
    w = words.groupBy(*key).agg(F.min("bm25_score").alias("bm25_score"), F.min("place").alias("word_place"), F.min_by("code", "place").alias("word_code"), F.min_by("docstring", "place").alias("word_docstring"))
    v = vectors.groupBy(*key).agg(F.min("vector_score").alias("vector_score"), F.min("place").alias("vector_place"), F.min_by("code", "place").alias("vector_code"), F.max_by("tags", "place").alias("tags"))
    both = w.join(v, key, "full")
    path = F.col("file_path")
    if file_filter:
        both = both.filter(path.contains(file_filter))
    if exclude_tests:
        both = both.filter(~F.lower(path).contains("test"))
    if tags:
        want, own = F.array(*[F.lit(t) for t in tags]), F.coalesce("tags", F.array().cast("array<string>"))
        both = both.filter(F.size(F.array_except(want, own)) == 0 if tags_mode == "all" else F.arrays_overlap(own, want))
    both = both.withColumns({"bm25_score": F.coalesce("bm25_score", F.lit(0.0)), "vector_score": F.coalesce("vector_score", F.lit(0.0))})
    both = both.withColumns({"hybrid_score": alpha * F.col("vector_score") + beta * F.col("bm25_score"), "code": F.coalesce("word_code", "vector_code"), "docstring": F.coalesce("word_docstring", F.lit(""))})
    # Equal scores keep the order of the lists, phrase hits first.
    order = [F.col("hybrid_score").desc(), F.col("word_place").asc_nulls_last(), F.col("vector_place").asc_nulls_last(), path]
    return best(both, k, order).select(*key, "code", "docstring", "bm25_score", "vector_score", "tags", "hybrid_score", "place")


def fused_rows(words: Sequence[Row | dict], vectors: Sequence[Row | dict], k: int = 10, alpha: float = 0.6, beta: float = 0.4, file_filter: str | None = None, exclude_tests: bool = False, tags: Sequence[str] | None = None, tags_mode: str = "any") -> list[dict]:
    """``fused`` for the two collected lists of one query, 2k rows each: at that size a plan costs more than the work."""
    both: dict[tuple, dict] = {}
    for rows, score, place, code in ((words, "bm25_score", "word_place", "word_code"), (vectors, "vector_score", "vector_place", "vector_code")):
        for r in sorted(rows, key=lambda r: r["place"]):
            own = both.setdefault((r["file_path"], r["symbol_name"]), {})
            own[score] = min(r[score], own.get(score, r[score]))
            own.setdefault(place, r["place"])
            # As min_by and max_by, which leave out nothing but rows without a place.
            own.setdefault(code, r["code"])
            if rows is words:
                own.setdefault("docstring", r["docstring"])
            else:
                own["tags"], own["metadata"] = r["tags"], r["metadata"] if "metadata" in r else None
    out = []
    for (path, name), x in both.items():
        own = x.get("tags")
        held = [t in (own or ()) for t in tags or ()]
        if (file_filter and file_filter not in path) or (exclude_tests and "test" in path.lower()) or (tags and not (all(held) if tags_mode == "all" else any(held))):
            continue
        w, v = x.get("bm25_score", 0.0), x.get("vector_score", 0.0)
        code = x["word_code"] if x.get("word_code") is not None else x.get("vector_code")
        row = {"file_path": path, "symbol_name": name, "code": code, "docstring": x.get("docstring") or "", "bm25_score": w, "vector_score": v, "tags": own, "metadata": x.get("metadata"), "hybrid_score": alpha * v + beta * w}
        last = 1 << 60
        out.append(((-row["hybrid_score"], x.get("word_place", last), x.get("vector_place", last), path), row))
    return [row for _, row in sorted(out, key=lambda o: o[0])[:k]]


def hybrid_search(docs: DataFrame, vectors: DataFrame, phrases: dict[str, str], queries: dict[str, Sequence[float]], k: int = 10, workspace: str | None = None, language: str | None = None, **how) -> DataFrame:
    words = bm25_search(docs, phrases, workspace, language, 2 * k)
    near = nearest(vectors, queries, 2 * k, ("file_path", "symbol_name", "id"), workspace, language)
    return fused(words, near, k, **how)
