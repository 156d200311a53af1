"""Ranked retrieval on a small corpus, and phrase BM25 against SQLite's own."""

import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import search

ROWS = [
    (1, "w1", "/workspace/data_processor.py", "process_data", "def process_data(x): return x", "Process the data.", "python", ["data", "processing"]),
    (2, "w1", "/workspace/api/user_api.py", "fetch_user", "def fetch_user(id): ...", "Fetch a user.", "python", ["user", "api"]),
    (3, "w1", "/workspace/tests/test_processor.py", "test_process", "def test_process(): assert process_data", "", "python", ["test"]),
    (4, "w2", "/workspace/handler/request.js", "handle_request", "function handle_request(r) { process data }", "café", "javascript", ["handler"]),
]
SCHEMA = "id int, workspace_id string, file_path string, symbol_name string, code string, docstring string, language string, tags array<string>"


@pytest.fixture(scope="module")
def docs(spark):
    return search.tokenized(spark.createDataFrame(ROWS, SCHEMA)).cache()


def sqlite_ranks(rows, phrase):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(workspace_id, file_path, symbol_name, code, docstring)")
    db.executemany("INSERT INTO t(rowid, workspace_id, file_path, symbol_name, code, docstring) VALUES (?,?,?,?,?,?)", [r[:6] for r in rows])
    quoted = '"' + phrase.replace('"', " ") + '"'
    return dict(db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (quoted,)).fetchall())


@pytest.mark.parametrize("phrase", ["process_data", "process", "user", "workspace", "w1", "cafe", "nothing", "def", "process data}"])
def test_bm25_is_that_of_sqlite(docs, phrase):
    got = {r.id: r["rank"] for r in search.bm25(docs, {"q": phrase}).collect()}
    want = sqlite_ranks(ROWS, phrase)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c_d", "E"]), max_size=8).map(" ".join), min_size=1, max_size=6), st.lists(st.sampled_from(["a", "b", "c", "d", "e"]), min_size=1, max_size=3).map(" ".join))
def test_bm25_property(spark, texts, phrase):
    rows = [(k, "w", f"/f{k}", "s", t, "", "python", []) for k, t in enumerate(texts, 1)]
    got = {r.id: r["rank"] for r in search.bm25(search.tokenized(spark.createDataFrame(rows, SCHEMA)), {"q": phrase}).collect()}
    want = sqlite_ranks(rows, phrase)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)


def test_scores_and_filters(docs):
    hits = {r.id: r.bm25_score for r in search.bm25_search(docs, {"q": "process"}, "w1").collect()}
    assert hits and max(hits.values()) == 1.0 and (len(hits) == 1 or min(hits.values()) == 0.0)
    assert [r.id for r in search.bm25_search(docs, {"q": "process"}, None, "javascript").collect()] == [4]
    assert search.bm25_search(docs, {"q": "!!"}, "w1").count() == 0
    assert search.bm25_search(docs.limit(0), {"q": "a"}, "w1").count() == 0


def vectors(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("embedding", F.array_repeat(F.lit(0.1).cast("float"), 768))


def test_nearest(spark):
    rows = search.nearest(vectors(spark), {"q": [0.2] * 768}, 2, workspace="w1", language="Python").collect()
    assert [r.place for r in sorted(rows, key=lambda r: r.place)] == [1, 2]
    assert all(r.vector_score == pytest.approx(-6.68, abs=1e-4) for r in rows)


def test_hybrid(spark, docs):
    v = vectors(spark)
    full = search.hybrid_search(docs, v, {"q": "process_data"}, {"q": [0.1] * 768}, 10, "w1").orderBy("place").collect()
    assert full[0].symbol_name == "process_data" and len(full) == 3
    assert all(r.hybrid_score == pytest.approx(0.6 * r.vector_score + 0.4 * r.bm25_score) for r in full)
    names = lambda **how: {r.symbol_name for r in search.hybrid_search(docs, v, {"q": "process_data"}, {"q": [0.1] * 768}, 10, "w1", **how).collect()}
    assert "test_process" not in names(exclude_tests=True)
    assert names(file_filter="api") == {"fetch_user"}
    assert names(tags=["data", "processing"], tags_mode="all") == {"process_data"}
    assert names(tags=["test", "user"]) == {"test_process", "fetch_user"}
    assert search.hybrid_search(docs, v, {"q": "process_data"}, {"q": [0.1] * 768}, 2, "w1").count() == 2


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["x", "test_y"]), st.integers(0, 4), st.sampled_from(["c1", "c2"])), max_size=6), st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["x", "test_y", "z"]), st.integers(0, 4), st.sampled_from([None, ["t"], ["t", "u"]])), max_size=6),
    st.sampled_from([None, "a"]), st.booleans(), st.sampled_from([None, ["t"], ["t", "u"]]), st.sampled_from(["any", "all"]),
)
def test_fused_rows_are_those_of_the_plan(spark, words, vectors, file_filter, exclude_tests, tags, mode):
    from pyspark.sql import Row

    w = [Row(query_id="q", file_path=f, symbol_name=s, bm25_score=n / 4, place=k, code=c, docstring=f"d{k}") for k, (f, s, n, c) in enumerate(words, 1)]
    v = [Row(query_id="q", file_path=f, symbol_name=s, vector_score=n / 4, place=k, code=f"v{k}", tags=t) for k, (f, s, n, t) in enumerate(vectors, 1)]
    frames = [spark.createDataFrame(x, schema) for x, schema in ((w, "query_id string, file_path string, symbol_name string, bm25_score double, place int, code string, docstring string"), (v, "query_id string, file_path string, symbol_name string, vector_score double, place int, code string, tags array<string>"))]
    how = {"k": 3, "file_filter": file_filter, "exclude_tests": exclude_tests, "tags": tags, "tags_mode": mode}
    plan = [{k: r[k] for k in r.asDict() if k not in ("query_id", "place")} for r in search.fused(*frames, **how).orderBy("place").collect()]
    assert search.fused_rows(w, v, **how) == plan


def test_nearest_meets_all_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (500, 4)).astype(float)
    rows = [(f"w{k % 2}", f"f{k % 7}", f"s{k}", k, v[k].tolist()) for k in range(500)] + [("w0", "f", "null", 900, None), ("w0", "f", "short", 901, [1.0])]
    df = spark.createDataFrame(rows, "workspace_id string, file_path string, symbol_name string, id long, embedding array<float>").repartition(5)
    asked = {"a": [1.0, 1.0, 1.0, 1.0], "b": [0.0, 2.0, 0.0, 2.0]}
    got = search.nearest(df, asked, 9, ("file_path", "symbol_name", "id")).collect()
    for q, x in asked.items():
        want = sorted(((float(((v[k] - x) ** 2).sum()), f"f{k % 7}", f"s{k}", k) for k in range(500)))[:9]
        assert sorted((r.distance, r.file_path, r.symbol_name, r.id) for r in got if r.query_id == q) == want
        assert [r.workspace_id for r in got if r.query_id == q and r.id == want[0][3]] == [f"w{want[0][3] % 2}"]
    assert search.nearest(df, {}, 9).count() == 0 and search.nearest(df, asked, 3, workspace="none").count() == 0
    assert search.nearest(df, {"a": asked["a"]}, 9, ("id",), "w1").filter("workspace_id = 'w0'").count() == 0


# Postings


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["w1", "w2", None]), st.lists(st.sampled_from(["a", "b", "c_d", "E", "|", "é"]), max_size=9).map(" ".join), st.one_of(st.none(), st.just("b a"))), min_size=1, max_size=12), st.lists(st.sampled_from(["a", "b", "c", "d", "e"]), min_size=1, max_size=3).map(" ".join), st.sampled_from([1, 4095, 5000]))
def test_postings_rank_as_documents_do(spark, texts, phrase, step):
    from lodestone.operators import postings

    rows = [(k * step, w, "/f b", "s", t, d, "python", []) for k, (w, t, d) in enumerate(texts)]
    docs = search.tokenized(spark.createDataFrame(rows, SCHEMA.replace("id int", "id long")))
    asked = {"q": phrase, "two": "a b", "none": "zz", "empty": "!"}
    want = {(r.query_id, r.id): (r.tf, r["rank"]) for r in search.bm25(docs, asked).collect()}
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    found = postings.hits(postings.build(docs, keys=["workspace_id"]), asked, ["workspace_id"])
    got = {(r.query_id, r.number): (r.tf, r["rank"]) for r in postings.bm25(found, F.lit(total.n), F.lit(total["mean"])).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)
    assert {(r.number, r.workspace_id) for r in found.collect()} <= {(r[0], r[1]) for r in rows}


def test_postings_of_blocks_in_parts(spark, monkeypatch):
    """A block whose documents are read in several portions has several rows for a term."""
    from lodestone.operators import postings

    docs = search.tokenized(spark.createDataFrame([(k, "w", "f", "s", "to be or not to be" if k % 2 else "be to", "", "python", []) for k in range(300)], SCHEMA.replace("id int", "id long")).repartition(3))
    monkeypatch.setattr(postings, "PORTION", 200)
    rows = postings.build(docs).cache()
    assert rows.filter("term = 'be'").count() > 3 and rows.select("block").distinct().count() == 1
    assert sorted((r.number, r.tf) for r in postings.hits(rows, {"q": "to be"}).collect()) == [(k, 2) for k in range(1, 300, 2)]
    assert postings.hits(rows.limit(0), {"q": "to"}).count() == 0 and postings.hits(rows, {}).count() == 0


# Inverted files


def test_lists_of_vectors(spark):
    import numpy as np

    from lodestone.operators import vectors as ivf

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 2
    data = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.7
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(5000, None), (5001, [1.0, 2.0]), (5002, [])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5).cache()
    asked = v.filter("id % 20 = 0")
    centroids = ivf.fit(v, values=1000 * 16)
    lists = ivf.assigned(v, centroids).cache()
    assert lists.count() == 4003 and {r.id for r in lists.filter("list_no = -1").collect()} == {5000, 5001, 5002} and 40 <= len(centroids) <= 63
    exact = {(r.query_id, r.place): (r.id, r.distance) for r in search.nearest_many(v.filter("size(embedding) = 16"), asked.filter("size(embedding) = 16"), 10).collect()}
    assert {(r.query_id, r.place): (r.id, r.distance) for r in ivf.nearest_many(lists, centroids, asked, 10).collect()} == exact
    found = {(r.query_id, r.id) for r in ivf.nearest_many(lists, centroids, asked, 10, probes=8).collect()}
    want = {(q, i) for (q, _), (i, _) in exact.items()}
    assert len(found & want) / len(want) >= 0.95
    one = {"q": data[60].tolist()}
    plain = [(r.id, r.distance) for r in search.nearest(v, one, 10).orderBy("place").collect()]
    assert [(r.id, r.distance) for r in ivf.nearest(lists, centroids, one, 10).orderBy("place").collect()] == plain
    few = [r.id for r in ivf.nearest(lists, centroids, one, 10, probes=6).orderBy("place").collect()]
    assert len(set(few) & {i for i, _ in plain}) >= 9
    assert ivf.nearest(lists, centroids, {"q": [1.0]}, 10).count() == 0
    empty = v.limit(0)
    assert len(ivf.fit(empty)) == 0 and ivf.assigned(empty, ivf.fit(empty)).count() == 0 and ivf.nearest_many(lists, ivf.fit(empty), asked).count() == 0


def brute_nearest(rows, asked, k):
    """Places one by one: (query, place): (id, distance)."""
    out = {}
    for q, x in asked:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), 9), i) for i, v in rows if v is not None and len(v) == len(x) > 0)
        out |= {(q, place): (i, d) for place, (d, i) in enumerate(near[:k], 1)}
    return out


def test_nearest_of_many_in_bounded_groups(spark, monkeypatch):
    """Groups that meet don't grow with the table; vectors of several lengths, equal ones, far ones and what is no number included."""
    import numpy as np

    r = np.random.default_rng(6)
    rows = [(k, r.integers(0, 3, 2 + k % 2).astype(float).tolist()) for k in range(400)] + [(k, (1e6 + r.normal(size=3)).astype("f4").tolist()) for k in range(400, 500)] + [(501, None), (502, []), (503, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = [x for x in rows[:500] if x[0] % 20 == 0]
    want = brute_nearest(rows[:500], asked, 7)
    near = lambda: {(x.query_id, x.place): (x.id, x.distance) for x in search.nearest_many(v, v.filter("id % 20 = 0"), 7).collect()}
    assert near() == want
    most = []
    met = getattr(search, "met", None)
    monkeypatch.setattr(search, "met", lambda a, b, *how: most.append([x.groupBy("v_no", "q_no").count().agg(F.max("count")).first()[0] for x in (a, b)]) or met(a, b, *how), raising=False)
    monkeypatch.setattr(search, "VECTOR_VALUES", 50 * 3, raising=False)
    monkeypatch.setattr(search, "QUERY_VALUES", 10 * 3, raising=False)
    assert near() == want and most[0][0] < 100 and most[0][1] < 21
    assert search.nearest_many(v.limit(0), v, 7).count() == 0 and search.nearest_many(v, v.limit(0), 7).count() == 0


def test_lists_meet_by_shelf(spark, monkeypatch):
    """A query's candidates are k for each shelf, however many lists there are; a list larger than a shelf is dealt over several."""
    import numpy as np

    from lodestone.operators import vectors as ivf

    data = np.random.default_rng(5).normal(size=(900, 8)).astype("f4").astype(float)
    data[300:600] = data[300]
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = v.filter("id % 20 = 0")
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 5)
    centroids = ivf.fit(v)
    lists = ivf.assigned(v, centroids).cache()
    found, best = [], search.best
    monkeypatch.setattr(search, "best", lambda rows, *how: found.append(rows) or best(rows, *how))
    got = ivf.nearest_many(lists, centroids, asked, 5).collect()
    assert {(r.query_id, r.place): (r.id, r.distance) for r in got} == want
    assert len(centroids) == 30 and found[-1].count() == 5 * 45
    monkeypatch.setattr(search, "VECTOR_VALUES", 100 * 8, raising=False)
    monkeypatch.setattr(search, "QUERY_VALUES", 20 * 8, raising=False)
    assert {(r.query_id, r.place): (r.id, r.distance) for r in ivf.nearest_many(lists, centroids, asked, 5).collect()} == want
    assert {(r.query_id, r.place): (r.id, r.distance) for r in ivf.nearest_many(lists, centroids, asked, 5, probes=29).collect()}.keys() == want.keys()
    first, parts = ivf.shelves({0: 40, 1: 50, 2: 250, 3: 100, 4: 1}, 6, 100)
    assert first.tolist() == [0, 0, 1, 4, 5, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1]


@pytest.mark.parametrize("phrase, k", [("process", 3), ("process data", 2), ("workspace", 10), ("nothing", 5)])
def test_hybrid_equals_brute_force(spark, docs, phrase, k):
    """Ranks by SQLite, distances one by one, both lists cut to 2k and put together in plain Python."""
    import random

    rng = random.Random(len(phrase))
    vectors = {r[0]: [float(rng.randrange(-4, 5)) / 4 for _ in range(6)] for r in ROWS}
    query = [0.5, -0.25, 0.0, 1.0, 0.25, -1.0]
    v = spark.createDataFrame(ROWS, SCHEMA).join(spark.createDataFrame(list(vectors.items()), "id int, embedding array<float>"), "id")
    got = [(r.file_path, r.symbol_name, round(r.bm25_score, 6), round(r.vector_score, 6), round(r.hybrid_score, 6)) for r in search.hybrid_search(docs, v, {"q": phrase}, {"q": query}, k).orderBy("place").collect()]
    by_id = {r[0]: r for r in ROWS}
    ranks = sorted((rank, by_id[i][2], by_id[i][3], i) for i, rank in sqlite_ranks(ROWS, phrase).items())[: 2 * k]
    span = (ranks[-1][0] - ranks[0][0] or 1.0) if ranks else 1.0
    words = {i: 1 - (rank - ranks[0][0]) / span for rank, _, _, i in ranks}
    near = sorted((sum((a - b) ** 2 for a, b in zip(vectors[i], query, strict=True)), r[2], r[3], i) for i, r in by_id.items())[: 2 * k]
    scores = {i: 1 - d for d, _, _, i in near}
    last, at, to = 99, [x[3] for x in ranks], [x[3] for x in near]
    place = lambda i, x: x.index(i) if i in x else last
    order = sorted(words.keys() | scores.keys(), key=lambda i: (-(0.6 * scores.get(i, 0) + 0.4 * words.get(i, 0)), place(i, at), place(i, to), by_id[i][2]))[:k]
    assert got == [(by_id[i][2], by_id[i][3], round(words.get(i, 0.0), 6), round(scores.get(i, 0.0), 6), round(0.6 * scores.get(i, 0) + 0.4 * words.get(i, 0), 6)) for i in order]


def test_words_are_hashed_once(monkeypatch):
    """Vectors of hashed words are those of all words one by one, but a word is hashed once."""
    import hashlib
    from types import SimpleNamespace

    import numpy as np

    from lodestone.operators import embed

    def slow(text):
        out = np.zeros(32, np.float32)
        for word in embed.WORD.findall(text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % 32] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out)
        return (out / (norm or 1)).tolist()

    calls, texts = [], ["Hashed words, hashed é日 words_again " * 50, "words", "", "?!"]
    monkeypatch.setattr(embed, "hashlib", SimpleNamespace(blake2b=lambda *a, **b: calls.append(a) or hashlib.blake2b(*a, **b)))
    assert embed.HashEmbedder(32)(texts) == [slow(t) for t in texts]
    assert len(calls) <= 4
