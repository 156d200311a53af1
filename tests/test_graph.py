import random

import pytest

from lodestone.operators import graph, stats, symbols

EDGE = "workspace_id string, source_symbol string, target_symbol string"


def edges(spark, *pairs):
    return spark.createDataFrame([("w", *p.split(">")) for p in pairs], EDGE)


def test_breadth_first(spark):
    e = edges(spark, "a>b", "b>c", "c>d", "a>c")
    entry = spark.createDataFrame([("w", "a"), ("w", "zz")], "workspace_id string, entry string")
    got = {r.symbol: (r.depth, r.parent) for r in graph.breadth_first(e, entry, 2).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "c")}
    chain = edges(spark, "a>b", "b>c", "c>d")
    assert {r.symbol for r in graph.breadth_first(chain, entry, 2).collect()} == {"a", "b", "c"}
    loop = edges(spark, "a>b", "b>a")
    assert {r.symbol: r.depth for r in graph.breadth_first(loop, entry).collect()} == {"a": 0, "b": 1}


@pytest.mark.parametrize("pairs, found", [(["a>b", "b>a"], ["aba"]), (["a>b", "b>c", "c>a"], ["abca"]), (["a>b", "b>c"], []), (["a>a", "a>b"], ["aa"]), (["b>c", "c>b", "c>d", "d>b", "x>b"], ["bcb", "bcdb"])])
def test_cycles(spark, pairs, found):
    assert sorted("".join(r.path) for r in graph.cycles(edges(spark, *pairs)).collect()) == found


@pytest.mark.parametrize("n", [9, 40])
def test_long_cycles(spark, n):
    ring = [f"m{k:02}" for k in range(n)]
    e = edges(spark, *(f"{a}>{b}" for a, b in zip(ring, ring[1:] + ring[:1], strict=True)), "m03>out", "in>m00")
    assert [r.path for r in graph.cycles(e).collect()] == [[*ring, "m00"]]
    assert graph.cycles(e, 8).count() == 0


def test_every_edge_on_a_cycle_is_reported(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 4)
    rng = random.Random(3)
    pairs = {(f"s{rng.randrange(30):02}", f"s{rng.randrange(30):02}") for _ in range(55)}
    reach = {a: {b for x, b in pairs if x == a} for x in pairs for a in x}
    for _ in reach:
        reach = {a: to | {c for b in to for c in reach[b]} for a, to in reach.items()}
    paths = [r.path for r in graph.cycles(edges(spark, *(f"{a}>{b}" for a, b in pairs))).collect()]
    steps = [set(zip(p, p[1:], strict=False)) for p in paths]
    assert set().union(*steps) == {(a, b) for a, b in pairs if a in reach[b]} and len({tuple(p) for p in paths}) == len(paths)
    assert all(p[0] == p[-1] == min(p) and len(set(p)) == len(p) - 1 and s <= pairs for p, s in zip(paths, steps, strict=True))


def brute_components(pairs):
    reach = {x: {x} for p in pairs for x in p}
    while True:
        more = {a: to | {b for x, b in pairs if x in to} for a, to in reach.items()}
        if more == reach:
            return {a: min(b for b in to if a in reach[b]) for a, to in reach.items()}
        reach = more


@pytest.mark.parametrize("n, m", [(30, 34), (60, 66)])
def test_components_equal_brute_force(spark, n, m):
    """By tasks and by tables: random graphs with self-loops, chains and rings beside each other."""
    from lodestone.operators import components

    rng = random.Random(n)
    pairs = {(f"s{rng.randrange(n):02}", f"s{rng.randrange(n):02}") for _ in range(m)}
    pairs |= {(f"r{k}", f"r{(k + 1) % 7}") for k in range(7)} | {(f"p{k}", f"p{k + 1}") for k in range(9)} | {("p9", "s00"), ("s00", "q0"), ("q0", "q1"), ("q1", "s00"), ("x", "x"), ("a", "b"), ("b", "a")}
    want = brute_components(pairs)
    e = edges(spark, *(f"{a}>{b}" for a, b in pairs))
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    for small in (0, 1000):
        got = components.components(e, small).collect()
        assert {r.symbol: r.component for r in got} == want and len(got) == len(want) and all(r.size == sizes[r.component] for r in got)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from lodestone.operators import components

    rounds = []
    real = components.Steps.keep
    monkeypatch.setattr(components.Steps, "keep", lambda *a: rounds.append(1) or real(*a))
    n = 5000
    pairs = [("w", f"c{k:05}", f"c{k + 1:05}") for k in range(n)] + [("w", f"c{n:05}", "d0"), ("w", "d0", "d1"), ("w", "d1", f"c{n:05}")]
    got = components.components(spark.createDataFrame(pairs, EDGE), 0).filter("size > 1").collect()
    assert {(r.symbol, r.component, r.size) for r in got} == {(s, f"c{n:05}", 3) for s in (f"c{n:05}", "d0", "d1")} and len(rounds) < 60


def test_bins(spark):
    from pyspark.sql import functions as F

    ranges = spark.createDataFrame([(a, b) for a in range(0, 40) for b in range(a - 1, 44)] + [(1, 2_000_000_000)], "a int, b int")
    rows = ranges.select("a", "b", symbols.bins_of_range(F.col("a"), F.col("b")).alias("bins")).collect()
    for r in rows[:-1]:
        lines = [n for x in r.bins for n in range(x.n << x.size, (x.n + 1) << x.size)]
        assert sorted(lines) == list(range(r.a, r.b + 1)) and len(r.bins) <= 2 * max(1, (r.b - r.a + 1).bit_length())
    assert 1 <= len(rows[-1].bins) <= 62


def test_containment_in_a_large_file(spark):
    """200,000 symbols of one file: pairs of classes and methods, and symbols around lines, without meeting all with all."""
    from pyspark.sql import functions as F

    k = spark.range(200_000)
    chunks = k.select(F.lit("w").alias("workspace_id"), F.when(F.col("id") % 4 == 0, "class").otherwise("method").alias("type"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("p").alias("package"), F.lit("/f").alias("file_path"), (F.col("id") * 3 + 1).cast("int").alias("start_line"), F.when(F.col("id") % 4 == 0, F.col("id") * 3 + 12).otherwise(F.col("id") * 3 + 3).cast("int").alias("end_line"))
    found = symbols.with_methods(chunks.filter("type = 'class'"), chunks)
    assert found.agg(F.count("*"), F.min(F.size("methods")), F.max(F.size("methods"))).first() == (50_000, 3, 3)
    points = k.select(F.lit("w").alias("workspace_id"), F.lit("/f").alias("file_path"), (F.col("id") * 3 + 2).cast("int").alias("line"))
    got = symbols.enclosing(chunks, points)
    assert got.count() == 350_000 and got.filter("depth = 1 AND type = 'class'").count() == 50_000


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGE)
    assert graph.cycles(none).count() == 0 and stats.graph_summary(none).count() == 0 and graph.adjacency(none).count() == 0


def test_adjacency_and_summary(spark):
    e = edges(spark, "a>b", "a>c", "b>c")
    assert {r.symbol: r.linked for r in graph.adjacency(e).collect()} == {"a": ["b", "c"], "b": ["c"]}
    assert {r.symbol: r.linked for r in graph.adjacency(e, reverse=True).collect()} == {"b": ["a"], "c": ["a", "b"]}
    s = stats.graph_summary(e).first()
    assert (s.total_symbols, s.total_dependencies, s.avg_dependencies, s.most_imported, s.most_imported_count, s.most_dependent) == (3, 3, 1.0, "c", 2, "a")
    assert [(r.symbol, r.import_count) for r in stats.most_imported(e).orderBy("place").collect()] == [("c", 2), ("b", 1)]
    assert [(r.symbol, r.dependency_count) for r in stats.most_dependent(e, 1).collect()] == [("a", 2)]


CHUNK = "workspace_id string, type string, name string, package string, file_path string, start_line int, end_line int"
CHUNKS = [
    ("w", "function", "calculate_sum", "m", "/project/math_utils.py", 5, 15), ("w", "class", "Calculator", "m", "/project/math_utils.py", 20, 80), ("w", "method", "add", "m.Calculator", "/project/math_utils.py", 25, 40),
    ("w", "method", "subtract", "m.Calculator", "/project/math_utils.py", 45, 60), ("w", "function", "validate_input", "v", "/project/validators.py", 1, 10), ("w", "function", "_hidden", "v", "/project/validators.py", 12, 13),
]


def test_symbols(spark):
    c = spark.createDataFrame(CHUNKS, CHUNK)
    assert [m["name"] for m in symbols.with_methods(symbols.first_type(c, "w", "Calculator"), c).first().methods] == ["add", "subtract"]
    points = spark.createDataFrame([("w", "/project/math_utils.py", n) for n in (30, 10, 1000)], "workspace_id string, file_path string, line int")
    rows = symbols.enclosing(c, points).orderBy("line", "depth").collect()
    assert [(r.line, r.name) for r in rows] == [(10, "calculate_sum"), (30, "add"), (30, "Calculator")]
    assert [r.name for r in symbols.package_exports(c, "w", "validators").collect()] == ["validate_input"]
    assert symbols.first_function(c, "w", "add").first().type == "method" and symbols.first_function(c, "w", "Calculator").first() is None
    e = edges(spark, "Calculator>calculate_sum", "main>Calculator", "main>validate_input")
    asked = spark.createDataFrame([("w", "Calculator"), ("w", "main")], "workspace_id string, symbol string")
    assert [(r.source_symbol, r.file_path) for r in symbols.callers(e, c, asked).collect()] == [("main", None)]
    assert {(r.symbol, r.target_symbol, r.file_path) for r in symbols.targets(e, c, asked).collect()} == {("Calculator", "calculate_sum", "/project/math_utils.py"), ("main", "Calculator", "/project/math_utils.py"), ("main", "validate_input", "/project/validators.py")}
    assert symbols.dependencies(e, "w", "Calculator").count() == 2


def test_stats(spark):
    c = spark.createDataFrame(CHUNKS, CHUNK)
    now = stats.current(c).first()
    assert (now.files, now.total_lines, now.total_symbols) == (2, 116, 6)
    assert {r.file_path: (r.functions, r.classes, r.methods) for r in stats.per_file(c).collect()}["/project/math_utils.py"] == (1, 1, 2)
    files = c.select("workspace_id", "file_path").distinct()
    assert [(r.language, r.files, r.functions) for r in stats.per_language(files, c).collect()] == [("python", 2, 3)]
    nodes = {(r.parent, r.name): (r.is_file, r.symbols) for r in stats.tree_nodes(files, c).collect()}
    assert nodes == {("", "project"): (False, 0), ("project", "math_utils.py"): (True, 4), ("project", "validators.py"): (True, 2)}
    scans = spark.sql("SELECT 'w' AS workspace_id, * FROM VALUES (2L, 5L, timestamp'2024-01-01 00:00:00', 1), (3L, 7L, timestamp'2024-01-01 00:00:02', 2) AS t(files_scanned, chunks_created, ts, seq)")
    d = stats.scan_delta(scans).first()
    assert (d.files_delta, d.chunks_delta, d.time_span_ms) == (1, 2, 2000)
    assert stats.scan_delta(scans.limit(1)).count() == 0
