"""Write path, tools and watching on a small tree."""

import json
import time

import pytest

from lodestone.api import Tools
from lodestone.config import Config, Index, Tagging, Watcher
from lodestone.operators import embed
from lodestone.sources import tree


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "__pycache__").mkdir()
    (root / "pyproject.toml").write_text("[project]\n")
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "a.py").write_text("import os\n\nclass Calc:\n    def add(self, a, b):\n        return a + b\n\ndef helper():\n    return Calc()\n")
    (root / "b.md").write_text("# Title\n")
    (root / "__pycache__" / "x.py").write_text("def no(): pass\n")
    (root / "skip.bin").write_text("x")
    return root


@pytest.fixture
def tools(spark, tmp_path):
    return Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx"))))


def test_index_twice_and_change(tools, project):
    first = json.loads(tools.index_project(str(project), format="json"))
    assert first["files_scanned"] == 6 and first["files_indexed"] == 3 and first["total_chunks"] == 5 and first["languages"] == {"config": 1, "doc": 1, "python": 1}
    ws = first["workspace_id"]
    again = json.loads(tools.index_project(str(project), format="json"))
    assert again["files_indexed"] == 0 and again["total_chunks"] == 0
    (project / "b.md").write_text("# New\nline\n")
    assert json.loads(tools.index_project(str(project), format="json"))["files_indexed"] == 1
    (project / "b.md").unlink()
    tools.index_project(str(project))
    assert not [r for r in tools.own("files", ws).collect() if r.file_path.endswith("b.md")]
    assert json.loads(tools.index_project(str(project), force_reindex=True, format="json"))["files_indexed"] == 2
    before = {t: sorted(map(str, tools.store.table(t).drop("embedding").collect())) for t in ("chunks", "files", "deps")}
    tools.store.compact()
    assert {t: len(v) for t, v in tools.store.current()["tables"].items() if t in before} == {t: 1 for t in before}
    assert {t: sorted(map(str, tools.store.table(t).drop("embedding").collect())) for t in before} == before
    stats = json.loads(tools.project_stats(ws, "json"))
    assert len(stats["scan_history"]) == 5 and stats["current"]["total_symbols"] == 4 and stats["delta"]["chunks_delta"] == -1


def test_tools(tools, project):
    ws = json.loads(tools.index_project(str(project), format="json"))["workspace_id"]
    path = str((project / "pkg" / "a.py").resolve())
    f = json.loads(tools.get_function_details("add", ws, "json"))
    assert f["kind"] == "method" and f["namespace"] == "pkg.a.Calc" and f["location"]["start_line"] == 4
    assert "helper, function" in tools.get_function_details("helper", ws)
    t = json.loads(tools.find_type_definition("Calc", ws, "json"))
    assert [m["name"] for m in t["methods"]] == ["add"] and t["full_name"] == "pkg.a.Calc"
    with pytest.raises(ValueError):
        tools.get_function_details("nothing", ws)
    with pytest.raises(ValueError):
        tools.find_type_definition("nothing", ws)
    with pytest.raises(ValueError):
        tools.find_implementations("x", "sideways", ws)
    assert json.loads(tools.find_implementations("os", "callers", ws, "json"))["results"] == [{"source_symbol": path, "file_path": None}]
    assert [s["name"] for s in json.loads(tools.get_code_context(path, 5, ws, "json"))["enclosing_symbols"]] == ["add", "Calc"]
    assert "not inside" in tools.get_code_context(path, 999, ws)
    assert json.loads(tools.list_package_exports("pkg", ws, "json"))["exports"] == ["Calc", "add", "helper"]
    tree = json.loads(tools.file_tree(ws, output_format="json"))["tree"]
    assert "a.py (3 symbols)" in tree and "pkg/" in tree
    m = json.loads(tools.project_map(ws, "detailed", "json"))
    assert m["summary"]["total_files"] == 3 and m["summary"]["stats_by_language"]["python"] == {"files": 1, "functions": 1, "classes": 1, "methods": 1}
    assert "a.py (3 symbols)" in tools.project_map(ws, "tree") and "python: 1 files" in tools.project_map(ws) and "pkg/a.py: python" in tools.project_map(ws, "detailed")
    g = json.loads(tools.dependency_graph(ws, path, output_format="json"))
    assert g["edges"] == [[path, "os"]] and g["entry_point_graph"]["depths"] == {path: 0, "os": 1}
    assert "Symbols:" in tools.dependency_graph(ws) and tools.detect_cycles(ws) == []
    hits = json.loads(tools.search_code("helper", workspace_id=ws, format="json"))
    assert hits[0]["symbol_name"] == "helper" and hits[0]["hybrid_score"] == pytest.approx(0.6 * hits[0]["vector_score"] + 0.4 * hits[0]["bm25_score"])
    about = hits[0]["metadata"]
    # The eleven fixed entries, the chunker's and the tags.
    assert {k: about[k] for k in about if k != "meta_tags"} == {
        "type": "function", "name": "helper", "package": "pkg.a", "language": "python", "file_path": path, "start_line": 7, "end_line": 8, "selection_start": 7, "selection_end": 7, "signature": "def helper()", "docstring": "",
        "meta_is_async": False, "meta_visibility": "public",
    } and "lang:python" in json.loads(about["meta_tags"])
    assert tools.search_code("zzz", workspace_id="none").startswith("Nothing") and "helper" in tools.search_code("helper", workspace_id=ws)
    assert tools.diagnose()["tables"]["status"] == "ok" and tools.get_model_status()["status"] == "error"
    assert json.loads(tools.reindex_file(path, ws, "json"))["chunks_created"] == 3
    assert "Total symbols" in tools.project_stats(ws) and "No public exports" in tools.list_package_exports("none", ws) and "Calc" in tools.find_type_definition("Calc", ws)
    assert "deleted" in tools.delete_project(ws)
    with pytest.raises(ValueError):
        tools.delete_project(ws)
    with pytest.raises(ValueError):
        tools.index_project("/no/such/folder")
    assert "emptied" in tools.clear_index()


def test_failing_files_and_model_tags(spark, tmp_path, project):
    (project / "bad.py").write_text("def (\n")
    (project / "big.py").write_text("x = 1\n" * 400_000)
    calls = tmp_path / "calls"

    def tagger(path, preview):
        with calls.open("a") as f:
            f.write(path + "\n")
        return '{"tags": ["framework:flask", "framework:odd"]}'

    t = Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx"), max_file_size_mb=1.0), tagging=Tagging(h2_enabled=True)), tagger=tagger)
    r = json.loads(t.index_project(str(project), format="json"))
    assert r["files_indexed"] == 3 and r["errors"] == []
    rows = t.store.table("chunks").filter("name = 'helper'").collect()
    assert rows[0].tags == ["framework:flask", "lang:python"]
    asked = len(calls.read_text().splitlines())
    assert t.store.table("tag_cache").count() == asked > 0
    t.index_project(str(project), force_reindex=True)
    assert len(calls.read_text().splitlines()) == asked


def test_embedding_fallback():
    class Service:
        def __call__(self, texts):
            if len(texts) > 1:
                raise embed.BadRequest("no")
            if texts[0] == "bad":
                raise ValueError("no")
            return [[1.0, 2.0]]

    assert embed.embed_batch(Service(), ["a", "bad"]) == [[1.0, 2.0], [0.0, 0.0]]
    assert embed.embed_batch(Service(), []) == []
    with pytest.raises(ValueError):
        embed.embed_batch(lambda t: [[1.0]], ["a", "b"])


def test_watching(spark, tmp_path, project):
    t = Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx")), watcher=Watcher(debounce_ms=100)))
    ws = json.loads(t.index_project(str(project), format="json"))["workspace_id"]
    t.watch_directory(str(project), ws)
    time.sleep(4)
    (project / "new.py").write_text("def fresh():\n    pass\n")
    (project / "b.md").unlink()
    until = time.time() + 60
    while time.time() < until:
        names = {r.name for r in t.own("chunks", ws).collect()}
        if "fresh" in names and "b.md" not in names:
            break
        time.sleep(1)
    stopped = json.loads(t.watch_directory(str(project), ws, enabled=False, format="json"))
    assert stopped["watchers_stopped"] == 1 and "fresh" in names and "b.md" not in names


def test_question_to_the_model():
    from lodestone.operators.tagger import prompt_for

    asked = prompt_for("/a/b.py", "import os.path\ndef f(): pass\n")
    assert "* os.path" in asked and "* f\n" in asked and "framework:flask" in asked and "/a/b.py" in asked
    assert "(none)" in prompt_for("/a/b.md", "text")


def test_a_write_that_fails_leaves_the_index(spark, tmp_path, project, monkeypatch):
    from lodestone.plans.store import Store

    t = Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx"))))
    ws = json.loads(t.index_project(str(project), format="json"))["workspace_id"]
    rows = lambda tools: {n: sorted(map(str, tools.store.table(n).drop("embedding").collect())) for n in ("chunks", "files", "deps", "workspaces", "scans")}
    before = rows(t)
    (project / "b.md").write_text("# Other\n")
    for step in ("_write", "_publish"):
        real, calls = getattr(Store, step), []

        def fails(self, *a, real=real, calls=calls, step=step):
            calls.append(a)
            if step == "_publish":
                # The segments are all written, the manifest half.
                stream = self._fs().create(self._path("manifests/draft-x"), True)
                stream.write(bytearray(b'{"commit": '))
                stream.close()
                raise OSError("gone")
            if len(calls) == 2:
                raise OSError("disk")
            return real(self, *a)

        monkeypatch.setattr(Store, step, fails)
        with pytest.raises(OSError):
            t.index_project(str(project))
        monkeypatch.undo()
        assert rows(t) == before and rows(Tools(spark, t.config)) == before
    assert json.loads(t.index_project(str(project), format="json"))["files_indexed"] == 1
    assert t.own("chunks", ws).filter("code LIKE '%Other%'").count() == 1


def test_a_second_writer_fails(spark, tmp_path, project):
    one, two = (Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx")))).store for _ in range(2))
    state = two.current()
    one.delete_workspace("a")
    two.current = lambda: state
    with pytest.raises(RuntimeError):
        two.delete_workspace("b")
    del two.current
    assert two.current()["commit"] == 1


def test_drop_and_merge(spark, tmp_path, project):
    t = Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx"))))
    big = project / "big"
    big.mkdir()
    (big / "big.py").write_text("".join(f"def big{k}(x):\n    return x + {k}\n" for k in range(3000)))
    t.index_project(str(big), workspace_id="c")
    (big / "big.py").unlink()
    a = json.loads(t.index_project(str(project), workspace_id="a", format="json"))
    t.index_project(str(project), workspace_id="b")
    n = len(t.store.current()["tables"]["chunks"])
    t.delete_project("a")
    assert len(t.store.current()["tables"]["chunks"]) == n and t.own("chunks", "a").count() == 0 and t.own("chunks", "b").count() == a["total_chunks"]
    t.index_project(str(project), workspace_id="a")
    assert t.own("chunks", "a").count() == a["total_chunks"]
    path = str((project / "pkg" / "a.py").resolve())
    for k in range(4):
        t.store.delete_files("b", [path])
        (project / "pkg" / "a.py").write_text(f"def helper{k}():\n    return {k}\n")
        t.store.index_files([path], "b", str(project))
    rows = lambda: {n: sorted(map(str, t.store.table(n).drop("embedding").collect())) for n in ("chunks", "files", "deps", "scans")}
    before = rows()
    t.store.compact(2)
    state = t.store.current()
    assert rows() == before and len(state["tables"]["chunks"]) == 2 and state["tables"]["chunks"][0].endswith("=1") and state["dropped"] and len(state["tables"]["gone"]) == 1
    t.store.delete_files("a", [path])
    t.store.compact()
    state = t.store.current()
    assert {n: len(state["tables"][n]) for n in ("chunks", "files", "deps", "scans")} == dict.fromkeys(("chunks", "files", "deps", "scans"), 1) and not state["dropped"] and not state["tables"]["gone"]
    assert t.own("chunks", "a").filter(f"file_path = '{path}'").count() == 0 and [r.name for r in t.own("chunks", "b").filter(f"file_path = '{path}'").collect()] == ["helper3"]


def test_counts_and_search_follow_every_change(spark, tmp_path):
    """After random additions, changes and deletions, with merges between, the files' rows equal a recount of the chunks, and a search that reads postings one that reads all chunks."""
    import random

    from pyspark.sql import functions as F

    from lodestone.operators import search, stats

    rng, root = random.Random(5), tmp_path / "p"
    root.mkdir()
    t = Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx"))))
    words = ["open", "the", "socket", "read", "line", "x_1", "Parse"]

    def write(k):
        body = "".join(f"def {rng.choice(words)}_{j}(a):\n    # {' '.join(rng.choices(words, k=rng.randint(1, 9)))}\n    return a\n" for j in range(rng.randint(1, 4)))
        (root / f"f{k}.{rng.choice(['py', 'js']) if k % 3 == 0 else 'py'}").write_text(body)

    for step in range(3):
        for k in rng.sample(range(8), 4):
            write(k)
        if step:
            for p in rng.sample(sorted(root.iterdir()), 1):
                p.unlink()
        t.index_project(str(root), workspace_id="w")
        if step == 1:
            (tmp_path / "q").mkdir()
            (tmp_path / "q" / "other.py").write_text("def open_the_socket():\n    return 1\n")
            t.index_project(str(tmp_path / "q"), workspace_id="v")
        if step == 1:
            t.store.compact()
        plain = lambda df: sorted(map(tuple, df.collect()))
        chunks, rollups = t.store.table("chunks"), t.store.table("rollups")
        assert plain(stats.current_of(rollups)) == plain(stats.current(chunks))
        assert plain(stats.per_language_of(rollups)) == plain(stats.per_language(chunks.select("workspace_id", "file_path").distinct(), chunks))
        assert plain(stats.most_active_of(rollups)) == plain(stats.most_active(chunks))
        docs = t.searchable().drop("embedding", "embed_text", "tags").cache()
        for phrase in ("the socket", "open", "zzz", "return a"):
            for ws, language, k in ((None, None, 5), ("w", None, 3), ("w", "python", 4), ("v", "javascript", 2)):
                want = [(r.file_path, r.symbol_name, r.id, round(r["rank"], 9), round(r.bm25_score, 9), r.place, r.code) for r in search.bm25_search(docs, {"q": phrase}, ws, language, k).orderBy("place").collect()]
                got = [(r["file_path"], r["symbol_name"], r["id"], round(r["rank"], 9), round(r["bm25_score"], 9), r["place"], r["code"]) for r in t.store.word_search(phrase, ws, language, k)]
                assert got == want, (phrase, ws, language)
        docs.unpersist()
    t.store.delete_workspace("v")
    assert all(r["file_path"].startswith(str(root)) for r in t.store.word_search("socket", None, None, 50))
    read = t.store.word_hits({"q": "the socket"}).inputFiles()
    assert not any("/chunks/" in f for f in read) and any("/postings/" in f for f in read) and t.store.table("chunks").filter(F.col("workspace_id") == "v").count() == 0


def test_many_equal_hits(spark, tmp_path, monkeypatch):
    from lodestone.plans import store

    root = tmp_path / "p"
    root.mkdir()
    for k in range(30):
        (root / f"f{k:02}.py").write_text("def same():\n    return 1\n")
    t = Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx"))))
    t.index_project(str(root), workspace_id="w")
    want = [r["file_path"] for r in t.store.word_search("same", "w", None, 3)]
    monkeypatch.setattr(store, "MOST_TAKEN", 5)
    assert [r["file_path"] for r in t.store.word_search("same", "w", None, 3)] == want == [str(root.resolve() / f"f{k:02}.py") for k in range(3)]


def test_readers_survive_a_write(spark, tmp_path, project, monkeypatch):
    from lodestone.plans import store

    t = Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx"))))
    ws = json.loads(t.index_project(str(project), format="json"))["workspace_id"]
    held = {n: t.store.table(n) for n in ("chunks", "files", "deps", "workspaces", "rollups")}
    before = {n: sorted(map(str, df.drop("embedding").collect())) for n, df in held.items()}
    for k in range(3):
        (project / "b.md").write_text(f"# New {k}\n")
        t.index_project(str(project))
        t.store.compact()
    assert {n: sorted(map(str, df.drop("embedding").collect())) for n, df in held.items()} == before
    old = list(t.store.current()["old"])
    there = lambda p: t.store._fs().exists(t.store._path(p))
    assert old and all(map(there, old))
    monkeypatch.setattr(store, "KEPT_S", 0)
    t.store.delete_files(ws, ["none"])
    assert not any(map(there, old)) and not t.store.current()["old"]


def test_an_index_of_another_layout_is_refused(spark, tmp_path, project):
    t = Tools(spark, Config(index=Index(index_path=str(tmp_path / "idx"))))
    t.index_project(str(project))
    at = sorted((tmp_path / "idx" / "manifests").glob("*.json"))[-1]
    at.write_text(at.read_text().replace('"layout": 4', '"layout": 3'))
    (at.parent / f".{at.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="layout"):
        Tools(spark, t.config).store.table("chunks")


def test_many_dropped_workspaces(spark):
    from lodestone.operators import index

    rows = spark.createDataFrame([(f"w{k}", n) for k in range(300) for n in (1, 5)], "workspace_id string, commit_no long")
    for n in (3, 250):
        kept = index.without_workspaces(rows, {f"w{k}": 2 for k in range(n)}).collect()
        assert len(kept) == 600 - n and len(kept[0]) == 2


def test_a_tree_of_one_top_folder_is_listed_in_parts(spark, tmp_path):
    """All files once, and the one folder at the top isn't one task."""
    names = {f"src/m{k}/n{j}/f.py" for k in range(12) for j in range(8)} | {"src/x.py", "y.py", "src/m0/_z.py", "src/m1/n1/deep/er/w.py"}
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("1")
    parts = tree.TreeReader({"path": str(tmp_path)}).partitions()
    assert len(parts) > tree.ENOUGH and sum(p.recursive for p in parts) == 96
    assert sorted(r.file_path for r in tree.listing(spark, str(tmp_path)).collect()) == sorted(str(tmp_path / n) for n in names)
    assert [r.file_path for r in tree.listing(spark, str(tmp_path), recursive=False).collect()] == [str(tmp_path / "y.py")]
