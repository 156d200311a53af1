"""The seventeen tools over an index. Each answers text for people, or JSON with ``format="json"``; any other format is text."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .config import Config
from .functions.text import flat_metadata
from .operators import embed, graph, links, search, stats, symbols
from .plans.store import Store
from .streaming.watch import Watchers

SHOWN_CODE, SHOWN_FILES, SHOWN_ACTIVE, SHOWN_EDGES, SHOWN_ERRORS = 120, 20, 5, 20, 5


#: Columns of a chunk that only its metadata show.
ABOUT = ("type", "package", "start_line", "end_line", "selection_start", "selection_end", "signature", "own_metadata")


def described(hits: DataFrame) -> Column:
    """The flat metadata of hits: eleven fixed entries, the chunker's, and the tags."""
    c = F.col
    fixed = {"type": c("type"), "name": c("symbol_name"), "package": c("package"), "language": c("language"), "file_path": c("file_path"), **{k: c(k) for k in ABOUT[2:7]}, "docstring": c("docstring")}
    own = F.from_json(F.to_json("own_metadata"), "map<string,variant>")
    tags = F.when(F.size("tags") > 0, F.create_map(F.lit("tags"), F.to_variant_object("tags"))).otherwise(F.create_map().cast("map<string,variant>"))
    return flat_metadata(fixed, F.to_json(F.map_concat(F.coalesce(own, F.create_map().cast("map<string,variant>")), tags)))


def dumped(value: Any) -> str:
    return json.dumps(value, indent=2, default=str)


class Tools:
    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: embed.Embedder | None = None, tagger=None):
        self.spark, self.config = spark, config or Config()
        self.store = Store(spark, self.config, embedder, tagger)
        self._watchers: Watchers | None = None

    @property
    def watchers(self) -> Watchers:
        if self._watchers is None:
            self._watchers = Watchers(self.spark, self.store, self.config)
        return self._watchers

    def own(self, table: str, workspace_id: str) -> DataFrame:
        return self.store.table(table).filter(F.col("workspace_id") == workspace_id)

    # Index

    def index_project(self, directory: str, force_reindex: bool = False, format: str = "human", workspace_id: str | None = None, exclude_patterns: list[str] | None = None, recursive: bool = True) -> str:
        if "://" not in directory:
            if not os.path.exists(directory):
                raise ValueError(f"there is no folder {directory}")
            if not os.path.isdir(directory):
                raise ValueError(f"{directory} is no folder")
            directory = os.path.realpath(directory)
        result = self.store.index_directory(directory, workspace_id, recursive, exclude_patterns, force_reindex)
        if format == "json":
            return dumped(result)
        done = ", ".join(f"{n} {k}" for k, n in result["languages"].items())
        text = render.listed(f"Index of {directory}", [("Files", f"{result['files_indexed']} of {result['files_scanned']}"), ("Chunks", result["total_chunks"]), ("By language", done), ("Time", f"{result['duration_ms']} ms")])
        return text + render.section("Failed", result["errors"], SHOWN_ERRORS)

    def reindex_file(self, file_path: str, workspace_id: str = "default", format: str = "human") -> str:
        if not os.path.exists(file_path):
            raise ValueError(f"there is no file {file_path}")
        if not os.path.isfile(file_path):
            raise ValueError(f"{file_path} is no file")
        path = os.path.realpath(file_path)
        report = self.store.index_files([path], workspace_id, os.path.dirname(path), force=True)
        result = {"file_path": path, "workspace_id": workspace_id, "indexed": report["files_indexed"] > 0, "chunks_created": report["total_chunks"], "skipped": report["files_indexed"] == 0 and not report["errors"], "errors": report["errors"]}
        if format == "json":
            return dumped(result)
        what = f"{result['chunks_created']} chunks" if result["indexed"] else "nothing to index" if result["skipped"] else "; ".join(result["errors"])
        return f"{path}: {what}"

    def delete_project(self, workspace_id: str) -> str:
        files, chunks = self.own("files", workspace_id).count(), self.own("chunks", workspace_id).count()
        if not files and not chunks:
            raise ValueError(f"the index holds no workspace {workspace_id!r}")
        self.store.delete_workspace(workspace_id)
        return f"Workspace {workspace_id!r} deleted, with {files} files and {chunks} symbols"

    def clear_index(self) -> str:
        return f"Index emptied of {self.store.clear()} workspaces"

    # Search

    def searchable(self, workspace_id: str | None = None) -> DataFrame:
        rows = self.store.table("chunks")
        if workspace_id is not None:
            rows = rows.filter(F.col("workspace_id") == workspace_id)
        return rows.select(F.col("chunk_id").alias("id"), "workspace_id", "language", "file_path", F.col("name").alias("symbol_name"), "code", "docstring", "tags", "embed_text", "embedding", "words", "length", *ABOUT[:-1], F.col("metadata").alias("own_metadata"))

    def search_rows(self, query: str, top_k: int = 10, workspace_id: str = "default", language_filter: str | None = None, file_filter: str | None = None, exclude_tests: bool = False, tag_filter: list[str] | None = None, tags_mode: str = "any") -> list[dict]:
        """The fused hits; none if the query can't be embedded."""
        try:
            vector = embed.embed_batch(self.store.embedder, [query])[0]
        except (OSError, ValueError, IndexError):
            return []
        if not vector:
            return []
        vectors = self.searchable(workspace_id).withColumn("code", F.col("embed_text")).drop("embed_text", "words", "length")
        near = search.nearest(vectors, {"q": vector}, 2 * top_k, ("file_path", "symbol_name", "id"), workspace_id, language_filter)
        near = near.withColumn("metadata", F.to_json(described(near))).drop(*ABOUT)
        # Two lists of 2 top_k rows, found side by side. Ranking statistics span all workspaces.
        with ThreadPoolExecutor(1) as side:
            other = side.submit(near.collect)
            words = self.store.word_search(query, workspace_id, language_filter, 2 * top_k)
            hits = search.fused_rows(words, other.result(), top_k, self.config.search.alpha, self.config.search.beta, file_filter, exclude_tests, tag_filter, tags_mode)
        return [r | {"workspace_id": workspace_id, "metadata": json.loads(r["metadata"] or "{}")} for r in hits]

    def search_code(self, query: str, top_k: int = 10, workspace_id: str = "default", language_filter: str | None = None, file_filter: str | None = None, exclude_tests: bool = False, format: str = "human", **tags) -> str:
        rows = self.search_rows(query, top_k, workspace_id, language_filter, file_filter, exclude_tests, **tags)
        if format == "json":
            return dumped(rows)
        if not rows:
            return f"Nothing matches {query!r}"
        hits = [f"{r['hybrid_score']:.3f}  {r['symbol_name']}  {r['file_path']}" + (f"\n      {r['code'][:SHOWN_CODE]}" if r["code"] else "") for r in rows]
        return render.section(f"Matches of {query!r}", hits).lstrip("\n")

    # Symbols

    @staticmethod
    def location(r) -> dict:
        return {"file_path": r["file_path"], "start_line": r["start_line"], "end_line": r["end_line"]}

    def get_function_details(self, symbol_name: str, workspace_id: str = "default", output_format: str = "human") -> str:
        r = symbols.first_function(self.store.table("chunks"), workspace_id, symbol_name).first()
        if r is None:
            raise ValueError(f"workspace {workspace_id!r} has no function {symbol_name!r}")
        result = {"name": r.name, "kind": r.type, "language": r.language, "namespace": r["package"], "signature": r.signature, "description": r.docstring, "location": self.location(r), "code": r.code, "parameters": [], "returns": None, "visibility": None, "tags": []}
        if output_format == "json":
            return dumped(result)
        text = render.listed(f"{r.name}, {r.type}", [("At", f"{r.file_path}, lines {r.start_line} to {r.end_line}"), ("In", r["package"]), ("Written in", r.language), ("Declared", r.signature), ("Says", r.docstring)])
        return f"{text}\n\n{r.code}" if r.code else text

    def find_type_definition(self, type_name: str, workspace_id: str = "default", output_format: str = "human") -> str:
        chunks = self.store.table("chunks")
        found = symbols.first_type(chunks, workspace_id, type_name)
        r = found.first()
        if r is None:
            raise ValueError(f"workspace {workspace_id!r} has no type {type_name!r}")
        m = symbols.with_methods(found, chunks.filter(F.col("workspace_id") == workspace_id)).first()
        methods = [{"name": x["name"], "location": {"file_path": r.file_path, "start_line": x["start_line"], "end_line": x["end_line"]}} for x in m.methods]
        result = {"name": r.name, "full_name": m.full_name, "kind": r.type, "language": r.language, "namespace": r["package"], "description": r.docstring, "location": self.location(r), "methods": methods, "fields": [], "base_classes": []}
        if output_format == "json":
            return dumped(result)
        text = render.listed(f"{m.full_name}, {r.type}", [("At", f"{r.file_path}, lines {r.start_line} to {r.end_line}"), ("Written in", r.language), ("Says", r.docstring)])
        return text + render.section("Methods", (f"{x['name']}, lines {x['location']['start_line']} to {x['location']['end_line']}" for x in methods))

    def find_implementations(self, symbol_name: str, direction: str = "callers", workspace_id: str = "default", output_format: str = "human") -> str:
        if direction not in ("callers", "targets"):
            raise ValueError(f"direction is callers or targets, not {direction!r}")
        asked = self.spark.range(1).select(F.lit(workspace_id).alias("workspace_id"), F.lit(symbol_name).alias("symbol"))
        side, given = (symbols.callers, "source_symbol") if direction == "callers" else (symbols.targets, "target_symbol")
        chunks = self.store.table("chunks")
        named = side(self.store.table("deps").drop("file_path"), chunks, asked).select(given, "file_path")
        # Beside the edges from files to what they import: symbols that use each other by their imports.
        used = (links.callers if direction == "callers" else links.targets)(self.store.table("uses"), chunks, workspace_id, symbol_name).select(given, "file_path")
        rows = [{given: r[given], "file_path": r.file_path} for r in named.union(used).distinct().orderBy(given, "file_path").collect()]
        if output_format == "json":
            return dumped({"symbol": symbol_name, "direction": direction, "results": rows})
        if not rows:
            return f"{symbol_name!r} has no {direction}"
        return render.section(f"{symbol_name}: {direction}", (f"{r[given]}" + (f", {r['file_path']}" if r["file_path"] else "") for r in rows)).lstrip("\n")

    def get_code_context(self, file_path: str, line: int, workspace_id: str = "default", output_format: str = "human") -> str:
        rows = [{"name": r.name, "type": r.type, "start_line": r.start_line, "end_line": r.end_line} for r in symbols.around(self.store.table("chunks"), workspace_id, file_path, line).collect()]
        if output_format == "json":
            return dumped({"file_path": file_path, "line": line, "enclosing_symbols": rows})
        if not rows:
            return f"{file_path}, line {line}: not inside a symbol"
        return render.section(f"{file_path}, line {line}, from the inside out", (f"{r['name']}, {r['type']}, lines {r['start_line']} to {r['end_line']}" for r in rows)).lstrip("\n")

    # Maps

    def map_of(self, workspace_id: str, map_format: str = "summary") -> dict:
        # Of files with symbols; the table of files also holds the hashes of those that gave none.
        files = self.own("rollups", workspace_id)
        now, last = stats.current_of(files).first(), stats.last_scan(self.own("scans", workspace_id)).first()
        kinds = ("files", *stats.KINDS)
        summary = {
            "total_files": now.files if now else 0, "total_lines": now.total_lines if now else 0,
            "stats_by_language": {r.language: {k: r[k] for k in kinds} for r in stats.per_language_of(files).orderBy("language").collect()},
            "top_level_folders": [r.folder for r in stats.top_folders(files).orderBy("folder").collect()],
            "most_active_files": [{"path": r.file_path, "symbol_count": r.symbol_count} for r in stats.most_active_of(files).orderBy("place").collect()],
            "last_indexed": str(last.last_indexed) if last else None,
        }
        out: dict = {"summary": summary}
        if map_format == "detailed":
            rows = files.select("file_path", "language", *stats.KINDS).orderBy("file_path")
            out["detailed"] = {"files": [{"path": r.file_path, "language": r.language or "unknown", **{k: r[k] for k in stats.KINDS}} for r in rows.collect()]}
        elif map_format == "tree":
            out["tree"] = self.tree_of(workspace_id)
        return out

    def tree_of(self, workspace_id: str, path_filter: str | None = None, max_depth: int = 10) -> str:
        rows = stats.tree_nodes_of(self.own("rollups", workspace_id), path_filter, max_depth).collect()
        return render.tree_text((r.parent, r.name, r.is_file, r.symbols) for r in rows)

    def project_map(self, workspace_id: str = "default", map_format: str = "summary", output_format: str = "human") -> str:
        result = self.map_of(workspace_id, map_format)
        if output_format == "json":
            return dumped(result)
        s = result["summary"]
        folders = ", ".join(s["top_level_folders"])
        out = render.listed(f"Map of {workspace_id}", [("Files", s["total_files"]), ("Lines", s["total_lines"]), ("Folders", folders), ("Scanned", s["last_indexed"])])
        out += render.section("By language", (f"{k}: " + ", ".join(f"{v[x]} {x}" for x in v) for k, v in s["stats_by_language"].items()))
        out += render.section("Files with most symbols", (f"{f['symbol_count']}  {f['path']}" for f in s["most_active_files"]), SHOWN_ACTIVE)
        if "tree" in result:
            out += f"\n\n{result['tree']}"
        if "detailed" in result:
            out += render.section("Every file", (f"{f['path']}: {f['language']}, " + ", ".join(f"{f[x]} {x}" for x in stats.KINDS) for f in result["detailed"]["files"]), SHOWN_FILES)
        return out

    def file_tree(self, workspace_id: str = "default", path_filter: str | None = None, max_depth: int = 10, output_format: str = "human") -> str:
        tree = self.tree_of(workspace_id, path_filter, max_depth)
        if output_format == "json":
            return dumped({"workspace_id": workspace_id, "tree": tree})
        return tree or f"Workspace {workspace_id!r} has no files"

    def list_package_exports(self, package_path: str, workspace_id: str = "default", output_format: str = "human") -> str:
        names = [r.name for r in symbols.package_exports(self.store.table("chunks"), workspace_id, package_path).collect()]
        if output_format == "json":
            return dumped({"package": package_path, "exports": names})
        return render.section(f"Public names of {package_path}", names).lstrip("\n") if names else f"No public exports of {package_path!r}"  # Fixed value: "No public exports" is what callers look for.

    def project_stats(self, workspace_id: str = "default", output_format: str = "human") -> str:
        # Side by side: the counts, and the history of scans, which the answer lists in full.
        with ThreadPoolExecutor(1) as side:
            scanned = side.submit(self.own("scans", workspace_id).collect)
            now = stats.current_of(self.own("rollups", workspace_id)).first()
        scans = sorted(scanned.result(), key=lambda r: (r.ts, r.duration_ms))
        history = [{"timestamp": str(r.ts), "files_scanned": r.files_scanned, "chunks_created": r.chunks_created, "duration_ms": r.duration_ms} for r in scans]
        delta = {}
        if len(scans) > 1:
            a, z = scans[0], scans[-1]
            delta = {"files_delta": z.files_scanned - a.files_scanned, "chunks_delta": z.chunks_created - a.chunks_created, "time_span_ms": (z.ts - a.ts) // timedelta(milliseconds=1)}
        result = {"current": {k: now[k] if now else 0 for k in ("files", "total_lines", "total_symbols")}, "scan_history": history, "delta": delta}
        if output_format == "json":
            return dumped(result)
        c, d = result["current"], result["delta"]
        # Fixed values: "Project Stats", "Files", "Total symbols", "Scans" and "delta" are what callers look for.
        out = render.listed(f"Project Stats of {workspace_id}", [("Files", c["files"]), ("Total symbols", c["total_symbols"]), ("Lines", c["total_lines"]), ("Scans", len(history)), ("Last scan", history[-1]["timestamp"] if history else None)])
        if d:
            out += "\n\n" + render.listed("Since the first scan", [("Files, delta", f"{d['files_delta']:+d}"), ("Chunks, delta", f"{d['chunks_delta']:+d}"), ("Seconds", round(d["time_span_ms"] / 1000, 1))])
        return out

    # Graph

    def dependency_graph(self, workspace_id: str = "default", entry_point: str | None = None, max_depth: int | None = None, output_format: str = "human") -> str:
        edges = self.own("deps", workspace_id)
        links = edges.select("source_symbol", "target_symbol").distinct().orderBy("source_symbol", "target_symbol")
        sub = None
        if entry_point:
            entry = self.spark.range(1).select(F.lit(workspace_id).alias("workspace_id"), F.lit(entry_point).alias("entry"))
            rows = sorted(graph.breadth_first(edges, entry, max_depth).collect(), key=lambda r: (r.depth, r.symbol))
            sub = {"nodes": [r.symbol for r in rows], "edges": [[r.parent, r.symbol] for r in rows if r.parent is not None], "depths": {r.symbol: r.depth for r in rows}}
        if output_format == "json":
            # The whole graph is what was asked for.
            pairs = [tuple(r) for r in links.collect()]
            out = {"edges": render.format_edges(pairs), "adjacency": render.format_adjacency(pairs), "reverse_adjacency": render.format_adjacency(pairs, True), "visited_nodes": sorted({x for p in pairs for x in p})}
            return dumped(out | ({"entry_point_graph": sub} if sub is not None else {}))
        s = stats.graph_summary(edges).first()
        # Fixed values: "Dependency Graph", "Symbols" and "Dependencies" are what callers look for.
        head = [("Symbols", s.total_symbols if s else 0), ("Dependencies", s.total_dependencies if s else 0)]
        if s:
            head += [("Used most", f"{s.most_imported}, by {s.most_imported_count}"), ("Uses most", f"{s.most_dependent}, {s.most_dependent_count} others")]
        text = render.listed(f"Dependency Graph of {workspace_id}", head)
        if sub is not None:
            return text + render.section(f"Reached from {entry_point}: {len(sub['nodes'])} symbols, by links", (f"{a} → {b}" for a, b in sub["edges"]), SHOWN_EDGES)
        shown = links.limit(SHOWN_EDGES + 1).collect()
        return f"{text}\n\n{render.edge_lines(shown[:SHOWN_EDGES])}" + ("\n(the first links; json lists all)" if len(shown) > SHOWN_EDGES else "")

    def detect_cycles(self, workspace_id: str = "default", max_length: int | None = None) -> list[list[str]]:
        return sorted(list(r.path) for r in graph.cycles(self.own("deps", workspace_id), max_length).collect())

    # Watching and health

    def watch_directory(self, directory: str, workspace_id: str = "default", recursive: bool = True, enabled: bool = True, format: str = "human") -> str:
        if not enabled:
            n = self.watchers.stop_workspace(workspace_id)
            return dumped({"status": "stopped", "watchers_stopped": n, "workspace_id": workspace_id}) if format == "json" else f"{n} watchers of workspace {workspace_id!r} stopped"
        if not os.path.isdir(directory):
            raise ValueError(f"{directory} is no folder")
        directory = os.path.realpath(directory)
        k = self.watchers.start(directory, workspace_id, recursive)
        result = {"status": "watching", "watcher_id": k, "directory": directory, "workspace_id": workspace_id, "recursive": recursive}
        return dumped(result) if format == "json" else f"Changes in {directory} go to workspace {workspace_id!r} (watcher {k})"

    def diagnose(self) -> dict:
        """Health of the tables, the embedder and the workspaces. Never raises."""

        def tried(what) -> dict:
            try:
                return {"status": "ok"} | what()
            except Exception as e:
                return {"status": "error", "error": str(e)}

        return {
            "tables": tried(lambda: {t: self.store.table(t).count() for t in ("chunks", "files", "deps", "scans")}), "embedder": tried(lambda: {"dimension": len(embed.embed_batch(self.store.embedder, ["x"])[0])}),
            "workspaces": tried(lambda: {"workspaces": [r.id for r in self.store.list_workspaces().collect()]}),
        }

    def get_model_status(self) -> dict:
        """Models of the service, and whether the configured ones are among them (as a part of a name)."""
        m = self.config.model
        try:
            names = embed.HttpEmbedder(m.base_url, m.embed_model, m.embed_timeout_s, 0).list_models()
        except (OSError, ValueError, KeyError) as e:
            return {"status": "error", "error": str(e)}
        has = lambda name: {"name": name, "available": any(name in n for n in names)}
        return {"status": "ok", "models": names, "embed_model": has(m.embed_model), "tag_model": has(m.tag_model)}
