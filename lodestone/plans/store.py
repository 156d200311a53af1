"""The index on disk: tables as lists of Parquet segments, and the write path that fills them.

A write appends a segment of new rows to each table and, for files that changed or went, a row to the table of dropped files; readers leave out
what a later commit dropped. So a write costs what changed, not what is there. A commit is a numbered manifest that names the segments; it appears whole, by a rename, and the
highest number counts, so a write that fails at any step leaves the index as it was. Dropping a workspace is an entry in the manifest. Beyond 32 segments a write merges the
newest ones, as many as are not much larger than those behind them, so a row is rewritten a number of times that grows with the logarithm of the index. Chunks are partitioned by
workspace and language, so searches prune, and sorted by name within files, so lookups skip row groups and pages (and files, by Bloom filters on names and paths).

With each segment of chunks go two that are made of it when it is written, and go with it when it is merged: its postings, which phrase search reads in place of chunks, and a row for each
file with its counts and the numbers of its chunks. A chunk's number is unique in its segment. Counts over the index are sums over the live files' rows, and a dropped file's
chunks are known by their numbers, so neither reads chunks.

Segments that a later commit replaced are deleted when they have been out of use for ``KEPT_S`` seconds, so readers that began before go on.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..config import Config
from ..functions import bindings, imports, tags, text
from ..operators import chunks as chunking
from ..operators import embed, index, links, postings, search, stats
from ..sources import tree, workspaces

TABLES = {"chunks": schema.CHUNK, "files": schema.FILE, "deps": schema.EDGE, "uses": schema.USE, "scans": schema.SCAN, "workspaces": schema.WORKSPACE, "tag_cache": schema.TAG_CACHE, "postings": schema.POSTING, "rollups": schema.ROLLUP}
#: Tables whose rows belong to a file, and go with it.
BY_FILE = ("chunks", "files", "deps", "uses")
#: Tables made of each segment of chunks.
DERIVED = ("postings", "rollups")
#: Number of the layout; an index of another one has to be made again.
LAYOUT = 4
#: Seconds that a segment stays after the commit that put it out of use.
KEPT_S = 3600
COMMIT = T.StructField("commit_no", T.LongType())
#: Chunks as segments hold them: with their numbers, which tables don't show.
CHUNKS = T.StructType([*schema.CHUNK.fields, T.StructField("chunk_no", T.LongType()), COMMIT])
GONE = schema.struct("workspace_id string, file_path string, gone_no long")
#: Segments of a table beyond which a write merges the newest, and how much larger than those behind it a segment may be to be merged with them.
MOST_SEGMENTS, GROWTH = 32, 2
#: Bytes up to which a segment is merged in any case.
SMALL = 1 << 16
MANIFESTS = "manifests"
#: Errors that a report lists; all are counted.
MOST_ERRORS = 1000
#: Hits that come to the driver in one search, when many are equally good.
MOST_TAKEN = 4096
#: Bytes of a row group.
ROW_GROUP = 8 << 20
#: Columns with Bloom filters, a filter's bytes in a row group at most, and the chunks of a new segment, or the bytes of merged ones, beyond which there are filters: small
#: segments would be nothing else.
BLOOM_BYTES, FILTERED, FILTERED_BYTES = 1 << 16, 20_000, 1 << 22
BLOOMS = {"chunks": ("name", "file_path"), "postings": ("term",)}
PARTITIONS = {"chunks": ["workspace_id", "language"], "deps": ["workspace_id"], "uses": ["workspace_id"]}


def _number(segment: str) -> int:
    return int(segment.rsplit("=", 1)[1])


class Store:
    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: embed.Embedder | None = None, tagger=None):
        self.spark, self.config = spark, config or Config()
        self.embedder, self.tagger = embedder or embed.HashEmbedder(), tagger
        self._read, self._state, self._tables = None, {}, {}
        root = self.config.index.index_path
        self.root = root if "://" in root else f"file://{root}"
        self._totals: tuple[int, tuple] | None = None

    # Segments

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def current(self) -> dict:
        """The last commit: its number, the segment folders of each table, their bytes, and the workspaces that were dropped, with the commit that did."""
        fs, folder = self._fs(), self._path(MANIFESTS)
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if re.fullmatch(r"\d{12}\.json", n)]
        if not names:
            return {"commit": 0, "tables": {}, "bytes": {}, "dropped": {}, "layout": LAYOUT}
        if self._read != names[-1]:
            stream = fs.open(self._path(f"{MANIFESTS}/{names[-1]}"))
            try:
                self._state, self._read, self._tables = json.loads(bytes(stream.readAllBytes())), names[-1], {}
            finally:
                stream.close()
            if self._state.get("layout") != LAYOUT:
                raise ValueError(f"{self.root} holds an index of another layout: clear it and index again")
        return self._state

    def _segments(self, name: str, state: dict, form: T.StructType, only: Sequence[str] | None = None) -> DataFrame | None:
        paths = [f"{self.root}/{p}" for p in state["tables"].get(name, ()) if only is None or p in only]
        return self.spark.read.schema(form).option("basePath", f"{self.root}/{name}").parquet(*paths) if paths else None

    def table(self, name: str) -> DataFrame:
        """The live rows of a table: its segments, less the rows of files and workspaces that a later commit dropped or replaced. The plan is kept until the next commit."""
        state = self.current()
        if name not in self._tables:
            self._tables[name] = self.live(name, state)
        return self._tables[name]

    def live(self, name: str, state: dict, only: Sequence[str] | None = None) -> DataFrame:
        form = TABLES[name]
        rows = self._segments(name, state, T.StructType([*form.fields, COMMIT]), only)
        if rows is None:
            return self.spark.createDataFrame([], form)
        own = "id" if name == "workspaces" else "workspace_id"
        if own in form.fieldNames():
            rows = index.without_workspaces(rows, state["dropped"], own)
        gone = self._segments("gone", state, GONE) if name in (*BY_FILE, "rollups") else None
        if gone is not None:
            rows = index.without_dropped(rows, gone)
        return rows.select(*form.fieldNames())

    def totals(self) -> tuple[int, float]:
        """Chunks of all workspaces and their mean length in tokens; counted once a commit."""
        n = self.current()["commit"]
        if self._totals is None or self._totals[0] != n:
            r = self.table("rollups").agg(F.coalesce(F.sum("symbols"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
            self._totals = n, (r.n, r.words / max(r.n, 1))
        return self._totals[1]

    def dead(self, state: dict) -> DataFrame | None:
        """commit_no and number of the chunks of dropped files, from the files' rows; None if there are none."""
        gone, rows = self._segments("gone", state, GONE), self._segments("rollups", state, T.StructType([*schema.ROLLUP.fields, COMMIT]))
        if gone is None or rows is None:
            return None
        return index.only_dropped(rows.select(*index.FILE_KEY, "numbers", COMMIT.name), gone).select(COMMIT.name, F.explode("numbers").alias("number"))

    def word_hits(self, phrases: dict[str, str]) -> DataFrame:
        """query_id, workspace_id, language, commit_no, number, tf and length of the live chunks of all workspaces that hold each phrase, from the postings alone."""
        state = self.current()
        keys = ["workspace_id", "language", COMMIT.name]
        rows = self._segments("postings", state, T.StructType([*schema.POSTING.fields, COMMIT]))
        if rows is None:
            rows = self.spark.createDataFrame([], T.StructType([*schema.POSTING.fields, COMMIT]))
        found = postings.hits(index.without_workspaces(rows, state["dropped"]), phrases, keys)
        dead = self.dead(state)
        return found if dead is None else found.join(dead, [COMMIT.name, "number"], "left_anti")

    def word_search(self, phrase: str, workspace: str | None = None, language: str | None = None, k: int = 10) -> list[dict]:
        """The rows of ``search.bm25_search`` for one phrase: the k best chunks with place and bm25_score. Postings give all hits and their weights; only the chunks of the
        best are read, by number."""
        n_docs, mean = self.totals()
        if not n_docs or not postings.asked({"q": phrase}):
            return []
        counted = Observation()
        found = self.word_hits({"q": phrase}).observe(counted, F.count(F.lit(1)).alias("n_hits")).withColumn("weight", search.weight_of(F.col("tf"), F.col("length"), F.lit(mean)))
        if workspace is not None:
            found = found.filter(F.col("workspace_id") == workspace)
        keys = ["workspace_id", "language", COMMIT.name, "number"]
        found = found.select(*keys, "tf", "length", "weight")
        # Equals are ranked by path and name, and a language is told by the path, which chunks hold: so candidates are taken until k of them are better than the rest.
        rows: list[dict] = []
        take = k
        while take <= MOST_TAKEN:
            top = found.orderBy(F.desc("weight"), *keys).limit(take + 1).collect()
            whole = len(top) <= take
            rows = self._chunks_of([r for r in top if whole or r.weight > top[-1].weight], language)
            if whole or len(rows) >= k:
                break
            take *= 8
        else:
            chunks = self._segments("chunks", self.current(), CHUNKS)
            named = chunks.filter(search.language_filter(F.col("file_path"), language)).select(*keys[:3], F.col("chunk_no").alias("number"), "file_path", "name", "chunk_id")
            rows = self._chunks_of(found.join(named, keys).orderBy(F.desc("weight"), "file_path", "name", "chunk_id").limit(k).collect(), language)
        n_hits = counted.get["n_hits"]
        for r in rows:
            r["rank"] = search.plain_rank(r.pop("tf"), r.pop("own_length"), n_docs, mean, n_hits)
        rows = sorted(rows, key=lambda r: (r["rank"], r["file_path"], r["symbol_name"], r["id"]))[:k]
        ranks = [r["rank"] for r in rows]
        for place, r in enumerate(rows, 1):
            span = ranks[-1] - ranks[0]
            r |= {"place": place, "bm25_score": 1 - (r["rank"] - ranks[0]) / (span or 1.0)}
        return rows

    def _chunks_of(self, top: Sequence[Row], language: str | None) -> list[dict]:
        """Path, name, code and docstring of chunks by segment and number; partitions, row groups and pages without any are not read."""
        if not top:
            return []
        rows = self._segments("chunks", self.current(), CHUNKS)
        by = {(r["commit_no"], r["number"]): r for r in top}
        some = lambda c: F.col(c).isin(sorted({r[c] for r in top}))
        wanted = rows.filter(some("workspace_id") & some("language") & some(COMMIT.name) & F.col("chunk_no").isin(sorted({r["number"] for r in top})))
        out = []
        for r in wanted.select(COMMIT.name, "chunk_no", F.col("chunk_id").alias("id"), "file_path", F.col("name").alias("symbol_name"), "code", "docstring").collect():
            hit = by.get((r["commit_no"], r["chunk_no"]))
            if hit is not None and search.has_language(r["file_path"], language):
                out.append(r.asDict() | {"tf": hit["tf"], "own_length": hit["length"]})
        return out

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, gone: DataFrame | None = None, drop: str | None = None, merge: dict[str, list[str]] | None = None, filters: bool = False) -> None:
        """One step of the index: segments appended, tables replaced, rows of files or of a workspace dropped, segments of a table merged. It holds once its manifest is there;
        there is one writer at a time, and a second one fails."""
        state = self.current()
        n = state["commit"] + 1
        tables, sizes, dropped = {k: list(v) for k, v in state["tables"].items()}, dict(state["bytes"]), dict(state["dropped"])
        old = [p for name in (replace or {}) for p in tables.pop(name, ())]
        merge = dict(merge or {})
        for name, paths in merge.items():
            own = [p for d in DERIVED for p in tables.get(d, ()) if _number(p) in {_number(q) for q in paths}] if name == "chunks" else []
            old += [*paths, *own]
            for t in (name, *DERIVED) if own else (name,):
                tables[t] = [p for p in tables.get(t, ()) if p not in old]
        fresh = {**(append or {}), **(replace or {}), **{name: self.merged(name, state, paths) for name, paths in merge.items()}}
        for name, df in fresh.items():
            own = filters or sum(sizes[p] for p in merge.get(name, ())) > FILTERED_BYTES
            tables.setdefault(name, []).append(at := self._write(name, df, n, own))
            if name == "chunks":
                for d, rows in self.derived(at, n).items():
                    tables.setdefault(d, []).append(self._write(d, rows, n, own))
        if gone is not None:
            tables.setdefault("gone", []).append(self._write("gone", gone.withColumn("gone_no", F.lit(n)), n))
        if drop is not None:
            dropped[drop] = n
        # What was dropped before all segments there are, is of no use.
        least = lambda names: min((_number(p) for name in names for p in tables.get(name, ())), default=n)
        if least(BY_FILE) >= n:
            old += [p for p in tables.get("gone", []) if _number(p) < n]
            tables["gone"] = [p for p in tables.get("gone", []) if _number(p) >= n]
        dropped = {k: v for k, v in dropped.items() if v > least(tables.keys() - {"gone"})}
        fs = self._fs()
        for paths in tables.values():
            for p in paths:
                if p not in sizes:
                    sizes[p] = fs.getContentSummary(self._path(p)).getLength()
        now = time.time()
        waiting = {**state.get("old", {}), **dict.fromkeys(old, now)}
        made = {"commit": n, "layout": LAYOUT, "tables": tables, "bytes": {p: sizes[p] for paths in tables.values() for p in paths}, "dropped": dropped, "old": {p: t for p, t in waiting.items() if t > now - KEPT_S}}
        self._publish(fs, n, made)
        for p in waiting.keys() - made["old"].keys():
            fs.delete(self._path(p), True)
        # The manifest before stays, for a look back; those before that are of no use.
        for f in fs.listStatus(self._path(MANIFESTS)):
            if re.fullmatch(r"\d{12}\.json", name := f.getPath().getName()) and int(name[:12]) < n - 1:
                fs.delete(f.getPath(), False)

    def _publish(self, fs, n: int, made: dict) -> None:
        draft, path = self._path(f"{MANIFESTS}/draft-{uuid.uuid4().hex}"), self._path(f"{MANIFESTS}/{n:012d}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        # A rename doesn't replace a manifest that another writer has put there.
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise RuntimeError(f"commit {n} of {self.root} was not taken: there is another one of this number, or the rename failed")

    def _write(self, name: str, df: DataFrame, n: int, filters: bool = False) -> str:
        form = GONE if name == "gone" else TABLES[name]
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in form.fields if f.name != COMMIT.name])
        if keys := PARTITIONS.get(name):
            # Files of a sensible size in each partition, however many or few rows there are.
            rows = rows.hint("rebalance", *[F.col(k) for k in keys])
        # The commit is a partition, too. What is there already is left of a write that failed.
        # Row groups are small, so that a search of a small index keeps all cores busy.
        if name == "chunks":
            rows = rows.sortWithinPartitions(*PARTITIONS[name], "name").withColumn("chunk_no", F.monotonically_increasing_id())
        if name == "postings":
            # A term's rows stand together, in one file.
            rows = rows.repartition(F.col("term")).sortWithinPartitions("term", "block")
        out = rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP)
        for c in BLOOMS.get(name, ()) if filters else ():
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", BLOOM_BYTES)
        (out.partitionBy(*keys) if keys else out).parquet(f"{self.root}/{(at := f'{name}/{COMMIT.name}={n}')}")
        return at

    def derived(self, segment: str, n: int) -> dict[str, DataFrame]:
        """What is made of a segment of chunks that has been written."""
        rows = self.spark.read.schema(CHUNKS).option("basePath", f"{self.root}/chunks").parquet(f"{self.root}/{segment}")
        return {"postings": postings.build(rows, "chunk_no", ("workspace_id", "language")), "rollups": stats.rolled_up(rows)}

    def vacuum(self) -> None:
        """Delete at once what is out of use; for times without readers."""
        fs, state = self._fs(), self.current()
        for p in state.get("old", {}):
            fs.delete(self._path(p), True)

    def merged(self, name: str, state: dict, paths: Sequence[str]) -> DataFrame:
        """The rows of some segments that count: of dropped files the last commit that did, of other tables the live rows."""
        if name == "gone":
            return self._segments(name, state, GONE, paths).groupBy(*index.FILE_KEY).agg(F.max("gone_no").alias("gone_no"))
        return self.live(name, state, paths)

    def compact(self, least: int = 1) -> None:
        """Merge the newest segments of the tables by file that have more than ``least``: from the newest back, as long as the next one is at most GROWTH times as large as all
        taken so far. With ``least`` 1 all are merged, and what was dropped goes for good."""
        state = self.current()
        merge = {}
        if least == 1:
            merge = {name: paths for name in (*BY_FILE, "scans", "tag_cache") if (paths := state["tables"].get(name))}
        for name in (*BY_FILE, "scans", "tag_cache", "gone") if least > 1 else ():
            paths = state["tables"].get(name, [])
            if len(paths) <= least:
                continue
            taken, total = [], 0
            for p in reversed(paths):
                if taken and state["bytes"][p] > max(GROWTH * total, SMALL):
                    break
                taken.append(p)
                total += state["bytes"][p]
            if len(taken) > 1:
                merge[name] = taken
        if merge:
            self.commit(merge=merge)

    # Write path

    def tagged(self, files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Files with tags, and the model's new answers (tag_key, known): by path, and by the model where that is on. Answers are cached by a
        hash of path and first lines, so a text is asked about once."""
        h1 = tags.path_tags(F.col("file_path"), F.col("language"))
        if not self.config.tagging.h2_enabled or self.tagger is None:
            return files.withColumn("tags", h1), None
        preview = F.array_join(F.slice(F.split("source", "\n"), 1, 50), "\n")
        asked = files.withColumns({"tag_key": F.sha2(F.concat("file_path", F.lit(":"), preview), 256), "preview": preview})
        cached = self.table("tag_cache").select(F.col("file_hash").alias("tag_key"), F.col("tags").alias("known")) if self.config.tagging.use_cache else None
        answers = self.answers(asked if cached is None else asked.join(cached, "tag_key", "left_anti")).persist()
        both = answers if cached is None else answers.unionByName(cached)
        all_tags = F.array_sort(F.array_union(h1, F.coalesce("known", F.array().cast("array<string>"))))
        return asked.join(both.dropDuplicates(["tag_key"]), "tag_key", "left").withColumn("tags", all_tags).drop("tag_key", "preview", "known"), answers

    def answers(self, files: DataFrame) -> DataFrame:
        """tag_key and validated tags of the model's answers; a failing call gives none."""
        tagger, taxonomy = self.tagger, self.config.tagging

        ask = F.pandas_udf(_asker(tagger), "string")
        answer = tags.answered_tags(ask("file_path", "preview"))
        return files.select("tag_key", tags.valid_tags(F.coalesce(answer, F.array().cast("array<string>")), taxonomy.framework, taxonomy.design_pattern).alias("known"))

    def chunk_rows(self, rows: DataFrame, files: DataFrame) -> DataFrame:
        """Chunk table rows from the chunker's, with the tags of their files."""
        limit = self.config.index.max_embed_text_length
        rows = index.last_wins(rows.filter("type is not null").withColumn("seq", F.monotonically_increasing_id()), index.CHUNK_KEY, [F.col("seq")])
        rows = rows.join(files.select("workspace_id", "file_path", "tags"), ["workspace_id", "file_path"], "left")
        rows = rows.withColumns({"chunk_id": index.chunk_id(), "selection_start": F.col("start_line"), "selection_end": F.when(F.col("signature") == F.col("name"), F.col("end_line")).otherwise(F.col("start_line"))})
        rows = rows.withColumn("embed_text", text.sanitized(text.embed_text(F.col("signature"), F.col("docstring"), F.col("code"), limit)))
        rows = rows.withColumn("metadata", F.parse_json("metadata"))
        # Token lines are stored, so a search only reads them.
        rows = search.tokenized(rows, ("workspace_id", "file_path", "name", "code", "docstring"))
        return rows.withColumn("embedding", embed.embedding_of(self.embedder)(F.col("embed_text")))

    def root_of(self, workspace: str, default: str) -> str:
        """The remembered root of a workspace."""
        row = self.table("workspaces").filter(F.col("id") == workspace).select("root").first()
        return row.root if row else default

    def write(self, scanned: DataFrame, workspace: str, root: str, fresh: DataFrame, gone: DataFrame, started: float, record: bool = True) -> dict:
        """Index the fresh files (with source) of a tree, drop those gone, record the scan, and report."""
        fresh, answers = self.tagged(fresh.withColumn("workspace_id", F.lit(workspace)))
        fresh = fresh.persist()
        parsed = chunking.chunk_files(fresh).persist()
        new = self.chunk_rows(parsed, fresh).persist()
        try:
            failed = parsed.filter("error is not null")
            errors = [r.error for r in failed.select("error").limit(MOST_ERRORS).collect()]
            n_failed = failed.count() if len(errors) == MOST_ERRORS else len(errors)
            chunked = new.select("workspace_id", "file_path").distinct()
            indexed = fresh.join(chunked, list(index.FILE_KEY), "left_semi")
            report = index.summary(scanned, indexed, new).first().asDict(recursive=True)
            touched = fresh.select(*index.FILE_KEY).unionByName(gone.select(*index.FILE_KEY)).distinct().join(self.table("files").select(*index.FILE_KEY), list(index.FILE_KEY), "left_semi")
            report |= {"duration_ms": int((time.time() - started) * 1000), "errors": errors, "files_skipped": report["files_skipped"] - n_failed}
            now = F.current_timestamp()
            add = {
                "chunks": new, "files": fresh.withColumn("indexed_at", now),
                "uses": links.uses(new.join(fresh.select(*index.FILE_KEY, bindings.bindings(F.col("source"), F.col("language"), F.col("package"), F.col("file_path"), root).alias("bindings")), list(index.FILE_KEY))),
                "deps": index.edges_of(fresh, imports.imports(F.col("source"), F.col("language"))),
            }
            if answers is not None and self.config.tagging.use_cache:
                add["tag_cache"] = answers.select(F.col("tag_key").alias("file_hash"), F.col("known").alias("tags"), now.alias("created_at")).dropDuplicates(["file_hash"])
            if record:
                scan = (workspace, report["files_scanned"], report["total_chunks"], report["duration_ms"])
                add["scans"] = self.spark.createDataFrame([scan], "workspace_id string, files_scanned long, chunks_created long, duration_ms long").withColumn("ts", now)
            self.commit(append=add, gone=touched, filters=report["total_chunks"] > FILTERED)
            self.compact(MOST_SEGMENTS)
        finally:
            for x in (new, parsed, fresh, answers):
                if x is not None:
                    x.unpersist()
        return report

    def index_directory(self, directory: str, workspace: str | None = None, recursive: bool = True, excludes: Sequence[str] | None = None, force: bool = False) -> dict:
        """Scan a folder, index what changed, drop what is gone."""
        started, own = time.time(), self.config.index
        found = workspaces.detect(directory) if "://" not in directory else None
        ws = workspace or (found.id if found else workspaces.id_of(directory))
        listing = tree.listing(self.spark, directory, recursive)
        present = tree.within_size(tree.wanted(listing, directory, own.supported_extensions, excludes if excludes is not None else own.exclude_patterns), own.max_file_size_mb)
        wanted = tree.with_source(present, directory).withColumn("workspace_id", F.lit(ws))
        fresh = tree.with_package(index.changed(wanted, self.table("files"), force), listing)
        # Which files are gone follows from the listing alone.
        gone = index.orphans(self.table("files"), present, ws, directory) if self.config.watcher.sync_deletions else self.table("files").limit(0)
        report = self.write(listing, ws, found.root if found else directory, fresh, gone, started)
        if found:
            self.remember(found)
        return report | {"workspace_id": ws}

    def index_files(self, files: Sequence[str], workspace: str, root: str, force: bool = False) -> dict:
        """The same plan for named files."""
        return self.index_listing(tree.named(self.spark, files), workspace, root, force)

    def index_listing(self, listing: DataFrame, workspace: str, root: str, force: bool = False) -> dict:
        """The same plan for some files (file_path, size_bytes) of a tree, which isn't listed."""
        started, own = time.time(), self.config.index
        wanted = tree.with_source(tree.within_size(tree.wanted(listing, root, own.supported_extensions, own.exclude_patterns), own.max_file_size_mb), root).withColumn("workspace_id", F.lit(workspace))
        fresh = tree.with_found_package(index.changed(wanted, self.table("files"), force), root)
        return self.write(listing, workspace, self.root_of(workspace, root), fresh, self.table("files").limit(0), started, record=False)

    def delete_files(self, workspace: str, files: Sequence[str] | DataFrame) -> None:
        """Drop files by name; a table of them has a column file_path."""
        gone = files if isinstance(files, DataFrame) else self.spark.createDataFrame([(f,) for f in files], "file_path string")
        self.commit(gone=gone.select(F.lit(workspace).alias("workspace_id"), "file_path"))

    def delete_workspace(self, workspace: str) -> None:
        """An entry in the manifest; the rows go when their segments are merged."""
        self.commit(drop=workspace)

    def clear(self) -> int:
        """Delete everything; how many workspaces there were."""
        n = self.table("files").select("workspace_id").distinct().count()
        self._fs().delete(self._path(""), True)
        self._read, self._state, self._tables = None, {}, {}
        return n

    def remember(self, found: workspaces.Workspace) -> None:
        languages = sorted(r.language for r in self.table("files").filter(F.col("workspace_id") == found.id).select("language").distinct().collect() if r.language)
        row = self.spark.createDataFrame([(found.id, found.name, found.root, found.marker_type, languages)], schema.struct("id string, name string, root string, marker_type string, languages strings"))
        self.commit(replace={"workspaces": self.table("workspaces").filter(F.col("id") != found.id).unionByName(row.withColumn("created_at", F.current_timestamp()))})

    def list_workspaces(self) -> DataFrame:
        return self.table("workspaces").orderBy(F.col("created_at").desc(), "id")


def _asker(tagger):
    def ask(path: pd.Series, preview: pd.Series) -> pd.Series:
        out = []
        for p, s in zip(path, preview, strict=True):
            try:
                out.append(tagger(p, s))
            except Exception:  # the file keeps its path tags
                out.append(None)
        return pd.Series(out, index=path.index, dtype=object)

    return ask
