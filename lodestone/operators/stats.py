"""Counts and reports over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

KINDS = {"functions": "function", "classes": "class", "methods": "method"}


def rolled_up(chunks: DataFrame) -> DataFrame:
    """A row for each file with chunks: its counts, lines (nested symbols count twice), tokens, and the numbers of its chunks. Reports add these rows up."""
    counts = [F.count_if(F.col("type") == v).alias(k) for k, v in KINDS.items()]
    return chunks.groupBy("workspace_id", "language", "file_path").agg(
        *counts, F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("lines"), F.sum("length").alias("words"), F.sort_array(F.collect_list("chunk_no")).alias("numbers")
    )


def current_of(rollups: DataFrame) -> DataFrame:
    """``current`` from the files' rows."""
    return rollups.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("total_lines"), F.sum("symbols").alias("total_symbols"))


def per_file(chunks: DataFrame) -> DataFrame:
    """workspace_id, file_path, functions, classes, methods, symbol_count."""
    return chunks.groupBy("workspace_id", "file_path").agg(*[F.count_if(F.col("type") == v).alias(k) for k, v in KINDS.items()], F.count(F.lit(1)).alias("symbol_count"))


def per_language(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files and symbols by workspace and language; ``unknown`` where the path has none."""
    language = F.coalesce(paths.language_of(F.col("file_path")), F.lit("unknown")).alias("language")
    counted = files.groupBy("workspace_id", language).agg(F.count(F.lit(1)).alias("files"))
    symbols = chunks.groupBy("workspace_id", language).agg(*[F.count_if(F.col("type") == v).alias(k) for k, v in KINDS.items()])
    both = counted.join(symbols, ["workspace_id", "language"], "full")
    return both.select("workspace_id", "language", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", *KINDS)])


def per_language_of(rollups: DataFrame) -> DataFrame:
    """``per_language`` of files with symbols, from the files' rows."""
    language = F.coalesce(paths.language_of(F.col("file_path")), F.lit("unknown")).alias("language")
    return rollups.groupBy("workspace_id", language).agg(F.count(F.lit(1)).alias("files"), *[F.sum(k).alias(k) for k in KINDS])


def most_active(chunks: DataFrame, k: int = 10) -> DataFrame:
    """The k files with most symbols of each workspace."""
    return most_active_of(chunks.groupBy("workspace_id", "file_path").agg(F.count(F.lit(1)).alias("symbols")), k)


def most_active_of(rollups: DataFrame, k: int = 10) -> DataFrame:
    counted = rollups.select("workspace_id", "file_path", F.col("symbols").alias("symbol_count"))
    w = Window.partitionBy("workspace_id").orderBy(F.col("symbol_count").desc(), "file_path")
    return counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def current(chunks: DataFrame) -> DataFrame:
    """By workspace: files, total_lines (nested symbols count twice), total_symbols."""
    return chunks.groupBy("workspace_id").agg(F.countDistinct("file_path").alias("files"), F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("total_lines"), F.count(F.lit(1)).alias("total_symbols"))


def scan_delta(scans: DataFrame) -> DataFrame:
    """By workspace with two scans or more: last less first, and the time between."""
    what, when = F.struct("files_scanned", "chunks_created", "ts"), F.struct("ts", "seq")
    ends = scans.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("scans"), F.min_by(what, when).alias("a"), F.max_by(what, when).alias("z")).filter("scans > 1")
    milli = F.unix_millis(F.col("z.ts").cast("timestamp")) - F.unix_millis(F.col("a.ts").cast("timestamp"))
    return ends.select("workspace_id", (F.col("z.files_scanned") - F.col("a.files_scanned")).alias("files_delta"), (F.col("z.chunks_created") - F.col("a.chunks_created")).alias("chunks_delta"), milli.alias("time_span_ms"))


def last_scan(scans: DataFrame) -> DataFrame:
    return scans.groupBy("workspace_id").agg(F.max("ts").alias("last_indexed"))


def top_folders(files: DataFrame) -> DataFrame:
    return files.select("workspace_id", paths.top_folder(F.col("file_path")).alias("folder")).filter("folder is not null").distinct()


def most_used(edges: DataFrame, end: str, name: str, k: int = 10) -> DataFrame:
    """The k symbols that stand most often at an end of edges, by workspace."""
    counted = edges.groupBy("workspace_id", F.col(end).alias("symbol")).agg(F.count(F.lit(1)).alias(name))
    w = Window.partitionBy("workspace_id").orderBy(F.col(name).desc(), "symbol")
    return counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def most_imported(edges: DataFrame, k: int = 10) -> DataFrame:
    return most_used(edges, "target_symbol", "import_count", k)


def most_dependent(edges: DataFrame, k: int = 10) -> DataFrame:
    return most_used(edges, "source_symbol", "dependency_count", k)


def graph_summary(edges: DataFrame) -> DataFrame:
    """By workspace: symbols, dependencies, average, and the symbol most imported and most dependent (the first of equals by name)."""
    ends = edges.select("workspace_id", "source_symbol", "target_symbol", F.explode(F.array(F.struct(F.lit(1).alias("out"), F.col("source_symbol").alias("symbol")), F.struct(F.lit(0).alias("out"), F.col("target_symbol").alias("symbol")))).alias("e"))
    degree = ends.groupBy("workspace_id", "e.symbol").agg(F.count_if(F.col("e.out") == 0).alias("ins"), F.count_if(F.col("e.out") == 1).alias("outs"))
    first = lambda c: F.min(F.struct(-F.col(c), F.col("symbol").alias("symbol")))
    by = degree.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("total_symbols"), F.sum("outs").alias("total_dependencies"), first("ins").alias("i"), F.max("ins").alias("most_imported_count"), first("outs").alias("o"), F.max("outs").alias("most_dependent_count"))
    return by.select("workspace_id", "total_symbols", "total_dependencies", (F.col("total_dependencies") / F.col("total_symbols")).alias("avg_dependencies"), F.col("i.symbol").alias("most_imported"), "most_imported_count", F.col("o.symbol").alias("most_dependent"), "most_dependent_count")


def tree_nodes(files: DataFrame, chunks: DataFrame, glob: str | None = None, max_depth: int = 10) -> DataFrame:
    """Every folder and file of the file tree once: workspace_id, parent, name, depth (from 0), is_file, symbols."""
    symbols = chunks.groupBy("workspace_id", "file_path").agg(F.count(F.lit(1)).alias("symbols"))
    return tree_nodes_of(files.select("workspace_id", "file_path").join(symbols, ["workspace_id", "file_path"], "left"), glob, max_depth)


def tree_nodes_of(rollups: DataFrame, glob: str | None = None, max_depth: int = 10) -> DataFrame:
    """The same from rows with the symbols of each file."""
    counted = rollups.filter(paths.matches_glob(F.col("file_path"), glob)) if glob else rollups
    steps = F.filter(F.split("file_path", "/"), lambda s: s != "")
    up = counted.withColumn("steps", steps).select("workspace_id", "symbols", "steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("n")).filter(F.col("n") <= max_depth + 1)
    node = up.select("workspace_id", F.array_join(F.slice("steps", 1, F.col("n") - 1), "/").alias("parent"), F.element_at("steps", F.col("n")).alias("name"), (F.col("n") - 1).alias("depth"), (F.col("n") == F.size("steps")).alias("is_file"), F.when(F.col("n") == F.size("steps"), F.coalesce("symbols", F.lit(0))).otherwise(0).alias("symbols"))
    return node.groupBy("workspace_id", "parent", "name", "depth", "is_file").agg(F.max("symbols").alias("symbols"))
