"""Rows of the index: change detection, upserts with the last one winning, deletions, scan history."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_KEY = ("workspace_id", "file_path", "start_line", "end_line")
FILE_KEY = ("workspace_id", "file_path")
#: Dropped workspaces up to which a plan holds them in a map; more are joined.
FEW = 100


def chunk_id() -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in CHUNK_KEY])


def last_wins(rows: DataFrame, key: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """Of the rows of each key the last by ``order``."""
    w = Window.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return rows.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def changed(scan: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Files of the scan whose content the index doesn't hold."""
    return scan if force else scan.join(files.select(*FILE_KEY, "file_hash"), [*FILE_KEY, "file_hash"], "left_anti")


def orphans(files: DataFrame, scan: DataFrame, workspace: str, root: str) -> DataFrame:
    """Indexed files of the workspace below ``root`` that the scan no longer has."""
    own = files.filter((F.col("workspace_id") == workspace) & F.col("file_path").startswith(root.rstrip("/") + "/"))
    return own.join(scan.select("file_path"), "file_path", "left_anti")


def _dropped(rows: DataFrame, gone: DataFrame, how: str) -> DataFrame:
    last = gone.groupBy(*FILE_KEY).agg(F.max("gone_no").alias("gone_no")).alias("g")
    r = rows.alias("r")
    return r.join(last, [F.col(f"r.{c}") == F.col(f"g.{c}") for c in FILE_KEY] + [F.col("r.commit_no") < F.col("g.gone_no")], how)


def without_dropped(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (with commit_no) but those of files that a later commit dropped; gone: workspace_id, file_path, gone_no."""
    return _dropped(rows, gone, "left_anti")


def only_dropped(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (with commit_no) of files that a later commit dropped."""
    return _dropped(rows, gone, "left_semi")


def without_workspaces(rows: DataFrame, dropped: dict[str, int], key: str = "workspace_id") -> DataFrame:
    """Rows (with commit_no) but those of workspaces that a later commit dropped; ``dropped`` names the commit."""
    if not dropped:
        return rows
    if len(dropped) <= FEW:
        last = F.create_map(*[F.lit(x) for pair in dropped.items() for x in pair])[F.col(key)]
        return rows.filter(last.isNull() | (F.col("commit_no") >= last))
    table = rows.sparkSession.createDataFrame(list(dropped.items()), f"{key} string, dropped_no long").alias("x")
    r = rows.alias("r")
    return r.join(table, (F.col(f"r.{key}") == F.col(f"x.{key}")) & (F.col("r.commit_no") < F.col("x.dropped_no")), "left_anti")


def edges_of(files: DataFrame, imports: Column) -> DataFrame:
    """Dependencies of files: the file's path to each imported name, once."""
    rows = files.select("workspace_id", F.col("file_path").alias("source_symbol"), F.explode(imports).alias("target_symbol"), "file_path").dropDuplicates(["workspace_id", "source_symbol", "target_symbol"])
    return rows.withColumn("symbols", F.array().cast("array<string>")).select("workspace_id", "source_symbol", "target_symbol", "symbols", "file_path")


def summary(scanned: DataFrame, indexed: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files_scanned, files_indexed, files_skipped, languages, total_chunks. Counts are made where the rows are; one row of each meets."""
    languages = indexed.groupBy("language").count()
    by = languages.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("files_indexed"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "count")))).alias("languages"))
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    out = by.withColumns({"files_scanned": count(scanned), "total_chunks": count(chunks)})
    return out.select("files_scanned", "files_indexed", (F.col("files_scanned") - F.col("files_indexed")).alias("files_skipped"), "languages", "total_chunks")
