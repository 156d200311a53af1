"""Source trees as DataFrames: a listing without contents first; only files that pass every filter are read.

Spark's own file sources leave out names that start with ``_`` or ``.``, and with them every ``__init__.py``; this one lists all files. Folders
are listed by executors: the driver looks into the upper ones only, until there are enough to keep all cores busy. Contents are read where the listing's rows are."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import EXCLUDES, EXTENSIONS
from ..functions import paths, text

#: Bytes of contents that a batch carries at most, and files.
BATCH_BYTES, BATCH_FILES = 64 << 20, 256
#: Folders that are enough partitions for a listing, and those that the driver looks into, after which it goes no level deeper.
ENOUGH, MOST_OPENED = 64, 256


def file_system(path: str):
    """File system and path on it, of a local path or of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)



class Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.recursive, self.files = options.get("path", ""), options.get("recursive", "true").lower() == "true", json.loads(options.get("files", "null"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        if self.files is not None:
            return [Folder("", False)]
        system, root = file_system(self.root)
        if not self.recursive:
            return [Folder(root, False)]
        # Level by level: a folder that the driver has looked into is a partition with its own files, those found in it are ones with all below them.
        opened, level = [], [root]
        while level and len(level) < ENOUGH and len(opened) < MOST_OPENED:
            opened += level
            level = [x.path for f in level for x in system.get_file_info(fs.FileSelector(f, allow_not_found=True)) if x.type == fs.FileType.Directory]
        return [Folder(f, False) for f in opened] + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        if self.files is not None:
            found = [x for f in self.files for x in (file_system(f)[0].get_file_info([file_system(f)[1]]))]
        else:
            found = file_system(self.root)[0].get_file_info(fs.FileSelector(partition.path, recursive=partition.recursive, allow_not_found=True))
        for x in found:
            if x.type == fs.FileType.File:
                yield x.path, x.size


class SourceTree(DataSource):
    """``format("source_tree")``; options: path, recursive, or files (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file_path string, size_bytes long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """file_path and size_bytes of every file below ``root``."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("path", root).option("recursive", str(recursive).lower()).load()


def named(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """The same for named files; those that don't exist are left out."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("files", json.dumps(list(files))).load()


def stated(files: DataFrame) -> DataFrame:
    """The same for a table of paths (file_path): each once, sizes asked for where the rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for x in batches:
            rows = []
            for path in x["file_path"]:
                system, own = file_system(path)
                if (found := system.get_file_info([own])[0]).type == fs.FileType.File:
                    rows.append((own, found.size))
            if rows:
                yield pd.DataFrame(rows, columns=["file_path", "size_bytes"])

    return files.select("file_path").distinct().mapInPandas(run, "file_path string, size_bytes long")


def wanted(files: DataFrame, root: str, extensions: Iterable[str] = EXTENSIONS, excludes: Iterable[str] = EXCLUDES) -> DataFrame:
    """Files with a supported suffix that no pattern excludes, with their language."""
    path = F.col("file_path")
    kept = files.filter(paths.supported(path, extensions) & ~paths.is_excluded(path, excludes, root))
    return kept.withColumn("language", paths.language_of(path))


def within_size(files: DataFrame, megabytes: float) -> DataFrame:
    return files.filter(F.col("size_bytes") <= F.lit(int(megabytes * 1048576)))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Files with their bytes; one that is gone meanwhile is left out. A batch carries BATCH_BYTES at most, or a single file."""
    names = files.columns
    schema = files.withColumn("content", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = file_system(root)[0]
        for x in batches:
            rows, load = [], 0
            for row in x.itertuples(index=False, name=None):
                try:
                    with system.open_input_stream(row[names.index("file_path")]) as f:
                        data = f.read()
                except OSError:
                    continue
                if rows and (load + len(data) > BATCH_BYTES or len(rows) == BATCH_FILES):
                    yield pd.DataFrame(rows, columns=schema.fieldNames())
                    rows, load = [], 0
                rows.append((*row, data))
                load += len(data)
            if rows:
                yield pd.DataFrame(rows, columns=schema.fieldNames())

    # A listing comes by folders, and named files in one piece; what is read is dealt out evenly. A number is told, because the rows say nothing of what they stand for.
    return files.repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "file_path").mapInPandas(run, schema)


def with_source(files: DataFrame, root: str) -> DataFrame:
    """Files with file_hash and source text."""
    return with_content(files, root).withColumns({"file_hash": F.sha2("content", 256), "source": text.decoded(F.col("content"))}).drop("content")


def with_package(files: DataFrame, listing_: DataFrame) -> DataFrame:
    """Files with their package: folders of the listing that hold an ``__init__.py`` are joined to each file's ancestors."""
    folders = listing_.filter(F.col("file_path").endswith("/__init__.py")).select(paths.folder_of(F.col("file_path")).alias("folder")).distinct()
    depth = F.size(F.split(paths.folder_of(F.col("file_path")), "/"))
    up = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(depth, F.lit(2))), lambda n: F.array_join(F.slice(F.split(paths.folder_of(F.col("file_path")), "/"), 1, n), "/"))).alias("folder"))
    found = up.join(folders, "folder").groupBy("file_path").agg(F.collect_set("folder").alias("package_dirs"))
    own = files.join(found, "file_path", "left").withColumn("package_dirs", F.coalesce("package_dirs", F.array().cast("array<string>")))
    # The chain ends at the first folder without an __init__.py on the way up: all folders from there down are packages.
    whole = lambda d: F.size(F.filter("package_dirs", lambda e: e.startswith(d))) == depth - F.size(F.split(d, "/")) + 1
    return own.withColumn("package", paths.infer_package(F.col("file_path"), F.filter("package_dirs", whole))).drop("package_dirs")


def with_found_package(files: DataFrame, root: str) -> DataFrame:
    """The same for few files of a large tree: the folders above each are asked for their ``__init__.py``, and nothing is listed."""
    names = files.columns
    schema = files.withColumn("package_dirs", F.lit(None).cast("array<string>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, known = file_system(root)[0], {}

        def packages(folder: str) -> list[str]:
            if folder not in known:
                is_one = "/" in folder and system.get_file_info([f"{folder}/__init__.py"])[0].type == fs.FileType.File
                known[folder] = [*packages(folder.rpartition("/")[0]), folder] if is_one else []
            return known[folder]

        for x in batches:
            yield x[names].assign(package_dirs=[packages(p.rpartition("/")[0]) for p in x["file_path"]])

    return files.mapInPandas(run, schema).withColumn("package", paths.infer_package(F.col("file_path"), F.col("package_dirs"))).drop("package_dirs")
