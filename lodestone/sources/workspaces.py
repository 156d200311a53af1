"""Workspaces: the nearest folder upwards that holds a marker file."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text

# Markers by priority, and the kind of project they mark.
MARKERS = {
    "pyproject.toml": "python", "setup.py": "python", "go.mod": "go", "package.json": "javascript", "Cargo.toml": "rust", "pom.xml": "java", ".csproj": "csharp", "Gemfile": "ruby", "composer.json": "php",
}


@dataclass(frozen=True)
class Workspace:
    id: str
    name: str
    root: str
    marker_type: str


def id_of(root: str) -> str:
    return hashlib.sha256(root.encode()).hexdigest()[:12]


def detect(directory: str) -> Workspace | None:
    """The workspace of a local folder. The root of the file system is never one."""
    at = Path(directory).resolve()
    while at != at.parent:
        names = {p.name for p in at.iterdir() if p.is_file()} if at.is_dir() else set()
        for marker in MARKERS:
            if marker in names or (marker == ".csproj" and any(n.endswith(".csproj") for n in names)):
                return Workspace(id_of(str(at)), at.name, str(at), marker)
        at = at.parent
    return None


def roots(files: DataFrame) -> DataFrame:
    """One row per file (file_path) that lies in a workspace: root, marker_type and workspace_id. Every ancestor folder is joined with the
    folders that hold markers; the deepest wins, then the marker's priority."""
    path, name = F.col("file_path"), paths.name_of(F.col("file_path"))
    order = F.create_map(*[x for k, m in enumerate(MARKERS) for x in (F.lit(m), F.lit(k))])
    marker = F.when(name.endswith(".csproj"), F.lit(".csproj")).otherwise(name)
    marked = files.select(paths.folder_of(path).alias("root"), marker.alias("marker_type")).filter(F.col("marker_type").isin(*MARKERS) & (F.col("root") != "")).distinct()
    steps = F.split(paths.folder_of(path), "/")
    up = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("root"))
    first = Window.partitionBy("file_path").orderBy(F.size(F.split("root", "/")).desc(), order[F.col("marker_type")])
    best = up.join(marked, "root").withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank")
    return best.select("file_path", "root", "marker_type", text.workspace_id(F.col("root")).alias("workspace_id"))
