"""Dependency graphs: adjacency, breadth-first search, cycles. One join per level; what is found is written between levels. Cycles of any
length are found in Python, where a task holds a strongly connected component."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import defaultdict, deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The table, computed once and written to the shared folder named in ``spark.checkpoint.dir``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        told = context.getConf().get("spark.checkpoint.dir", None)
        if not told:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            if "LODESTONE_SCRATCH" not in os.environ:
                os.environ["LODESTONE_SCRATCH"] = tempfile.mkdtemp(prefix="lodestone-")
            told = f"file://{os.environ['LODESTONE_SCRATCH']}"
        context.setCheckpointDir(told)
    return df.checkpoint()


class Steps:
    """Tables between the steps of a loop, written to the shared folder. Unlike a checkpoint, a table read from files has its own size: estimates of joins of joins would
    grow in each step. ``end`` writes the result and deletes the others."""

    def __init__(self, df: DataFrame):
        cut(df.limit(0))  # sets the folder
        self.spark, self.n = df.sparkSession, 0
        self.base = f"{self.spark.sparkContext.getCheckpointDir()}/steps-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        self.n += 1
        df.write.parquet(path := f"{self.base}/{name or self.n}")
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self, df: DataFrame) -> DataFrame:
        out = self.keep(df, "result")
        for k in range(1, self.n):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{k}")
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        return out


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """symbol and the sorted symbols it leads to (or comes from, reversed)."""
    a, b = ("target_symbol", "source_symbol") if reverse else ("source_symbol", "target_symbol")
    return edges.groupBy("workspace_id", F.col(a).alias("symbol")).agg(F.array_sort(F.collect_set(b)).alias("linked"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("workspace_id", F.col("source_symbol").alias("symbol")).union(edges.select("workspace_id", "target_symbol")).distinct()


def breadth_first(edges: DataFrame, entries: DataFrame, max_depth: int | None = None) -> DataFrame:
    """From each entry (workspace_id, entry): entry, symbol, depth, and parent, the first by name of the symbols that discover it (null for the
    entry). An entry that no edge has gives nothing. A symbol at ``max_depth`` isn't expanded."""
    links = edges.select("workspace_id", F.col("source_symbol").alias("symbol"), F.col("target_symbol").alias("next")).distinct()
    key = ["workspace_id", "entry", "symbol"]
    known = nodes(edges)
    seen = cut(entries.select("workspace_id", "entry", F.col("entry").alias("symbol")).join(known, ["workspace_id", "symbol"], "left_semi").select(*key, F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    front, depth = seen, 0
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        depth += 1
        step = front.select(*key).join(links, ["workspace_id", "symbol"]).groupBy("workspace_id", "entry", F.col("next").alias("symbol")).agg(F.min("symbol").alias("parent"))
        front = cut(step.join(seen.select(*key), key, "left_anti").select(*key, F.lit(depth).alias("depth"), "parent"))
        seen = seen.unionByName(front)
    return seen


#: Edges of a component for each part that its symbols are searched in.
PART = 1_000


def shortest_cycles(pairs: Iterable[tuple[str, str]], wanted: set[str] | None = None) -> set[tuple[str, ...]]:
    """The shortest cycle through each edge that is on one and leads to a wanted symbol (all if None), closed, from its smallest symbol; of equals,
    the first that a search in the order of names comes to."""
    ahead, behind = defaultdict(list), defaultdict(list)
    for a, b in sorted(pairs):
        ahead[a].append(b)
        behind[b].append(a)
    found = set()
    for start in behind if wanted is None else wanted & behind.keys():
        parent, queue, left = {start: start}, deque([start]), set(behind[start]) - {start}
        while queue and left:
            a = queue.popleft()
            for b in ahead.get(a, ()):
                if b not in parent:
                    parent[b] = a
                    queue.append(b)
                    left.discard(b)
        for end in behind[start]:
            if end in parent:
                way = [end]
                while way[-1] != start:
                    way.append(parent[way[-1]])
                way.reverse()
                k = way.index(min(way))
                found.add((*way[k:], *way[: k + 1]))
    return found


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """workspace_id and path, closed, from its smallest symbol, of cycles of any length: for each edge on a cycle the shortest one through it, each
    once, so every symbol and edge on a cycle is in one. With ``max_length``, all simple cycles of up to so many symbols instead."""
    from . import components

    core = cut(components.on_cycles(edges, components.components(edges)))
    if max_length is not None:
        return simple_cycles(core.drop("component"), max_length)
    most = core.sparkSession.sparkContext.defaultParallelism
    sizes = core.groupBy("workspace_id", "component").agg(F.least(F.lit(most), F.lit(1) + F.floor(F.count(F.lit(1)) / PART)).cast("int").alias("parts"))

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(x["a"], x["b"], strict=True))
        names = sorted({b for _, b in pairs})
        return pd.DataFrame([(key[0], list(c)) for c in shortest_cycles(pairs, set(names[key[2] :: int(x["parts"].iloc[0])]))], columns=["workspace_id", "path"])

    # A cycle stays inside its component. Each part holds a component and searches from its share of the symbols.
    dealt = core.join(sizes, ["workspace_id", "component"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.groupBy("workspace_id", "component", "part").applyInPandas(run, "workspace_id string, path array<string>").distinct()


def simple_cycles(core: DataFrame, max_length: int) -> DataFrame:
    """All simple cycles of up to ``max_length`` symbols, each once. Paths grow from their smallest symbol only, so no rotation is made twice."""
    path = cut(core.filter("b >= a").select("workspace_id", F.array("a").alias("path"), F.col("b").alias("tip")))
    found, k = [], 1
    while True:
        found.append(path.filter(F.col("tip") == F.col("path")[0]).select("workspace_id", F.concat("path", F.array("tip")).alias("path")))
        grown = path.filter(F.col("tip") != F.col("path")[0]).select("workspace_id", F.concat("path", F.array("tip")).alias("path"), F.col("tip").alias("a"))
        k += 1
        if k > max_length:
            break
        path = grown.join(core, ["workspace_id", "a"]).filter((F.col("b") >= F.col("path")[0]) & ((F.col("b") == F.col("path")[0]) | ~F.array_contains("path", F.col("b")))).select("workspace_id", "path", F.col("b").alias("tip"))
        path = cut(path)
        if path.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


