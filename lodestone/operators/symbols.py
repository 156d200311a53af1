"""Lookups of symbols: by name, by line, by containment, by dependency.

Containment goes by dyadic bins: a range of lines is the union of at most two bins of each size that is a power of two, which don't overlap, and a line is in one bin of each size. So a line is
inside a range exactly where they share a bin, which they do once: an equi-join on file and bin, whose keys split a file of many symbols, in place of one on the file alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUNCTIONS, TYPES = ("function", "method"), ("class", "interface", "struct", "type")
WHERE = ["file_path", "start_line", "end_line"]


def bins_of_range(first: Column, last: Column) -> Column:
    """The bins (size as a power of two, number) that make up the lines from ``first`` to ``last``; none if ``last`` is before."""
    stop = last.cast("long") + 1

    def of(k: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        a, b = F.call_function("shiftright", first.cast("long") + one - 1, k), F.call_function("shiftright", stop, k)
        bin_ = lambda yes, n: F.when((a < b) & yes, F.struct(k.cast("int").alias("size"), n.alias("n")))
        return F.array(bin_(a % 2 == 1, a), bin_(b % 2 == 1, b - 1))

    most = F.greatest(F.ceil(F.log2(F.greatest(stop - first, F.lit(1)).cast("double"))), F.lit(0)).cast("int")
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), most), of)))


def lines_inside(ranges: DataFrame, lines: DataFrame, first: str, last: str, line: str) -> DataFrame:
    """Pairs of rows of one (workspace_id, file_path) where ``line`` is from ``first`` to ``last``: structs r and l."""
    key = ["workspace_id", "file_path", "bin"]
    binned = ranges.select(*key[:2], F.struct(*ranges.columns).alias("r"), F.explode(bins_of_range(F.col(first), F.col(last))).alias("bin"))
    # No line has a bin of a size that no range has.
    most = ranges.agg(F.coalesce(F.max(F.ceil(F.log2(F.greatest(F.col(last).cast("long") - F.col(first) + 1, F.lit(1)).cast("double")))), F.lit(0)).cast("int")).scalar()
    spread = lines.select(*key[:2], F.struct(*lines.columns).alias("l"), F.explode(F.sequence(F.lit(0), most)).alias("size"))
    spread = spread.select(*key[:2], "l", F.struct("size", F.call_function("shiftright", F.col(f"l.{line}").cast("long"), F.col("size")).alias("n")).alias("bin"))
    return binned.join(spread, key).select("r", "l")


def function_details(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """The first function or method, by file and line, of each (workspace_id, name) asked for."""
    asked = chunks.filter(F.col("type").isin(*FUNCTIONS)).join(names.select("workspace_id", "name").distinct(), ["workspace_id", "name"], "left_semi")
    w = Window.partitionBy("workspace_id", "name").orderBy("file_path", "start_line", "end_line")
    return asked.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def first_function(chunks: DataFrame, workspace: str, name: str) -> DataFrame:
    """The same for one name: no shuffle but that of the top row."""
    return chunks.filter((F.col("workspace_id") == workspace) & (F.col("name") == name) & F.col("type").isin(*FUNCTIONS)).orderBy(*WHERE).limit(1)


def first_type(chunks: DataFrame, workspace: str, name: str) -> DataFrame:
    return chunks.filter((F.col("workspace_id") == workspace) & (F.col("name") == name) & F.col("type").isin(*TYPES)).orderBy(*WHERE).limit(1)


def with_methods(types: DataFrame, chunks: DataFrame) -> DataFrame:
    """Types with the methods inside their lines, by line."""
    key = ["workspace_id", "file_path", "start_line", "end_line", "name", "package", "type"]
    methods = chunks.filter("type = 'method'").select(*key[:2], "start_line", "end_line", "name")
    pairs = lines_inside(types.select(*key), methods, "start_line", "end_line", "start_line").filter("l.end_line <= r.end_line")
    inside = pairs.groupBy(*[F.col(f"r.{c}").alias(c) for c in key]).agg(F.array_sort(F.collect_list(F.struct("l.start_line", "l.end_line", "l.name"))).alias("methods"))
    t, m = types.select(*key).distinct().alias("t"), inside.alias("m")
    out = t.join(m, [F.col(f"t.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key], "left")
    none = F.array().cast("array<struct<start_line: int, end_line: int, name: string>>")
    out = out.select(*[f"t.{c}" for c in key], F.coalesce("m.methods", none).alias("methods"))
    return out.withColumn("full_name", F.when(F.coalesce("package", F.lit("")) != "", F.concat_ws(".", "package", "name")).otherwise(F.col("name")))


def enclosing(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """Symbols around each point (workspace_id, file_path, line), innermost first by ``depth``."""
    pairs = lines_inside(chunks.select("workspace_id", "file_path", "type", "name", "start_line", "end_line"), points.select("workspace_id", "file_path", "line"), "start_line", "end_line", "line")
    hit = pairs.select("l.workspace_id", "l.file_path", "l.line", *[f"r.{k}" for k in ("type", "name", "start_line", "end_line")])
    w = Window.partitionBy("workspace_id", "file_path", "line").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "name", "type")
    return hit.withColumn("depth", F.row_number().over(w))


def around(chunks: DataFrame, workspace: str, file_path: str, line: int) -> DataFrame:
    """The same for one point, of whose file the symbols are read."""
    own = chunks.filter((F.col("workspace_id") == workspace) & (F.col("file_path") == file_path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    return own.select("name", "type", "start_line", "end_line").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "name", "type")


def package_exports(chunks: DataFrame, workspace: str, package_path: str) -> DataFrame:
    """Public names in files whose path contains ``package_path``, sorted."""
    own = chunks.filter((F.col("workspace_id") == workspace) & F.col("file_path").contains(package_path) & ~F.col("name").startswith("_"))
    return own.select("name").distinct().orderBy("name")


def dependencies(edges: DataFrame, workspace: str, symbol: str) -> DataFrame:
    """Edges with the symbol at either end."""
    return edges.filter((F.col("workspace_id") == workspace) & ((F.col("source_symbol") == symbol) | (F.col("target_symbol") == symbol)))


def callers(edges: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (workspace_id, symbol, source_symbol, file_path) of edges to each (workspace_id, symbol); the path is null where no symbol has the name."""
    return _ends(edges, chunks, symbols, "target_symbol", "source_symbol")


def targets(edges: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The mirror image of ``callers``, with target_symbol."""
    return _ends(edges, chunks, symbols, "source_symbol", "target_symbol")


def _ends(edges: DataFrame, chunks: DataFrame, symbols: DataFrame, asked: str, given: str) -> DataFrame:
    hit = edges.select("workspace_id", "source_symbol", "target_symbol").withColumnRenamed(asked, "symbol").join(symbols.select("workspace_id", "symbol").distinct(), ["workspace_id", "symbol"])
    named = chunks.select("workspace_id", F.col("name").alias(given), "file_path").distinct()
    return hit.select("workspace_id", "symbol", given).distinct().join(named, ["workspace_id", given], "left").select("workspace_id", "symbol", given, "file_path")
