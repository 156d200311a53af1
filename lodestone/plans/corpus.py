"""The index tables as seen over the driver's Parquet tables: documents become files and symbols, other tables edges, scans and events.

``SQL`` defines the same relations for DuckDB, so every registered query has a twin that starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, tags, text

FOLDERS = ("src", "tests", "docs", "api", "models", "utils", "node_modules", "core")
STEMS = ("doc_{}", "user_route_{}", "item_model_{}", "auth_middleware_{}", "x{}_test", "package-lock{}")
SUFFIXES = (".py", ".js", ".ts", ".go", ".cs", ".md", ".json", ".rs", ".txt", ".lock", ".min.js", ".env", ".JAVA")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts in fewer splits than there are cores (a small file is one row group) are dealt out first, or one core would do all the work on them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workspace_id, file_path, source, size_bytes, file_hash, doc_id of every document."""
    d = read(spark, sf_dir, "documents")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % n + 1).cast("int"))
    stem = F.replace(pick(STEMS, len(STEMS)), F.lit("{}"), F.col("doc_id").cast("string"))
    path = F.concat(F.lit("/work/"), "d.source", F.lit("/"), pick(FOLDERS, len(FOLDERS)), F.lit("/"), stem, pick(SUFFIXES, len(SUFFIXES)))
    out = d.alias("d").select("doc_id", text.workspace_id(F.concat(F.lit("/work/"), "d.source")).alias("workspace_id"), path.alias("file_path"), F.coalesce("d.text", F.lit("")).alias("content"))
    return out.select("doc_id", "workspace_id", "file_path", F.col("content").alias("source"), F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("file_hash"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the documents: a class over all lines, and one symbol for each line, which reaches two lines further at most."""
    f = files(spark, sf_dir).withColumn("lines", F.split("source", "\n"))
    whole = F.array(F.struct(F.lit(0).alias("k"), F.lit("").alias("line")))
    each = F.transform("lines", lambda x, i: F.struct((i + 1).alias("k"), x.alias("line")))
    rows = f.select("doc_id", "workspace_id", "file_path", F.size("lines").alias("n"), F.explode(F.concat(whole, each)).alias("s")).select("doc_id", "workspace_id", "file_path", "n", "s.k", "s.line")
    kind = F.when(F.col("k") == 0, "class").when(F.col("k") % 3 == 1, "method").when(F.col("k") % 3 == 2, "function").otherwise("config")
    name = F.when(F.col("k") == 0, F.concat(F.lit("C"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.when(F.col("k") % 5 == 0, F.lit("_")).otherwise(F.lit("")), F.lower(F.regexp_extract("line", r"^[^ ]*", 0))))
    return rows.select(
        "doc_id", "workspace_id", "file_path", kind.alias("type"), name.alias("name"), F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string")).alias("package"),
        F.greatest("k", F.lit(1)).alias("start_line"), F.when(F.col("k") == 0, F.col("n")).otherwise(F.least(F.col("k") + 2, F.col("n"))).alias("end_line"), F.col("line").alias("code"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One searchable row per document, with tags by path."""
    f = files(spark, sf_dir)
    path = F.col("file_path")
    return f.select(
        F.col("doc_id").alias("id"), "workspace_id", "file_path", F.concat(F.lit("sym_"), (F.col("doc_id") % 50).cast("string")).alias("symbol_name"), F.col("source").alias("code"),
        F.element_at(F.split("source", "\n"), 1).alias("docstring"), paths.language_of(path).alias("language"), tags.path_tags(path, paths.language_of(path)).alias("tags"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links between part and supplier numbers of a workspace of line items."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("w"), (F.col("l_linenumber") % 3).cast("string")).alias("workspace_id"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("source_symbol"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("target_symbol")).distinct()


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with few cycles, which grow with the table: a supplier's number leads to its nation's and to its double, by the number of suppliers."""
    s = read(spark, sf_dir, "supplier")
    k, double = F.col("s_suppkey"), F.col("s_suppkey") * 2 % s.agg(F.count(F.lit(1))).scalar()
    ends = F.array(F.concat(F.lit("n"), double.cast("string")), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")))
    return s.select(F.lit("w").alias("workspace_id"), F.concat(F.lit("n"), k.cast("string")).alias("source_symbol"), F.explode(ends).alias("target_symbol")).distinct()


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as scans of a workspace."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("ws"), F.col("o_custkey").cast("string")).alias("workspace_id"), F.col("o_orderkey").alias("files_scanned"), F.round("o_totalprice").cast("long").alias("chunks_created"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as changes of a file."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "moved").otherwise("modified")
    suffix = F.when(F.col("user_id") % 4 == 3, ".bin").otherwise(".py")
    folder = F.when(F.col("user_id") % 5 == 4, "node_modules").otherwise("src")
    path = F.concat(F.lit("/r/"), folder, F.lit("/u"), F.col("user_id").cast("string"), suffix)
    return e.select(kind.alias("event_type"), path.alias("file_path"), F.concat(F.lit("/r/src/moved"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, ".py").otherwise(".bin")).alias("dest_path"), (F.col("event_id") % 17 == 0).alias("is_directory"), F.col("ts").cast("timestamp").alias("ts"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL = {
    "files": f"""files AS (SELECT doc_id, substr(sha256('/work/' || source), 1, 12) AS workspace_id,
  '/work/' || source || '/' || ({_list(FOLDERS)})[doc_id % {len(FOLDERS)} + 1] || '/' || replace(({_list(STEMS)})[doc_id % {len(STEMS)} + 1], '{{}}', doc_id::VARCHAR) || ({_list(SUFFIXES)})[doc_id % {len(SUFFIXES)} + 1] AS file_path,
  coalesce(text, '') AS source, strlen(coalesce(text, ''))::BIGINT AS size_bytes, sha256(coalesce(text, '')) AS file_hash FROM documents)""",
    "chunks": """lined AS (SELECT *, string_split(source, chr(10)) AS lines FROM files),
keyed AS (SELECT doc_id, workspace_id, file_path, len(lines) AS n, unnest(range(0, len(lines) + 1)) AS k, lines FROM lined),
chunks AS (SELECT doc_id, workspace_id, file_path, CASE WHEN k = 0 THEN 'class' WHEN k % 3 = 1 THEN 'method' WHEN k % 3 = 2 THEN 'function' ELSE 'config' END AS type,
  CASE WHEN k = 0 THEN 'C' || doc_id ELSE CASE WHEN k % 5 = 0 THEN '_' ELSE '' END || lower(regexp_extract(lines[k], '^[^ ]*')) END AS name,
  'p' || (doc_id % 7) AS package, greatest(k, 1) AS start_line, CASE WHEN k = 0 THEN n ELSE least(k + 2, n) END AS end_line FROM keyed)""",
    "edges": """edges AS (SELECT DISTINCT 'w' || (l_linenumber % 3) AS workspace_id, 'n' || l_partkey AS source_symbol, 'n' || l_suppkey AS target_symbol FROM lineitem)""",
    "sparse": """sparse AS (SELECT DISTINCT 'w' AS workspace_id, 'n' || s_suppkey AS source_symbol, unnest(['n' || (s_suppkey * 2 % (SELECT count(*) FROM supplier)), 'c' || s_nationkey]) AS target_symbol FROM supplier)""",
    "scans": """scans AS (SELECT 'ws' || o_custkey AS workspace_id, o_orderkey AS files_scanned, round(o_totalprice)::BIGINT AS chunks_created, o_orderdate AS ts, o_orderkey AS seq FROM orders)""",
    "changes": """changes AS (SELECT CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS event_type,
  '/r/' || CASE WHEN user_id % 5 = 4 THEN 'node_modules' ELSE 'src' END || '/u' || user_id || CASE WHEN user_id % 4 = 3 THEN '.bin' ELSE '.py' END AS file_path,
  '/r/src/moved' || user_id || CASE WHEN user_id % 3 = 0 THEN '.py' ELSE '.bin' END AS dest_path, event_id % 17 = 0 AS is_directory, ts FROM events)""",
}


def with_sql(*names: str) -> str:
    """The WITH clause of these relations, in order."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
