"""Registered queries: each operator of the index over the driver's tables, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXCLUDES, EXTENSIONS
from ..functions import imports, paths, tags, text
from ..operators import components, graph, index, links, postings, search, stats, symbols, vectors
from ..sources import tree, workspaces
from ..streaming import debounce as bounce
from . import corpus
from .corpus import with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Fixed expressions of the twins.
NAME = "string_split(file_path, '/')[-1]"
SUFFIX = f"regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1)"
LANGUAGE = f"""CASE WHEN {NAME} = '.DS_Store' OR contains({NAME}, '-lock') OR {NAME} LIKE '%.lock' OR {NAME} LIKE '%.min.js' THEN NULL
 ELSE CASE lower({SUFFIX}) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items())} END END"""
PARTS = "list_contains(string_split(file_path, '/'), '{}')"
PLAIN_EXCLUDES = [p for p in EXCLUDES if not p.startswith("*")]
EXCLUDED = "(" + " OR ".join([PARTS.format(p) for p in PLAIN_EXCLUDES] + [f"regexp_matches({NAME}, '\\.{p[2:].replace('.', chr(92) + '.')}$') OR contains({NAME}, '-{p[2:]}')" for p in EXCLUDES if p.startswith("*.")]) + ")"


# Scans


@query("scan_exclusion", f"{with_sql('files')} SELECT doc_id, file_path, {EXCLUDED} AS excluded FROM files")
def scan_exclusion(spark, d):
    return corpus.files(spark, d).select("doc_id", "file_path", paths.is_excluded(F.col("file_path"), EXCLUDES).alias("excluded"))


@query("scan_extension", f"{with_sql('files')} SELECT doc_id, file_path FROM files WHERE {SUFFIX} IN ({quoted(EXTENSIONS)})")
def scan_extension(spark, d):
    return corpus.files(spark, d).filter(paths.supported(F.col("file_path"), EXTENSIONS)).select("doc_id", "file_path")


@query("scan_wanted", f"{with_sql('files')} SELECT doc_id, file_path, {LANGUAGE} AS language FROM files WHERE {SUFFIX} IN ({quoted(EXTENSIONS)}) AND NOT {EXCLUDED}")
def scan_wanted(spark, d):
    return tree.wanted(corpus.files(spark, d), "").select("doc_id", "file_path", "language")


@query("scan_size", f"{with_sql('files')} SELECT doc_id, size_bytes FROM files WHERE size_bytes <= 2097")
def scan_size(spark, d):
    return tree.within_size(corpus.files(spark, d), 0.002).select("doc_id", "size_bytes")


@query("scan_decode", "SELECT doc_id, coalesce(text, '') AS decoded FROM documents")
def scan_decode(spark, d):
    raw = corpus.read(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("FF"))).alias("content"))
    return raw.select("doc_id", text.decoded(F.col("content")).alias("decoded"))


@query("scan_language", f"{with_sql('files')} SELECT doc_id, {LANGUAGE} AS language FROM files")
def scan_language(spark, d):
    return corpus.files(spark, d).select("doc_id", paths.language_of(F.col("file_path")).alias("language"))


@query(
    "scan_workspace",
    f"""{with_sql('files')}, l AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN regexp_replace(file_path, '/[^/]*$', '') || '/go.mod' WHEN 1 THEN '/work/' || string_split(file_path, '/')[3] || '/pyproject.toml' WHEN 2 THEN regexp_replace(file_path, '/[^/]*$', '') || '/X.csproj' ELSE file_path END AS file_path FROM files),
m AS (SELECT DISTINCT regexp_replace(file_path, '/[^/]*$', '') AS root, CASE WHEN {NAME} LIKE '%.csproj' THEN '.csproj' ELSE {NAME} END AS marker_type FROM l WHERE {NAME} IN ('go.mod', 'pyproject.toml') OR {NAME} LIKE '%.csproj'),
u AS (SELECT DISTINCT file_path, array_to_string(string_split(file_path, '/')[1:n], '/') AS root FROM l, (SELECT unnest(range(1, 12)) AS n) WHERE n < len(string_split(file_path, '/'))),
r AS (SELECT u.file_path, root, marker_type, row_number() OVER (PARTITION BY u.file_path ORDER BY len(string_split(root, '/')) DESC, CASE marker_type WHEN 'pyproject.toml' THEN 0 WHEN 'go.mod' THEN 2 ELSE 6 END) AS k FROM u JOIN m USING (root))
SELECT file_path, root, marker_type, substr(sha256(root), 1, 12) AS workspace_id FROM r WHERE k = 1""",
)
def scan_workspace(spark, d):
    p, folder = F.col("file_path"), paths.folder_of(F.col("file_path"))
    k = F.col("doc_id") % 9
    moved = F.when(k == 0, F.concat(folder, F.lit("/go.mod"))).when(k == 1, F.concat(F.lit("/work/"), F.element_at(F.split(p, "/"), 3), F.lit("/pyproject.toml"))).when(k == 2, F.concat(folder, F.lit("/X.csproj"))).otherwise(p)
    return workspaces.roots(corpus.files(spark, d).select(moved.alias("file_path")).distinct())


@query("scan_workspace_id", "SELECT doc_id, substr(sha256('/work/' || source), 1, 12) AS workspace_id FROM documents")
def scan_workspace_id(spark, d):
    return corpus.files(spark, d).select("doc_id", "workspace_id")


@query("scan_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS file_hash FROM documents")
def scan_hash(spark, d):
    return corpus.read(spark, d, "documents").select("doc_id", text.sha256(F.coalesce("text", F.lit(""))).alias("file_hash"))


@query(
    "scan_package",
    f"""{with_sql('files')}, f AS (SELECT doc_id, file_path, regexp_replace({NAME}, '(.)\\.[^.]+$', '\\1') AS stem, string_split(file_path, '/') AS p FROM files)
SELECT doc_id, CASE WHEN p[4] IN ('core', 'src') THEN p[3] || '.' || p[4] || CASE WHEN {SUFFIX} = '.py' THEN '.' || stem ELSE '' END ELSE stem END AS package FROM f""",
)
def scan_package(spark, d):
    f = corpus.files(spark, d).select("doc_id", "file_path")
    steps = F.split("file_path", "/")
    top = F.concat(F.lit("/work/"), F.element_at(steps, 3))
    inits = f.filter(F.element_at(steps, 4).isin("core", "src")).select(F.explode(F.array(F.concat(top, F.lit("/__init__.py")), F.concat(top, F.lit("/"), F.element_at(steps, 4), F.lit("/__init__.py")))).alias("file_path")).distinct()
    listing = inits.unionByName(f.select("file_path"))
    named = tree.with_package(f, listing).select("doc_id", "package", "file_path")
    own = F.element_at(F.split("file_path", "/"), 4).isin("core", "src")
    stem = F.regexp_replace(paths.name_of(F.col("file_path")), r"(?<=.)\.[^.]+$", "")
    return named.select("doc_id", F.when(own, F.col("package")).otherwise(stem).alias("package"))


# Chunks and imports


@query(
    "chunk_whole_file",
    f"""{with_sql('files')}, f AS (SELECT *, {LANGUAGE} AS language FROM files)
SELECT doc_id, CASE WHEN language = 'doc' THEN 'doc' ELSE 'config' END AS type, {NAME} AS name, 1 AS start_line, len(string_split(source, chr(10))) AS end_line, sha256(source) AS code_hash FROM f WHERE language IN ('doc', 'config', 'rust', 'java')""",
)
def chunk_whole_file(spark, d):
    from ..operators import chunks as chunking

    f = corpus.files(spark, d).withColumn("language", paths.language_of(F.col("file_path"))).filter(F.col("language").isin("doc", "config", "rust", "java"))
    out = chunking.whole_file_chunks(f).join(f.select("doc_id", "workspace_id", "file_path"), ["workspace_id", "file_path"])
    return out.select("doc_id", "type", "name", "start_line", "end_line", F.sha2("code", 256).alias("code_hash"))


#: What the chunkers find in the generated sources: languages, type, name, package, first and last line, signature; {n} is the document's id.
GOLDEN = (
    ("python", "class", "C{n}", "pkg", 1, 3, "class C{n}"), ("python", "method", "m", "pkg.C{n}", 2, 3, "def m(self, x: int) -> int"), ("python", "function", "f{n}", "pkg", 5, 6, "async def f{n}(a, b=1)"),
    ("javascript", "class", "C{n}", "pkg", 1, 3, "class C{n} extends B"), ("javascript", "function", "f{n}", "pkg", 4, 6, "async function f{n}(a)"),
    ("typescript", "class", "C{n}", "pkg", 1, 3, "class C{n} extends B"), ("typescript", "function", "f{n}", "pkg", 4, 6, "async function f{n}(a)"),
    ("go", "method", "M{n}", "p", 3, 5, "func (s *S) M{n}(a int) error"), ("go", "class", "S", "p", 7, 9, "type S struct"),
    ("csharp", "class", "C{n}", "N.M", 3, 10, "class C{n}"), ("csharp", "method", "F", "N.M", 5, 9, "Task<int> F(int a)"),
)


@query(
    "chunk_symbols",
    f"""{with_sql('files')}, f AS (SELECT doc_id, file_path, {LANGUAGE} AS language FROM files),
g AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{t}', '{n}', '{p}', {i}, {j}, '{s}')" for k, t, n, p, i, j, s in GOLDEN)}) AS t(language, type, name, package, start_line, end_line, signature))
SELECT file_path, language, type, {', '.join(f"replace({c}, '{{n}}', doc_id::VARCHAR) AS {c}" for c in ('name', 'package', 'signature'))}, start_line, end_line FROM f JOIN g USING (language)""",
)
def chunk_symbols(spark, d):
    """Symbols of sources in every code language, through the chunkers: known code, and the document's whole text in a comment behind it."""
    from ..operators import chunks as chunking

    f = corpus.files(spark, d).withColumn("language", paths.language_of(F.col("file_path"))).filter(F.col("language").isin(*{g[0] for g in GOLDEN}))
    n, said = F.col("doc_id").cast("string"), F.regexp_replace("source", r"[^\P{Cntrl}\n]|\*/|\u2028|\u2029|\u0085", " ")
    code = {
        "python": "class C{n}:\n    def m(self, x: int) -> int:\n        return x\n\nasync def f{n}(a, b=1):\n    return a\n", "javascript": "export class C{n} extends B {\n  m() { return '}'; }\n}\nexport async function f{n}(a) {\n  return a;\n}\n",
        "go": "package p\n\nfunc (s *S) M{n}(a int) error {\n\treturn nil\n}\n\ntype S struct {\n\tA int\n}\n", "csharp": "namespace N.M\n{\n  public class C{n}\n  {\n    public static async Task<int> F(int a)\n    {\n      await G(a);\n      return a;\n    }\n  }\n}\n",
    }
    code["typescript"] = code["javascript"]
    body = F.lit("")
    for language, text_ in code.items():
        comment = F.concat(F.lit("# "), F.replace(said, F.lit("\n"), F.lit("\n# "))) if language == "python" else F.concat(F.lit("/* "), said, F.lit(" */"))
        body = F.when(F.col("language") == language, F.concat(F.replace(F.lit(text_), F.lit("{n}"), n), F.lit("\n"), comment, F.lit("\n"))).otherwise(body)
    return chunking.chunk_files(f.withColumns({"source": body, "package": F.lit("pkg")})).select("file_path", "language", "type", "name", "package", "start_line", "end_line", "signature")


@query("chunk_embed_text", "SELECT doc_id, substr(concat_ws(chr(10), 'sig' || doc_id, nullif(lang, 'en'), nullif(coalesce(text, ''), '')), 1, 8000) AS embed_text FROM documents")
def chunk_embed_text(spark, d):
    docs = corpus.read(spark, d, "documents")
    return docs.select("doc_id", text.embed_text(F.concat(F.lit("sig"), F.col("doc_id").cast("string")), F.nullif("lang", F.lit("en")), F.coalesce("text", F.lit(""))).alias("embed_text"))


@query(
    "chunk_metadata",
    """SELECT doc_id, to_json(struct_pack(lang := lang, n := n_chars)) AS fixed, CASE WHEN source <> 'src0' THEN source END AS meta_source, n_chars % 2 = 0 AS meta_even, '["' || lang || '","' || doc_id || '"]' AS meta_list,
'{"n":' || n_chars || '}' AS meta_object, length(coalesce(text, '')) AS meta_chars, CASE WHEN source <> 'src0' THEN 7 ELSE 6 END + CASE WHEN text IS NULL THEN 0 ELSE 1 END AS entries FROM documents WHERE lang IS NOT NULL""",
)
def chunk_metadata(spark, d):
    docs = corpus.read(spark, d, "documents").filter("lang is not null")
    extra = F.to_json(F.struct(
        F.when(F.col("source") != "src0", F.col("source")).alias("source"), (F.col("n_chars") % 2 == 0).alias("even"), F.array("lang", F.col("doc_id").cast("string")).alias("list"), F.struct(F.col("n_chars").alias("n")).alias("object"), F.col("text").alias("body"),
    ))
    flat = docs.select("doc_id", text.flat_metadata({"lang": F.col("lang"), "n": F.col("n_chars"), "none": F.lit(None).cast("string")}, F.parse_json(extra)).alias("m"))
    get = lambda k, kind: F.try_variant_get("m", f"$.{k}", kind)
    return flat.select(
        "doc_id", F.to_json(F.struct(get("lang", "string").alias("lang"), get("n", "bigint").alias("n"))).alias("fixed"), get("meta_source", "string").alias("meta_source"), get("meta_even", "boolean").alias("meta_even"),
        get("meta_list", "string").alias("meta_list"), get("meta_object", "string").alias("meta_object"), F.length(F.coalesce(get("meta_body", "string"), F.lit(""))).alias("meta_chars"), (F.size(F.map_keys(F.from_json(F.to_json("m"), "map<string,string>"))) + F.lit(1)).alias("entries"),
    )


@query("chunk_sanitize", r"SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g') AS clean FROM documents")
def chunk_sanitize(spark, d):
    dirty = F.concat(F.coalesce("text", F.lit("")), F.chr(F.lit(7)), F.chr(F.lit(127)))
    return corpus.read(spark, d, "documents").select("doc_id", text.sanitized(dirty).alias("clean"))


@query(
    "imports_patterns",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'm' || doc_id || ',n' WHEN 1 THEN 'fmt,os' || doc_id WHEN 2 THEN 'System.T' || doc_id ELSE 'k' || doc_id END AS imports FROM documents",
)
def imports_patterns(spark, d):
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    source = (
        F.when(k == 0, F.concat(F.lit('import a from "m'), n, F.lit('"\nimport "n"\nimport b from \'n\'')))
        .when(k == 1, F.concat(F.lit('import "fmt"\nimport (\n  "os'), n, F.lit('"\n  x "skip"\n)')))
        .when(k == 2, F.concat(F.lit("using System.T"), n, F.lit(";\nusing System.T"), n, F.lit(";")))
        .otherwise(F.concat(F.lit('from "k'), n, F.lit('"')))
    )
    # The whole text stands behind, as a comment.
    source = F.concat(source, F.lit("\n/* "), F.regexp_replace(F.coalesce("text", F.lit("")), "[\"';]", " "), F.lit(" */\n"))
    language = F.when(k == 0, "javascript").when(k == 1, "go").when(k == 2, "csharp").otherwise("rust")
    return corpus.read(spark, d, "documents").select("doc_id", F.array_join(imports.pattern_imports(source, language), ",").alias("imports"))


@query("imports_python", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'os.path,pkg' || doc_id || ',re' END AS imports FROM documents")
def imports_python(spark, d):
    n = F.col("doc_id").cast("string")
    source = F.when(F.col("doc_id") % 5 == 0, "def broken(:").otherwise(F.concat(F.lit("import os.path\nfrom pkg"), n, F.lit(" import x\nfrom . import y\ndef f():\n    import re\n"), F.lit("# "), F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\P{Cntrl}\n]", " "), F.lit("\n"), F.lit("\n# "))))
    return corpus.read(spark, d, "documents").select("doc_id", F.array_join(imports.python_imports(source), ",").alias("imports"))


@query(
    "imports_resolved",
    f"""{with_sql('files')}, f AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS p FROM files), a AS (SELECT file_path AS source_file, CASE WHEN len(p) % 2 = 1 THEN p[3] || '.src.' || regexp_extract(p[-1], '^[^.]*') ELSE '' END AS import, p FROM f WHERE file_path LIKE '%.py')
SELECT a.source_file, a.import, f.file_path AS resolved_path FROM a LEFT JOIN f ON f.file_path = '/work/' || replace(a.import, '.', '/') || '.py'""",
)
def imports_resolved(spark, d):
    from ..operators import resolve

    f = corpus.files(spark, d).select("file_path").distinct()
    steps = F.split("file_path", "/")
    name = F.concat(F.element_at(steps, 3), F.lit(".src."), F.regexp_extract(paths.name_of(F.col("file_path")), r"^[^.]*", 0))
    asked = f.filter(F.col("file_path").endswith(".py")).select(F.col("file_path").alias("source_file"), F.lit("python").alias("language"), F.when(F.size(steps) % 2 == 1, name).otherwise("").alias("import"))
    return resolve.resolved(asked, f, "/work").select("source_file", "import", "resolved_path")


# Tags

LOW = "lower(file_path)"


def parts_sql(words, on: str = LOW) -> str:
    return "(" + " OR ".join(f"list_contains(string_split({on}, '/'), '{w}')" for w in words) + ")"


TAG_SQL = {
    "lang": f"CASE WHEN {LANGUAGE} IS NOT NULL THEN 'lang:' || {LANGUAGE} END",
    "layer:api": f"CASE WHEN {parts_sql(tags.LAYERS['layer:api'][0])} OR contains(lower({NAME}), 'route') THEN 'layer:api' END",
    "layer:middleware": f"CASE WHEN {parts_sql(['middleware'])} OR contains(lower({NAME}), 'middleware') OR contains(lower({NAME}), 'interceptor') THEN 'layer:middleware' END",
    "layer:model": f"CASE WHEN {parts_sql(tags.LAYERS['layer:model'][0])} OR contains(lower({NAME}), 'model') THEN 'layer:model' END",
    "layer:service": f"CASE WHEN {parts_sql(tags.LAYERS['layer:service'][0])} THEN 'layer:service' END",
    "layer:utils": f"CASE WHEN {parts_sql(tags.LAYERS['layer:utils'][0])} THEN 'layer:utils' END",
    "type:config": f"CASE WHEN lower({SUFFIX}) IN ({quoted(tags.CONFIG_SUFFIXES)}) OR contains(lower({NAME}), '.env') THEN 'type:config' END",
    "type:doc": f"CASE WHEN lower({SUFFIX}) IN ({quoted(tags.DOC_SUFFIXES)}) OR {parts_sql(['docs'], 'file_path')} THEN 'type:doc' END",
    "type:test": f"CASE WHEN {parts_sql(['test', 'tests', '__tests__'])} OR {' OR '.join(f'suffix(lower({NAME}), {quoted([e])})' for e in tags.TEST_ENDINGS)} THEN 'type:test' END",
}


@query("tags_by_path", f"{with_sql('files')} SELECT doc_id, concat_ws(',', {', '.join(TAG_SQL.values())}) AS tags FROM files")
def tags_by_path(spark, d):
    p = F.col("file_path")
    return corpus.files(spark, d).select("doc_id", F.array_join(tags.path_tags(p, paths.language_of(p)), ",").alias("tags"))


@query("tags_valid", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'framework:flask,lang:en' ELSE 'lang:' || lang END || ',layer:x,purpose:api' AS tags FROM documents WHERE lang IS NOT NULL")
def tags_valid(spark, d):
    given = F.array(F.lit("purpose:api"), F.lit("purpose:odd"), F.concat(F.lit("lang:"), "lang"), F.lit("nothing"), F.lit("layer:x"), F.lit("layer:x"), F.concat(F.lit("framework:"), F.when(F.col("lang") == "en", "flask").otherwise("other")))
    return corpus.read(spark, d, "documents").filter("lang is not null").select("doc_id", F.array_join(tags.valid_tags(given), ",").alias("tags"))


@query("tags_answer", "SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN '' ELSE 'purpose:api,x' END AS tags FROM events")
def tags_answer(spark, d):
    said = F.when(F.col("event_type") == "click", "no json").when(F.col("event_type") == "view", " {} ").otherwise('{"tags": [" purpose:api", "x "]}')
    return corpus.read(spark, d, "events").select("event_id", F.array_join(tags.answered_tags(said), ",").alias("tags"))


# Index rows


@query(
    "index_upsert",
    """SELECT l_partkey AS file_path, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS last_order, count(*) > 0 AS present FROM lineitem GROUP BY l_partkey""",
)
def index_upsert(spark, d):
    li = corpus.read(spark, d, "lineitem").select(F.col("l_partkey").alias("file_path"), F.col("l_orderkey").alias("last_order"), "l_linenumber")
    return index.last_wins(li, ["file_path"], [F.col("last_order"), F.col("l_linenumber")]).select("file_path", "last_order", F.lit(True).alias("present"))


@query("index_changed", f"{with_sql('files')}, old AS (SELECT workspace_id, file_path, CASE WHEN doc_id % 3 = 0 THEN file_hash ELSE 'old' END AS h FROM files WHERE doc_id % 4 <> 1) SELECT doc_id, file_path FROM files f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.workspace_id = f.workspace_id AND o.file_path = f.file_path AND o.h = f.file_hash)")
def index_changed(spark, d):
    f = corpus.files(spark, d)
    old = f.filter("doc_id % 4 <> 1").select("workspace_id", "file_path", F.when(F.col("doc_id") % 3 == 0, F.col("file_hash")).otherwise("old").alias("file_hash"))
    return index.changed(f, old).select("doc_id", "file_path")


@query("index_orphans", f"{with_sql('files')} SELECT DISTINCT file_path FROM files WHERE workspace_id = substr(sha256('/work/src1'), 1, 12) AND file_path LIKE '/work/src1/%' AND doc_id % 4 = 1")
def index_orphans(spark, d):
    f = corpus.files(spark, d)
    return index.orphans(f, f.filter("doc_id % 4 <> 1"), workspaces.id_of("/work/src1"), "/work/src1").select("file_path").distinct()


@query("index_delete", f"{with_sql('files')}, g AS (SELECT file_path, max(doc_id % 4) AS gone_no FROM files WHERE doc_id % 5 = 2 GROUP BY ALL) SELECT doc_id FROM files f LEFT JOIN g USING (file_path) WHERE g.gone_no IS NULL OR f.doc_id % 3 >= g.gone_no")
def index_delete(spark, d):
    f = corpus.files(spark, d).withColumn("commit_no", F.col("doc_id") % 3)
    return index.without_dropped(f, f.filter("doc_id % 5 = 2").select("workspace_id", "file_path", (F.col("doc_id") % 4).alias("gone_no"))).select("doc_id")


@query("index_dependencies", "SELECT DISTINCT source AS workspace_id, 'f' || doc_id % 100 AS source_symbol, 'mod' || doc_id % 7 AS target_symbol FROM documents UNION SELECT DISTINCT source, 'f' || doc_id % 100, 'base' FROM documents")
def index_dependencies(spark, d):
    f = corpus.read(spark, d, "documents").select(F.col("source").alias("workspace_id"), F.concat(F.lit("f"), (F.col("doc_id") % 100).cast("string")).alias("file_path"), "doc_id")
    return index.edges_of(f, F.array(F.concat(F.lit("mod"), (F.col("doc_id") % 7).cast("string")), F.lit("base"))).select("workspace_id", "source_symbol", "target_symbol")


@query(
    "index_summary",
    f"""{with_sql('files')}, f AS (SELECT doc_id, {LANGUAGE} AS language FROM files), i AS (SELECT * FROM f WHERE language IS NOT NULL)
SELECT (SELECT count(*) FROM f) AS files_scanned, (SELECT count(*) FROM i) AS files_indexed, (SELECT count(*) FROM f) - (SELECT count(*) FROM i) AS files_skipped,
(SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM i GROUP BY 1)) AS languages, (SELECT 2 * count(*) FROM i) AS total_chunks""",
)
def index_summary(spark, d):
    f = corpus.files(spark, d).select("doc_id", paths.language_of(F.col("file_path")).alias("language"))
    i = f.filter("language is not null")
    out = index.summary(f, i, i.union(i))
    return out.withColumn("languages", F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("index_delete_workspace", "SELECT doc_id, source AS workspace_id FROM documents WHERE (source <> 'src1' OR doc_id % 7 >= 4) AND (source <> 'src2' OR doc_id % 7 >= 2)")
def index_delete_workspace(spark, d):
    rows = corpus.read(spark, d, "documents").select("doc_id", F.col("source").alias("workspace_id"), (F.col("doc_id") % 7).alias("commit_no"))
    return index.without_workspaces(rows, {"src1": 4, "src2": 2}).select("doc_id", "workspace_id")


@query("index_workspaces", "SELECT source AS id, max(doc_id) AS created FROM documents GROUP BY source")
def index_workspaces(spark, d):
    rows = corpus.read(spark, d, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("created"))
    return index.last_wins(rows, ["id"], [F.col("created")]).orderBy(F.col("created").desc())


# Symbols

CHUNKS = with_sql("files", "chunks")


@query(
    "symbols_function_details",
    f"""{CHUNKS}, r AS (SELECT workspace_id, name, file_path, start_line, end_line, type, row_number() OVER (PARTITION BY workspace_id, name ORDER BY file_path, start_line, end_line) AS k FROM chunks WHERE type IN ('function', 'method'))
SELECT workspace_id, name, file_path, start_line, end_line FROM r WHERE k = 1""",
)
def symbols_function_details(spark, d):
    c = corpus.chunks(spark, d)
    return symbols.function_details(c, c.select("workspace_id", "name")).select("workspace_id", "name", "file_path", "start_line", "end_line")


ASKED = ("the", "der", "la", "de", "license")


@query(
    "symbols_first_function",
    f"""{CHUNKS}, r AS (SELECT name, file_path, start_line, end_line, type, row_number() OVER (PARTITION BY name ORDER BY file_path, start_line, end_line) AS k FROM chunks
WHERE type IN ('function', 'method') AND workspace_id = substr(sha256('/work/src1'), 1, 12) AND name IN ({quoted(ASKED)}))
SELECT name, file_path, start_line, end_line FROM r WHERE k = 1""",
)
def symbols_first_function(spark, d):
    """The lookup of ``get_function_details``, of a few names."""
    c, ws = corpus.chunks(spark, d), workspaces.id_of("/work/src1")
    out = symbols.first_function(c, ws, ASKED[0])
    for name in ASKED[1:]:
        out = out.unionByName(symbols.first_function(c, ws, name))
    return out.select("name", "file_path", "start_line", "end_line")


@query(
    "symbols_type_methods",
    f"""{CHUNKS} SELECT t.file_path, t.start_line, t.package || '.' || t.name AS full_name, count(m.name) AS methods, coalesce(sum(m.start_line), 0) AS line_sum
FROM chunks t LEFT JOIN chunks m ON m.workspace_id = t.workspace_id AND m.file_path = t.file_path AND m.type = 'method' AND m.start_line >= t.start_line AND m.end_line <= t.end_line
WHERE t.type = 'class' GROUP BY ALL""",
)
def symbols_type_methods(spark, d):
    c = corpus.chunks(spark, d)
    out = symbols.with_methods(c.filter("type = 'class'"), c)
    return out.select("file_path", "start_line", "full_name", F.size("methods").alias("methods"), F.aggregate("methods", F.lit(0).cast("long"), lambda s, m: s + m["start_line"]).alias("line_sum"))


@query(
    "symbols_enclosing",
    f"""{CHUNKS}, p AS (SELECT DISTINCT workspace_id, file_path, (doc_id % 5 + 1) AS line FROM files),
h AS (SELECT p.file_path, p.line, c.type, c.name, c.start_line, c.end_line, row_number() OVER (PARTITION BY p.workspace_id, p.file_path, p.line ORDER BY c.end_line - c.start_line, c.start_line, c.name, c.type) AS depth FROM p JOIN chunks c ON c.workspace_id = p.workspace_id AND c.file_path = p.file_path AND p.line BETWEEN c.start_line AND c.end_line)
SELECT * FROM h""",
)
def symbols_enclosing(spark, d):
    points = corpus.files(spark, d).select("workspace_id", "file_path", (F.col("doc_id") % 5 + 1).alias("line")).distinct()
    return symbols.enclosing(corpus.chunks(spark, d), points).drop("workspace_id")


@query("symbols_exports", f"{CHUNKS} SELECT DISTINCT name FROM chunks WHERE workspace_id = substr(sha256('/work/src2'), 1, 12) AND contains(file_path, '/src2/') AND name NOT LIKE '\\_%' ESCAPE '\\'")
def symbols_exports(spark, d):
    return symbols.package_exports(corpus.chunks(spark, d), workspaces.id_of("/work/src2"), "/src2/")


@query("symbols_dependencies", f"{with_sql('edges')} SELECT source_symbol, target_symbol FROM edges WHERE workspace_id = 'w1' AND (source_symbol = 'n15' OR target_symbol = 'n15')")
def symbols_dependencies(spark, d):
    return symbols.dependencies(corpus.edges(spark, d), "w1", "n15").select("source_symbol", "target_symbol")


NAMED = "named AS (SELECT DISTINCT 'w' || (s_suppkey % 3) AS workspace_id, 'n' || (s_suppkey % 150) AS name, '/f' || s_nationkey AS file_path FROM supplier)"


def named(spark, d):
    s = corpus.read(spark, d, "supplier")
    return s.select(F.concat(F.lit("w"), (F.col("s_suppkey") % 3).cast("string")).alias("workspace_id"), F.concat(F.lit("n"), (F.col("s_suppkey") % 150).cast("string")).alias("name"), F.concat(F.lit("/f"), F.col("s_nationkey").cast("string")).alias("file_path")).distinct()


@query("symbols_callers", f"{with_sql('edges')}, {NAMED} SELECT DISTINCT e.workspace_id, e.target_symbol AS symbol, e.source_symbol, n.file_path FROM edges e LEFT JOIN named n ON n.workspace_id = e.workspace_id AND n.name = e.source_symbol")
def symbols_callers(spark, d):
    e = corpus.edges(spark, d)
    return symbols.callers(e, named(spark, d), e.select("workspace_id", F.col("target_symbol").alias("symbol")))


@query("symbols_targets", f"{with_sql('edges')}, {NAMED} SELECT DISTINCT e.workspace_id, e.source_symbol AS symbol, e.target_symbol, n.file_path FROM edges e LEFT JOIN named n ON n.workspace_id = e.workspace_id AND n.name = e.target_symbol")
def symbols_targets(spark, d):
    e = corpus.edges(spark, d)
    return symbols.targets(e, named(spark, d), e.select("workspace_id", F.col("source_symbol").alias("symbol")))


PAIR = "^([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)"


@query(
    "symbols_links",
    f"""{with_sql('files')}, l AS (SELECT doc_id, workspace_id, file_path, unnest(string_split(source, chr(10))) AS line, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS start_line FROM files),
w AS (SELECT *, lower(regexp_extract(line, '{PAIR}', 1)) AS a, lower(regexp_extract(line, '{PAIR}', 2)) AS b FROM l WHERE regexp_matches(line, '{PAIR}')),
e AS (SELECT DISTINCT workspace_id, 'python:p' || doc_id % 7 || '.' || a || CASE WHEN start_line % 3 = 1 THEN '.' || b ELSE '' END AS key FROM w),
t AS (SELECT w.*, p AS place, less, 'python:p' || (doc_id + p + 1) % 7 || '.' || a || CASE WHEN less = 0 THEN '.' || b ELSE '' END AS key FROM w, (SELECT unnest([0, 1]) AS p), (SELECT unnest([0, 1]) AS less)),
h AS (SELECT t.*, row_number() OVER (PARTITION BY doc_id, start_line ORDER BY less, place) AS k FROM t JOIN e USING (workspace_id, key))
SELECT file_path, start_line, a || '.' || b AS ref, key FROM h WHERE k = 1""",
)
def symbols_links(spark, d):
    """Uses in every line, which may stand for names of two modules, and the full names that win."""
    f = corpus.files(spark, d).select("doc_id", "workspace_id", "file_path", F.posexplode(F.split("source", "\n")).alias("k", "line")).filter(F.col("line").rlike(PAIR))
    w = f.select("*", (F.col("k") + 1).alias("start_line"), *[F.lower(F.regexp_extract("line", PAIR, g)).alias(c) for g, c in ((1, "a"), (2, "b"))])
    module = lambda n: F.concat(F.lit("p"), ((F.col("doc_id") + n) % 7).cast("string"))
    method = F.col("start_line") % 3 == 1
    defined = w.select("workspace_id", "file_path", "start_line", F.lit("python").alias("language"), F.when(method, F.concat_ws(".", module(0), "a")).otherwise(module(0)).alias("package"), F.when(method, F.col("b")).otherwise(F.col("a")).alias("name"), F.lit(None).cast("variant").alias("metadata"))
    ref = F.concat_ws(".", "a", "b")
    used = w.select("workspace_id", "file_path", F.col("a").alias("symbol"), "start_line", F.lit("").alias("own"), ref.alias("ref"), F.array(*[F.concat(F.lit("python:"), module(n), F.lit("."), ref) for n in (1, 2)]).alias("targets"))
    return links.linked(used, links.exported(defined)).select("file_path", "start_line", "ref", "key")


@query("embed_zero", "SELECT vec_id, len(list_filter(embedding, lambda x: x <> 0)) = 0 AS zero FROM embeddings")
def embed_zero(spark, d):
    from ..operators import embed

    return corpus.read(spark, d, "embeddings").select("vec_id", embed.is_zero(F.col("embedding")).alias("zero"))


@query("graph_nodes", f"{with_sql('edges')} SELECT workspace_id, source_symbol AS symbol FROM edges UNION SELECT workspace_id, target_symbol FROM edges")
def graph_nodes(spark, d):
    return graph.nodes(corpus.edges(spark, d))


# Search

PHRASES = {"license": "license", "phrase": "of the", "path": "auth middleware", "rare": "Apache License", "none": "no such words here", "folder": "api"}
FOLD = f"translate(lower(%s), '{text.FOLD_FROM}', '{text.FOLD_TO}')"
TOKENS = f"regexp_extract_all({FOLD}, '[\\p{{L}}\\p{{N}}]+')"
FIELDS_SQL = ["workspace_id", "file_path", "'sym_' || (doc_id % 50)", "source", "string_split(source, chr(10))[1]"]
PLACES = "len(list_filter(range(1, len({w}) - len(p) + 2), lambda k: {w}[k:k + len(p) - 1] = p))"
BM25_SQL = f"""{with_sql('files')},
d AS (SELECT doc_id AS id, workspace_id, file_path, 'sym_' || (doc_id % 50) AS symbol_name, {', '.join(f'{TOKENS % c} AS w{i}' for i, c in enumerate(FIELDS_SQL))} FROM files),
q AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {TOKENS % quoted([v])})" for k, v in PHRASES.items())}) AS t(query_id, p)),
t AS (SELECT count(*) AS n_docs, avg({' + '.join(f'len(w{i})' for i in range(5))}) AS mean_length FROM d),
h AS (SELECT query_id, id, workspace_id, file_path, symbol_name, {' + '.join(f'len(w{i})' for i in range(5))} AS length, {' + '.join(PLACES.format(w=f'w{i}') for i in range(5))} AS tf FROM d, q),
i AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_hits FROM h WHERE tf > 0),
r AS (SELECT *, -(CASE WHEN ln((n_docs - n_hits + 0.5) / (n_hits + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n_hits + 0.5) / (n_hits + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) AS rank FROM i, t)"""


def searched(spark, d):
    return search.tokenized(corpus.docs(spark, d))


@query("search_tokens", f"SELECT doc_id, len({TOKENS % "coalesce(text, '')"}) AS n_tokens, sha256(array_to_string({TOKENS % "coalesce(text, '')"}, ' ')) AS digest FROM documents")
def search_tokens(spark, d):
    w = text.tokens(F.col("text"))
    return corpus.read(spark, d, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.sha2(F.array_join(w, " "), 256).alias("digest"))


@query("search_bm25_rank", f"{BM25_SQL} SELECT query_id, id, round(rank, 9) AS rank FROM r")
def search_bm25_rank(spark, d):
    return search.bm25(searched(spark, d), PHRASES).select("query_id", "id", F.round("rank", 9).alias("rank"))


@query("search_postings", f"{BM25_SQL} SELECT query_id, id, tf, length::INT AS length, round(rank, 9) AS rank FROM r")
def search_postings(spark, d):
    """The same ranks from postings, which are built from the documents."""
    docs = searched(spark, d)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    found = postings.hits(postings.build(docs, keys=["language"]), PHRASES, ["language"])
    return postings.bm25(found, total.select("n").scalar(), total.select("mean").scalar()).select("query_id", F.col("number").alias("id"), "tf", "length", F.round("rank", 9).alias("rank"))


@query(
    "search_bm25_top",
    f"""{BM25_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), file_path, symbol_name, id) AS place FROM r),
k AS (SELECT *, round(rank, 9) AS rr FROM s WHERE place <= 10)
SELECT query_id, id, place, round(1 - (rr - min(rr) OVER w) / CASE WHEN max(rr) OVER w = min(rr) OVER w THEN 1.0 ELSE max(rr) OVER w - min(rr) OVER w END, 6) AS bm25_score FROM k WINDOW w AS (PARTITION BY query_id)""",
)
def search_bm25_top(spark, d):
    hits = search.bm25(searched(spark, d), PHRASES).withColumn("rank", F.round("rank", 9))
    top = search.best(hits, 10, [F.col("rank"), F.col("file_path"), F.col("symbol_name"), F.col("id")])
    return search.normalized(top).select("query_id", "id", "place", F.round("bm25_score", 6).alias("bm25_score"))


@query("search_language_filter", f"{with_sql('files')} SELECT doc_id FROM files WHERE file_path ILIKE '%.java' OR file_path ILIKE '%.py'")
def search_language_filter(spark, d):
    p = F.col("file_path")
    return corpus.files(spark, d).filter(search.language_filter(p, "java") | search.language_filter(p, "python")).select("doc_id")


NEAREST_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT query_id, vec_id AS id, list_sum(list_transform(range(1, len(e) + 1), lambda i: (embedding[i]::DOUBLE - e[i]::DOUBLE) * (embedding[i]::DOUBLE - e[i]::DOUBLE))) AS dist FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS place FROM x) SELECT query_id, id, place, round(1 - dist, 5) AS vector_score FROM r WHERE place <= 10"""


@query("search_nearest", NEAREST_SQL)
def search_nearest(spark, d):
    """Every vector whose id is divisible by 20 as a query against all vectors."""
    v = corpus.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = search.nearest_many(v, v.filter("id % 20 = 0"), 10)
    return near.select("query_id", "id", "place", F.round(1 - F.col("distance"), 5).alias("vector_score"))


@query("search_nearest_lists", NEAREST_SQL)
def search_nearest_lists(spark, d):
    """The same through an inverted file: all lists, so exactly."""
    v = corpus.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    centroids = vectors.fit(v)
    near = vectors.nearest_many(vectors.assigned(v, centroids), centroids, v.filter("id % 20 = 0"), 10)
    return near.select("query_id", "id", "place", F.round(1 - F.col("distance"), 5).alias("vector_score"))


@query("search_hybrid")
def search_hybrid(spark, d):
    """Phrase hits and nearest vectors fused, with a file filter and tags. The hashed embedding of the texts has no SQL form; fusion alone is held
    against SQL by ``search_fusion``."""
    from ..operators import embed

    docs = corpus.docs(spark, d)
    embedder = embed.HashEmbedder(32)
    vectors = docs.withColumn("embedding", embed.embedding_of(embedder)(F.col("code")))
    phrases = {"a": "of the", "b": "license"}
    queries = {k: v for k, v in zip(phrases, embedder(list(phrases.values())), strict=True)}
    out = search.hybrid_search(search.tokenized(docs), vectors, phrases, queries, 10, exclude_tests=True)
    return out.select("query_id", "file_path", "symbol_name", "place", F.round("hybrid_score", 4).alias("hybrid_score"))


WORDS_SQL = "w AS (SELECT 'q' || (o_custkey % 20) AS query_id, '/f' || (o_orderkey % 37) || CASE WHEN o_orderkey % 5 = 0 THEN '/test' ELSE '' END AS file_path, 's' || (o_orderkey % 3) AS symbol_name, (o_orderkey % 101) / 100.0::DOUBLE AS bm25_score, o_orderkey AS place FROM orders WHERE o_orderkey % 3 = 0)"
NEAR_SQL = "v AS (SELECT 'q' || (o_custkey % 20) AS query_id, '/f' || (o_orderkey % 37) || CASE WHEN o_orderkey % 5 = 0 THEN '/test' ELSE '' END AS file_path, 's' || (o_orderkey % 3) AS symbol_name, (o_orderkey % 89) / 100.0::DOUBLE AS vector_score FROM orders WHERE o_orderkey % 3 <> 1)"


@query(
    "search_fusion",
    f"""WITH {WORDS_SQL}, {NEAR_SQL}, a AS (SELECT query_id, file_path, symbol_name, min(bm25_score) AS bm25_score FROM w GROUP BY ALL), b AS (SELECT query_id, file_path, symbol_name, min(vector_score) AS vector_score FROM v GROUP BY ALL),
m AS (SELECT query_id, file_path, symbol_name, coalesce(bm25_score, 0) AS bm25_score, coalesce(vector_score, 0) AS vector_score FROM a FULL JOIN b USING (query_id, file_path, symbol_name))
SELECT query_id, file_path, symbol_name, round(0.6 * vector_score + 0.4 * bm25_score, 6) AS hybrid_score FROM m WHERE NOT contains(lower(file_path), 'test')""",
)
def search_fusion(spark, d):
    o = corpus.read(spark, d, "orders")
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    base = o.select(F.concat(F.lit("q"), s(F.col("o_custkey") % 20)).alias("query_id"), F.concat(F.lit("/f"), s(k % 37), F.when(k % 5 == 0, "/test").otherwise("")).alias("file_path"), F.concat(F.lit("s"), s(k % 3)).alias("symbol_name"), k.alias("place"), F.lit("c").alias("code"), F.lit("d").alias("docstring"), F.array().cast("array<string>").alias("tags"))
    words = base.filter("place % 3 = 0").withColumn("bm25_score", F.col("place") % 101 / 100)
    near = base.filter("place % 3 <> 1").withColumn("vector_score", F.col("place") % 89 / 100)
    return search.fused(words, near, 1 << 30, exclude_tests=True).select("query_id", "file_path", "symbol_name", F.round("hybrid_score", 6).alias("hybrid_score"))


@query(
    "search_filters",
    f"""{with_sql('files')}, t AS (SELECT doc_id, file_path, 'sym_' || (doc_id % 50) AS symbol_name, {TAG_SQL['type:doc']} AS a, {TAG_SQL['layer:api']} AS b FROM files)
SELECT 'any' AS kind, file_path, symbol_name FROM t WHERE a IS NOT NULL OR b IS NOT NULL UNION SELECT 'all', file_path, symbol_name FROM t WHERE a IS NOT NULL AND b IS NOT NULL
UNION SELECT 'path', file_path, symbol_name FROM t WHERE contains(file_path, '/models/') UNION SELECT 'tests', file_path, symbol_name FROM t WHERE NOT contains(lower(file_path), 'test') AND b IS NOT NULL""",
)
def search_filters(spark, d):
    """The filters of fused results: tags, any and all of them, a part of the path, and no tests."""
    near = corpus.docs(spark, d).select(F.lit("q").alias("query_id"), "file_path", "symbol_name", F.lit(0.5).alias("vector_score"), F.col("id").alias("place"), "code", "tags")
    words = near.limit(0).select("query_id", "file_path", "symbol_name", F.lit(0.5).alias("bm25_score"), "place", "code", F.col("code").alias("docstring"))
    want = ["type:doc", "layer:api"]
    asked = {"any": {"tags": want}, "all": {"tags": want, "tags_mode": "all"}, "path": {"file_filter": "/models/"}, "tests": {"exclude_tests": True, "tags": want[1:]}}
    parts = [search.fused(words, near, 1 << 30, **how).select(F.lit(kind).alias("kind"), "file_path", "symbol_name") for kind, how in asked.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


ONE_BY_ONE = {"low": [0.05] * 64, "alternate": [0.1, -0.1] * 32, "one": [1.0] + [0.0] * 63}


@query(
    "search_nearest_few",
    f"""WITH q AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE[])" for k, v in ONE_BY_ONE.items())}) AS t(query_id, e)),
x AS (SELECT query_id, vec_id AS id, label, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - e[i]) * (embedding[i]::DOUBLE - e[i]))), 6) AS dist FROM embeddings, q WHERE len(embedding) = 64),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS place FROM x) SELECT query_id, id, label, dist FROM r WHERE place <= 25""",
)
def search_nearest_few(spark, d):
    """The vector search of ``search_code``: a few queries against all vectors."""
    v = corpus.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return search.nearest(v, ONE_BY_ONE, 25).select("query_id", "id", "label", F.round("distance", 6).alias("dist"))


@query(
    "search_bm25_filtered",
    f"""{BM25_SQL}, l AS (SELECT *, CASE WHEN file_path ILIKE '%.py' THEN 'python' WHEN file_path ILIKE '%.go' THEN 'go' ELSE 'javascript' END AS language FROM r WHERE query_id = 'folder' AND (file_path ILIKE '%.py' OR file_path ILIKE '%.go' OR (file_path ILIKE '%.js' AND workspace_id = substr(sha256('/work/src1'), 1, 12)))),
s AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY round(rank, 9), file_path, symbol_name, id) AS place FROM l), k AS (SELECT * FROM s WHERE place <= 5)
SELECT language, id, place, round(1 - (rank - min(rank) OVER v) / CASE WHEN max(rank) OVER v = min(rank) OVER v THEN 1.0 ELSE max(rank) OVER v - min(rank) OVER v END, 5) AS bm25_score FROM k WINDOW v AS (PARTITION BY language)""",
)
def search_bm25_filtered(spark, d):
    """The phrase search of ``search_code``: one phrase, languages and a workspace; counts are over all documents."""
    docs = searched(spark, d)
    one = lambda language, ws=None: search.bm25_search(docs, {"folder": PHRASES["folder"]}, ws, language, 5).select(F.lit(language).alias("language"), "id", "place", F.round("bm25_score", 5).alias("bm25_score"))
    return one("python").unionByName(one("go")).unionByName(one("javascript", workspaces.id_of("/work/src1")))


@query("search_path_glob", f"{with_sql('files')} SELECT doc_id FROM files WHERE regexp_matches(file_path, '^/work/.*/user_.*[0-4]\\.[!a-z]?.*$') AND regexp_matches(file_path, '^/work/.*/user_.*[0-4]\\..*$')")
def search_path_glob(spark, d):
    return corpus.files(spark, d).filter(paths.matches_glob(F.col("file_path"), "/work/*/user_*[0-4].*")).select("doc_id")


# Statistics

KINDS_SQL = ", ".join(f"count(*) FILTER (type = '{v}') AS {k}" for k, v in stats.KINDS.items())


@query("stats_per_file", f"{CHUNKS} SELECT workspace_id, file_path, {KINDS_SQL}, count(*) AS symbol_count FROM chunks GROUP BY ALL")
def stats_per_file(spark, d):
    return stats.per_file(corpus.chunks(spark, d))


@query(
    "stats_per_language",
    f"""{CHUNKS}, a AS (SELECT workspace_id, coalesce({LANGUAGE}, 'unknown') AS language, count(*) AS files FROM files GROUP BY ALL), b AS (SELECT workspace_id, coalesce({LANGUAGE}, 'unknown') AS language, {KINDS_SQL} FROM chunks GROUP BY ALL)
SELECT workspace_id, language, coalesce(files, 0) AS files, coalesce(functions, 0) AS functions, coalesce(classes, 0) AS classes, coalesce(methods, 0) AS methods FROM a FULL JOIN b USING (workspace_id, language)""",
)
def stats_per_language(spark, d):
    return stats.per_language(corpus.files(spark, d), corpus.chunks(spark, d))


@query("stats_most_active", f"{CHUNKS}, c AS (SELECT workspace_id, file_path, count(*) AS symbol_count FROM chunks GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY symbol_count DESC, file_path) AS place FROM c) SELECT * FROM r WHERE place <= 10")
def stats_most_active(spark, d):
    return stats.most_active(corpus.chunks(spark, d))


@query("stats_current", f"{CHUNKS} SELECT workspace_id, count(DISTINCT file_path) AS files, sum(end_line - start_line + 1)::BIGINT AS total_lines, count(*) AS total_symbols FROM chunks GROUP BY ALL")
def stats_current(spark, d):
    return stats.current(corpus.chunks(spark, d))


@query("stats_scan_delta", f"{with_sql('scans')}, o AS (SELECT workspace_id, first(files_scanned ORDER BY ts, seq) AS fa, last(files_scanned ORDER BY ts, seq) AS fz, first(chunks_created ORDER BY ts, seq) AS ca, last(chunks_created ORDER BY ts, seq) AS cz, min(ts) AS ta, max(ts) AS tz, count(*) AS n FROM scans GROUP BY 1) SELECT workspace_id, fz - fa AS files_delta, cz - ca AS chunks_delta, epoch_ms(tz) - epoch_ms(ta) AS time_span_ms FROM o WHERE n > 1")
def stats_scan_delta(spark, d):
    return stats.scan_delta(corpus.scans(spark, d))


@query("stats_last_scan", f"{with_sql('scans')} SELECT workspace_id, max(ts) AS last_indexed FROM scans GROUP BY 1")
def stats_last_scan(spark, d):
    return stats.last_scan(corpus.scans(spark, d))


@query("stats_top_folders", f"{with_sql('files')} SELECT DISTINCT workspace_id, string_split(file_path, '/')[2] AS folder FROM files")
def stats_top_folders(spark, d):
    return stats.top_folders(corpus.files(spark, d))


@query("stats_most_imported", f"{with_sql('edges')}, c AS (SELECT workspace_id, target_symbol AS symbol, count(*) AS import_count FROM edges GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY import_count DESC, symbol) AS place FROM c) SELECT * FROM r WHERE place <= 10")
def stats_most_imported(spark, d):
    return stats.most_imported(corpus.edges(spark, d))


@query("stats_most_dependent", f"{with_sql('edges')}, c AS (SELECT workspace_id, source_symbol AS symbol, count(*) AS dependency_count FROM edges GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY dependency_count DESC, symbol) AS place FROM c) SELECT * FROM r WHERE place <= 10")
def stats_most_dependent(spark, d):
    return stats.most_dependent(corpus.edges(spark, d))


@query(
    "stats_graph_summary",
    f"""{with_sql('edges')}, e AS (SELECT workspace_id, source_symbol AS symbol, 1 AS o FROM edges UNION ALL SELECT workspace_id, target_symbol, 0 FROM edges), g AS (SELECT workspace_id, symbol, count(*) FILTER (o = 0) AS ins, count(*) FILTER (o = 1) AS outs FROM e GROUP BY ALL)
SELECT workspace_id, count(*) AS total_symbols, sum(outs)::BIGINT AS total_dependencies, sum(outs) / count(*) AS avg_dependencies, first(symbol ORDER BY ins DESC, symbol) AS most_imported, max(ins) AS most_imported_count, first(symbol ORDER BY outs DESC, symbol) AS most_dependent, max(outs) AS most_dependent_count FROM g GROUP BY 1""",
)
def stats_graph_summary(spark, d):
    return stats.graph_summary(corpus.edges(spark, d))


@query(
    "stats_tree",
    f"""{CHUNKS}, c AS (SELECT workspace_id, file_path, count(*) AS symbols FROM chunks GROUP BY ALL), s AS (SELECT f.workspace_id, list_filter(string_split(f.file_path, '/'), lambda x: x <> '') AS p, coalesce(symbols, 0) AS symbols FROM files f LEFT JOIN c ON c.workspace_id = f.workspace_id AND c.file_path = f.file_path),
u AS (SELECT workspace_id, p, symbols, unnest(range(1, len(p) + 1)) AS n FROM s)
SELECT workspace_id, array_to_string(p[1:n - 1], '/') AS parent, p[n] AS name, n - 1 AS depth, n = len(p) AS is_file, max(CASE WHEN n = len(p) THEN symbols ELSE 0 END) AS symbols FROM u WHERE n <= 11 GROUP BY ALL""",
)
def stats_tree(spark, d):
    return stats.tree_nodes(corpus.files(spark, d), corpus.chunks(spark, d))


# Graphs


@query("graph_adjacency", f"{with_sql('edges')} SELECT workspace_id, source_symbol AS symbol, string_agg(DISTINCT target_symbol, ',' ORDER BY target_symbol) AS linked FROM edges GROUP BY ALL")
def graph_adjacency(spark, d):
    return graph.adjacency(corpus.edges(spark, d)).withColumn("linked", F.array_join("linked", ","))


@query("graph_reverse", f"{with_sql('edges')} SELECT workspace_id, target_symbol AS symbol, string_agg(DISTINCT source_symbol, ',' ORDER BY source_symbol) AS linked FROM edges GROUP BY ALL")
def graph_reverse(spark, d):
    return graph.adjacency(corpus.edges(spark, d), reverse=True).withColumn("linked", F.array_join("linked", ","))


@query(
    "graph_breadth_first",
    """WITH RECURSIVE """ + with_sql("sparse")[5:] + """, b AS (SELECT 'n1' AS symbol, 0 AS depth UNION SELECT s.target_symbol, b.depth + 1 FROM b JOIN sparse s ON s.source_symbol = b.symbol WHERE b.depth < 12),
m AS (SELECT symbol, min(depth) AS depth FROM b GROUP BY 1)
SELECT 'w' AS workspace_id, 'n1' AS entry, m.symbol, m.depth, (SELECT min(p.symbol) FROM m p JOIN sparse s ON s.source_symbol = p.symbol AND s.target_symbol = m.symbol WHERE p.depth = m.depth - 1) AS parent FROM m""",
)
def graph_breadth_first(spark, d):
    entries = spark.range(1).select(F.lit("w").alias("workspace_id"), F.lit("n1").alias("entry"))
    return graph.breadth_first(corpus.sparse(spark, d), entries, 12)


@query(
    "graph_components",
    """WITH RECURSIVE """ + with_sql("sparse")[5:] + """, r AS (SELECT source_symbol AS a, target_symbol AS b FROM sparse UNION SELECT r.a, s.target_symbol FROM r JOIN sparse s ON s.source_symbol = r.b),
n AS (SELECT source_symbol AS symbol FROM sparse UNION SELECT target_symbol FROM sparse),
c AS (SELECT n.symbol, least(n.symbol, coalesce(min(x.b), n.symbol)) AS component FROM n LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON q.a = r.b AND q.b = r.a) x ON x.a = n.symbol GROUP BY n.symbol)
SELECT 'w' AS workspace_id, symbol, component, count(*) OVER (PARTITION BY component) AS size FROM c""",
)
def graph_components(spark, d):
    """By tables of edges, as for a workspace that no task holds."""
    return components.components(corpus.sparse(spark, d), small=0)


@query(
    "graph_cycles",
    """WITH RECURSIVE """ + with_sql("sparse")[5:] + """, p AS (SELECT [source_symbol] AS path, target_symbol AS tip FROM sparse WHERE target_symbol >= source_symbol
UNION ALL SELECT list_append(p.path, p.tip), s.target_symbol FROM p JOIN sparse s ON s.source_symbol = p.tip WHERE p.tip <> p.path[1] AND s.target_symbol >= p.path[1] AND (s.target_symbol = p.path[1] OR NOT list_contains(list_append(p.path, p.tip), s.target_symbol)))
SELECT 'w' AS workspace_id, array_to_string(list_append(path, tip), '>') AS cycle FROM p WHERE tip = path[1]""",
)
def graph_cycles(spark, d):
    return graph.cycles(corpus.sparse(spark, d)).select("workspace_id", F.array_join("path", ">").alias("cycle"))


# Change events


PASSED_SQL = f"""{with_sql('changes')}, x AS (SELECT CASE WHEN event_type = 'moved' THEN 'deleted' ELSE event_type END AS event_type, file_path, ts, event_type = 'moved' AS moved, dest_path FROM changes WHERE NOT is_directory
UNION ALL SELECT 'created', dest_path, ts, true, dest_path FROM changes WHERE NOT is_directory AND event_type = 'moved'),
passed AS (SELECT event_type, file_path, ts FROM x WHERE file_path LIKE '%.py' AND (event_type = 'deleted' OR NOT contains(file_path, '/node_modules/')) AND (NOT moved OR dest_path LIKE '%.py'))"""


@query("events_passing", f"{PASSED_SQL} SELECT event_type, file_path, ts FROM passed")
def events_passing(spark, d):
    return bounce.passing(corpus.changes(spark, d))


@query(
    "events_debounce",
    f"""WITH RECURSIVE {PASSED_SQL[5:]}, c AS (SELECT file_path, ts, row_number() OVER (PARTITION BY file_path ORDER BY ts) AS k FROM passed WHERE event_type <> 'deleted'),
a AS (SELECT file_path, ts, ts AS last, true AS ok, k FROM c WHERE k = 1 UNION ALL SELECT c.file_path, c.ts, CASE WHEN c.ts - a.last >= INTERVAL 4 HOUR THEN c.ts ELSE a.last END, c.ts - a.last >= INTERVAL 4 HOUR, c.k FROM a JOIN c ON c.file_path = a.file_path AND c.k = a.k + 1)
SELECT file_path, ts, 'change' AS kind FROM a WHERE ok UNION ALL SELECT file_path, ts, 'deleted' FROM passed WHERE event_type = 'deleted'""",
)
def events_debounce(spark, d):
    kept = bounce.debounce(bounce.passing(corpus.changes(spark, d)), 4 * 3600 * 1000)
    return kept.select("file_path", "ts", F.when(F.col("event_type") == "deleted", "deleted").otherwise("change").alias("kind"))
