"""Links between symbols across files: names used in a symbol's code, as its file's imports bind them, meet the names that files define.

A *use* is kept with the symbol it stands in, as the full names it may stand for; what defines them is looked up when links are read, so a file that comes, goes or changes later needs no other
file to be read again. A full name is tried with its last parts dropped as well, as many as the use has: ``m.C.make`` with ``m`` bound to ``pkg.m`` meets ``pkg.m.C.make``, or else
``pkg.m.C``. The longest name that is defined wins, and of equals the likelier binding. All is one equi-join on names, and one grouping by use without a window.

A link leads to a full name. What defines a name (several overloads do, say) is ``exported``: use and definitions are not multiplied out.

Defined cases: words in strings and comments are no uses; a symbol that uses its own name doesn't link to itself; a use of a variable's attributes has no link, as types are unknown; null code has
no uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bindings import FAMILIES

USE = ["workspace_id", "file_path", "symbol", "start_line", "ref"]
#: Possessive, so that long texts are matched in a loop.
QUOTED = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + r'"(?:[^"\\\n]++|\\.)*+"|' + r"'(?:[^'\\\n]++|\\.)*+'"
NOISE = {"python": QUOTED + r"|#[^\n]*+", "other": QUOTED + r"|`[^`]*+`|//[^\n]*+|/\*[\s\S]*?\*/"}
WORD = r"(?<![\w$.])[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+(?:\s*+\()?"


def family(language: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])[language]


def references(code: Column, language: Column) -> Column:
    """Distinct dotted words of the code, with ``(`` behind those that are called."""
    bare = F.when(language == "python", F.regexp_replace(code, NOISE["python"], " ")).otherwise(F.regexp_replace(code, NOISE["other"], " "))
    words = F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, r"\s+", "")))
    # One that is also called stands as called.
    return F.array_except(words, F.transform(F.filter(words, lambda w: w.endswith("(")), lambda w: F.regexp_replace(w, r"\($", "")))


def full_name(chunks: DataFrame) -> Column:
    """The full name of a symbol (language, file_path, package, name, metadata); null in other languages."""
    path, name, owner = F.col("file_path"), F.col("name"), F.coalesce(F.try_variant_get("metadata", "$.class_name", "string"), F.lit(""))
    module = F.regexp_replace("package", r"(^|\.)__init__(?=\.|$)", "")
    receiver = F.regexp_replace(F.coalesce(F.try_variant_get("metadata", "$.receiver_type", "string"), F.lit("")), r"^\*", "")
    dotted = lambda *parts: F.concat_ws(".", *[F.nullif(p, F.lit("")) for p in parts])
    own = (
        F.when(F.col("language") == "python", dotted(module, name)).when(F.col("language") == "csharp", dotted(F.col("package"), owner, name))
        .when(F.col("language") == "go", dotted(F.regexp_replace(path, r"/[^/]*$", ""), receiver, name)).when(family(F.col("language")) == "script", dotted(F.regexp_replace(path, r"\.(?:jsx?|tsx?|mjs|cjs)$", ""), name))
    )
    return F.concat(family(F.col("language")), F.lit(":"), own)


def exported(chunks: DataFrame) -> DataFrame:
    """workspace_id, key (full name), name, file_path, start_line of every symbol of the families."""
    return chunks.select("workspace_id", full_name(chunks).alias("key"), "name", "file_path", "start_line").filter("key is not null")


def uses(chunks: DataFrame) -> DataFrame:
    """Uses in symbols (chunk columns and the file's ``bindings``): workspace_id, file_path, symbol, start_line, own (the symbol's full name), ref, targets."""
    rows = chunks.filter(F.col("language").isin(*FAMILIES)).withColumn("own", full_name(chunks))
    owner = F.try_variant_get("metadata", "$.class_name", "string")
    # A method of C# also sees the names of its class.
    inside = F.when((F.col("language") == "csharp") & owner.isNotNull(), F.array(F.struct(F.lit("").alias("alias"), F.regexp_replace("own", r"\.[^.]*$", "").alias("full"))))
    rows = rows.withColumn("bindings", F.concat(F.coalesce(inside, F.array().cast("array<struct<alias:string,full:string>>")), "bindings"))
    rows = rows.select("workspace_id", "language", "file_path", F.col("name").alias("symbol"), "start_line", "own", "bindings", F.explode(references(F.col("code"), F.col("language"))).alias("word"))
    rows = rows.withColumn("ref", F.regexp_replace("word", r"\($", ""))
    first = F.substring_index("ref", ".", 1)
    bound = F.transform(F.filter("bindings", lambda b: b["alias"] == first), lambda b: F.concat(b["full"], F.expr("substring(ref, length(substring_index(ref, '.', 1)) + 1)")))
    # Of names that nothing binds, those that are called or begin with a capital letter may be of an open scope.
    scopes = F.transform(F.filter("bindings", lambda b: b["alias"] == ""), lambda b: F.concat(b["full"], F.when(b["full"].endswith(":"), "").otherwise("."), F.col("ref")))
    bare = F.col("word").endswith("(") | F.col("ref").rlike("^[A-Z]")
    rows = rows.withColumn("targets", F.when(F.size(bound) > 0, bound).when(bare, scopes))
    return rows.filter(F.size("targets") > 0).select(*USE[:4], "own", "ref", "targets")


def linked(used: DataFrame, exports: DataFrame) -> DataFrame:
    """Each use that meets a definition, with ``key``, the full name that wins. ``used`` as of ``uses``; ``exports`` has workspace_id and key."""
    parts = F.split("full", r"\.")
    most = F.size(F.split("ref", r"\.")) - 1
    tried = used.select(*USE, "own", F.posexplode("targets").alias("place", "full"))
    tried = tried.select(*USE, "own", "place", "full", F.explode(F.sequence(F.lit(0), F.least(most, F.size(parts) - 1))).alias("less"))
    tried = tried.select(*USE, "own", "place", "less", F.array_join(F.slice(parts, 1, F.size(parts) - F.col("less")), ".").alias("key"))
    hit = tried.join(exports.select("workspace_id", "key").distinct(), ["workspace_id", "key"])
    best = hit.groupBy(*USE, "own").agg(F.min_by("key", F.struct("less", "place", "key")).alias("key"))
    return best.filter(~F.col("own").eqNullSafe(F.col("key"))).select(*USE, "own", "key")


def callers(used: DataFrame, chunks: DataFrame, workspace: str, symbol: str) -> DataFrame:
    """source_symbol, file_path and start_line of the symbols that use a symbol of this name, in whatever file it is defined."""
    some = used.filter((F.col("workspace_id") == workspace) & F.exists("targets", lambda t: t.contains(symbol)))
    hits = linked(some, exported(chunks.filter(F.col("workspace_id") == workspace)))
    return hits.filter(F.regexp_extract("key", r"[^.:]*$", 0) == symbol).select(F.col("symbol").alias("source_symbol"), "file_path", "start_line").distinct()


def targets(used: DataFrame, chunks: DataFrame, workspace: str, symbol: str) -> DataFrame:
    """target_symbol, file_path and start_line of the symbols that a symbol of this name uses."""
    exports = exported(chunks.filter(F.col("workspace_id") == workspace))
    hits = linked(used.filter((F.col("workspace_id") == workspace) & (F.col("symbol") == symbol)), exports).select("workspace_id", "key").distinct()
    return hits.join(exports, ["workspace_id", "key"]).select(F.col("name").alias("target_symbol"), "file_path", "start_line").distinct()
