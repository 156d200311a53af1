"""Imports to files: candidate paths of each import join the listing; the first that exists is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

#: Endings in the order they are tried.
SCRIPT_ENDINGS, PACKAGE_ENDINGS = (".js", ".ts", ".tsx", ".jsx", ""), (".js", ".ts", ".tsx", "", "/index.js", "/index.ts")


def normal(path: Column) -> Column:
    """Path without ``.`` and with ``..`` taken back."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def candidates(root: str) -> Column:
    """Candidate paths, in order, of columns import, source_file and language. C# and Go folders are joined otherwise."""
    imp, folder = F.col("import"), paths.folder_of(F.col("source_file"))
    dots = F.length(F.regexp_extract(imp, r"^\.*", 0))
    rest = F.regexp_replace(F.regexp_replace(imp, r"^\.+", ""), r"\.", "/")
    base = F.array_join(F.slice(F.split(folder, "/"), 1, F.greatest(F.size(F.split(folder, "/")) - dots + 1, F.lit(1))), "/")
    relative = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(base, F.lit("/"), rest, F.lit(".py")), F.concat(base, F.lit("/"), rest, F.lit("/__init__.py"))))
    dotted = F.concat(F.lit(f"{root}/"), F.regexp_replace(imp, r"\.", "/"))
    absolute = F.array(F.concat(dotted, F.lit("/__init__.py")), F.concat(dotted, F.lit("/"), F.substring_index(imp, ".", -1), F.lit(".py")), F.concat(dotted, F.lit(".py")))
    python = F.when(imp.startswith("."), relative).otherwise(absolute)
    near = normal(F.concat(folder, F.lit("/"), imp))
    script = F.when(imp.startswith("."), F.array(*[x for e in SCRIPT_ENDINGS for x in (F.concat(near, F.lit(e)), F.concat(near, F.lit(f"/index{e}")))])).otherwise(F.array(*[F.concat(F.lit(f"{root}/node_modules/"), imp, F.lit(e)) for e in PACKAGE_ENDINGS]))
    go = F.array(F.concat(F.lit(f"{root}/"), imp, F.lit("/main.go")))
    return F.when(F.col("language") == "python", python).when(F.col("language").isin("javascript", "typescript"), script).when(F.col("language") == "go", go).otherwise(F.array().cast("array<string>"))


def resolved(imports: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """imports: source_file, language, import; listing: file_path, and source for C#. Each import with resolved_path, null where nothing fits."""
    root = root.rstrip("/")
    asked = imports.select("source_file", "language", "import").distinct()
    files = listing.select("file_path").distinct()
    tried = asked.select("*", F.posexplode(candidates(root)).alias("place", "file_path")).join(files, "file_path")
    # Any Go file of the folder, after main.go; the first by name.
    inside = asked.filter("language = 'go'").withColumn("folder", F.concat(F.lit(f"{root}/"), F.col("import")))
    go = inside.join(files.filter(F.col("file_path").endswith(".go")).withColumn("folder", paths.folder_of(F.col("file_path"))), "folder").withColumn("place", F.lit(1)).drop("folder")
    found = tried.unionByName(go.select(*tried.columns))
    if "source" in listing.columns:
        spaces = listing.filter(F.col("file_path").endswith(".cs") & F.col("file_path").startswith(root + "/")).select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"namespace ([\w.]+)"), F.lit(1)))).alias("space"))
        # ``namespace a.b`` also holds the texts ``namespace a`` and ``namespace a.``: every prefix is a name that would be found.
        spaces = spaces.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.length("space")), lambda n: F.substring("space", F.lit(1), n))).alias("import"))
        found = found.unionByName(asked.filter("language = 'csharp'").join(spaces, "import").withColumn("place", F.lit(0)).select(*tried.columns))
    first = Window.partitionBy("source_file", "language", "import").orderBy("place", "file_path")
    found = found.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("source_file", "language", "import", F.col("file_path").alias("resolved_path"))
    return asked.join(found, ["source_file", "language", "import"], "left")
