"""Imports of a source text. Python ones by its parser in an Arrow batch; the others by patterns in the JVM."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def python_modules(source: str | None) -> list[str]:
    """Modules of all import statements, in the order of the walk, repeats included; none of a text that doesn't parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            found.append(node.module)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def python_imports(source: pd.Series) -> pd.Series:
    return source.map(python_modules)


def every(source: Column, pattern: str, group: int = 1) -> Column:
    return F.filter(F.regexp_extract_all(source, F.lit(pattern), F.lit(group)), lambda x: x != "")


def script_imports(source: Column) -> Column:
    """JavaScript and TypeScript: ``import … from "m"`` and ``import "m"`` on one line."""
    pattern = r"""import\s+.*?\s+from\s+["']([^"']+)["']|import\s+["']([^"']+)["']"""
    return F.array_distinct(F.concat(every(source, pattern, 1), every(source, pattern, 2)))


def go_imports(source: Column) -> Column:
    """Single imports, and the lines of groups that are one quoted path and nothing else."""
    groups = F.regexp_extract_all(source, F.lit(r"import\s+\(\s*([^)]*)\)"), F.lit(1))
    lines = F.transform(F.split(F.array_join(groups, "\n"), "\n"), lambda x: F.trim(x))
    whole = F.transform(F.filter(lines, lambda x: (F.length(x) > 1) & x.startswith('"') & x.endswith('"')), lambda x: F.regexp_replace(x, '^"+|"+$', ""))
    return F.array_distinct(F.concat(every(source, r'import\s+"([^"]+)"'), whole))


def csharp_imports(source: Column) -> Column:
    return F.array_distinct(every(source, r"using\s+([^\s;]+)"))


def other_imports(source: Column) -> Column:
    patterns = (r"""import\s+["']([^"']+)["']""", r"""from\s+["']([^"']+)["']""", r"using\s+([^\s;]+)")
    return F.array_distinct(F.concat(*[every(source, p) for p in patterns]))


def pattern_imports(source: Column, language: Column) -> Column:
    """Distinct imports of a text that isn't Python, sorted."""
    found = (
        F.when(language.isin("javascript", "typescript"), script_imports(source)).when(language == "go", go_imports(source)).when(language == "csharp", csharp_imports(source)).otherwise(other_imports(source))
    )
    return F.array_sort(found)


def imports(source: Column, language: Column) -> Column:
    """Imports by language. Only Python rows are parsed: others hand the parser an empty text."""
    parsed = python_imports(F.when(language == "python", source).otherwise(F.lit("")))
    return F.when(language == "python", parsed).otherwise(pattern_imports(source, language))
