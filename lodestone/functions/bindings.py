"""What the names of a source file stand for: names that its imports bind, and scopes whose names it uses bare.

A full name is a family of languages, a colon, and dotted parts: ``python:pkg.mod.f``, ``csharp:Space.Type.F``, ``go:/w/folder.F``, ``script:/w/folder/file.f`` (a path without
its suffix). A binding with an empty alias is an open scope. Where an import may mean several places, it gives several bindings, the likelier first.
"""

from __future__ import annotations

import ast
import posixpath
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BINDINGS = "array<struct<alias string, full string>>"
FAMILIES = {"python": "python", "javascript": "script", "typescript": "script", "go": "go", "csharp": "csharp"}
SCRIPT_SUFFIX = re.compile(r"\.(?:jsx?|tsx?|mjs|cjs)$")
Found = list[tuple[str, str]]


def python_bindings(source: str, package: str, path: str) -> Found:
    """Imports at any depth; ``package`` is the module's own dotted name, with ``__init__`` for a package's file. Nothing of a text that doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    steps = package.split(".") if package else []
    own = steps[:-1] if steps[-1:] == ["__init__"] else steps
    out: Found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.asname, a.name) if a.asname else (a.name.partition(".")[0],) * 2 for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            # One dot is the folder of the module.
            above = steps[: max(len(steps) - node.level, 0)] if node.level else []
            base = ".".join([*above, *([node.module] if node.module else [])])
            out += [("" if a.name == "*" else a.asname or a.name, base if a.name == "*" else f"{base}.{a.name}".lstrip(".")) for a in node.names]
    return [*out, ("", ".".join(own))]


SCRIPT_FROM = re.compile(r"""\bimport\s+(?!type\s+\w+\s*=)(?:type\s+)?(?P<what>[\w$*\s{},]+?)\s+from\s+["'](?P<at>[^"'\n]+)["']""")
SCRIPT_REQUIRE = re.compile(r"""\b(?:const|let|var)\s+(?P<what>[\w$]+|\{[^}]*\})\s*=\s*require\(\s*["'](?P<at>[^"'\n]+)["']\s*\)""")
SCRIPT_PART = re.compile(r"(?:(?P<name>[\w$]+|\*)\s*(?:\bas\b|:)\s*)?(?P<alias>[\w$]+)")


def script_bindings(source: str, package: str, path: str) -> Found:
    """Imports and ``require`` of relative paths. A default import stands for the symbol of its own name."""
    out: Found = []
    for m in [*SCRIPT_FROM.finditer(source), *SCRIPT_REQUIRE.finditer(source)]:
        if not m["at"].startswith("."):
            continue
        near = SCRIPT_SUFFIX.sub("", posixpath.normpath(posixpath.join(posixpath.dirname(path), m["at"])))
        inside = re.search(r"\{([^}]*)\}", m["what"])
        plain = re.sub(r"\{[^}]*\}", "", m["what"])
        whole = m.re is SCRIPT_REQUIRE
        for module in (near, f"{near}/index"):
            for part in (inside[1] if inside else "").split(","):
                if p := SCRIPT_PART.fullmatch(part.strip().removeprefix("type ").strip()):
                    out.append((p["alias"], f"{module}.{p['name'] or p['alias']}"))
            for part in plain.split(","):
                if p := SCRIPT_PART.fullmatch(part.strip()):
                    out.append((p["alias"], module if whole or p["name"] == "*" else f"{module}.{p['alias']}"))
    return [*out, ("", SCRIPT_SUFFIX.sub("", path))]


GO_GROUP = re.compile(r"\bimport\s*\(([^)]*)\)")
GO_ONE = re.compile(r'(?:(?P<alias>[\w.]+)[ \t]+)?"(?P<at>[^"\n]+)"')


def go_bindings(source: str, package: str, path: str, root: str) -> Found:
    """An import path names a folder below the root; what stands before the folder's part of it is the module's name, so shorter parts are tried after longer ones."""
    out: Found = []
    heads = [m[1] for m in GO_GROUP.finditer(source)] + re.findall(r'\bimport\s+((?:[\w.]+[ \t]+)?"[^"\n]+")', source)
    for m in (m for head in heads for m in GO_ONE.finditer(head)):
        steps = m["at"].split("/")
        alias = m["alias"] or next((s for s in reversed(steps) if not re.fullmatch(r"v\d+", s)), steps[-1])
        out += [("" if alias == "." else alias, f"{root}/{'/'.join(steps[k:])}") for k in range(len(steps)) if alias != "_"]
    return [*out, ("", posixpath.dirname(path))]


CSHARP_USING = re.compile(r"\busing\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<at>[\w.]+)\s*;")
CSHARP_SPACE = re.compile(r"\bnamespace\s+([\w.]+)")


def csharp_bindings(source: str, package: str, path: str) -> Found:
    """Namespaces in use, aliases, and the file's own namespaces with those around them."""
    out = [(m["alias"] or "", m["at"]) for m in CSHARP_USING.finditer(source)]
    for space in dict.fromkeys(CSHARP_SPACE.findall(source)):
        steps = space.split(".")
        out += [("", ".".join(steps[:k])) for k in range(len(steps), 0, -1)]
    return out


def of_file(source: str, language: str, package: str, path: str, root: str) -> Found:
    """The bindings of a file, each once; none for other languages."""
    family = FAMILIES.get(language)
    if family == "go":
        found = go_bindings(source, package, path, root)
    elif family:
        found = {"python": python_bindings, "script": script_bindings, "csharp": csharp_bindings}[family](source, package, path)
    else:
        return []
    return [(alias, f"{family}:{full}") for alias, full in dict.fromkeys(found)]


def bindings(source: Column, language: Column, package: Column, path: Column, root: str) -> Column:
    """Column of ``of_file``; only texts of the families reach Python."""
    top = root.rstrip("/")

    @F.pandas_udf(BINDINGS)
    def run(source: pd.Series, language: pd.Series, package: pd.Series, path: pd.Series) -> pd.Series:
        rows = zip(source, language, package, path, strict=True)
        return pd.Series([[{"alias": a, "full": f} for a, f in of_file(s or "", k or "", p or "", at, top)] for s, k, p, at in rows], index=source.index, dtype=object)

    asked = F.when(language.isin(*FAMILIES), source).otherwise(F.lit(""))
    return run(asked, F.coalesce(language, F.lit("")), F.coalesce(package, F.lit("")), path)
