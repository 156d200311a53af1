"""Symbols of source texts: a table function in Arrow batches. Python is parsed; languages with braces are scanned; other texts are one chunk."""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as text_functions
from ..schema import SYMBOL

DOC_LIMIT = 2000
SCRIPT, GO, CSHARP = ("javascript", "typescript"), "go", "csharp"


@dataclass
class Symbol:
    type: str
    name: str
    package: str
    start_line: int
    end_line: int
    signature: str
    code: str
    docstring: str = ""
    metadata: dict[str, str | bool] = field(default_factory=dict)

    def row(self) -> tuple:
        return self.type, self.name, self.package, self.start_line, self.end_line, self.signature, self.docstring, self.code, json.dumps(self.metadata)


def shown(name: str) -> str:
    return "private" if name.startswith("_") else "public"


# Python


def python_symbols(source: str, package: str) -> list[Symbol]:
    """Functions, classes and their direct methods at the top of a module; nothing of a text that doesn't parse."""
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = source.split("\n")

    def made(node: ast.AST, kind: str, head: str, package: str, **metadata: str | bool) -> Symbol:
        last = node.end_lineno or node.lineno
        doc = (ast.get_docstring(node) or "")[:DOC_LIMIT]
        return Symbol(kind, node.name, package, node.lineno, last, head, "\n".join(lines[node.lineno - 1 : last]), doc, {**metadata, "visibility": shown(node.name)})

    def function(node: ast.FunctionDef | ast.AsyncFunctionDef, kind: str, package: str, **metadata: str | bool) -> Symbol:
        waits = isinstance(node, ast.AsyncFunctionDef)
        gives = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        return made(node, kind, f"{'async ' * waits}def {node.name}({ast.unparse(node.args)}){gives}", package, is_async=waits, **metadata)

    out = []
    for node in module.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(function(node, "function", package))
        elif isinstance(node, ast.ClassDef):
            bases = f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else ""
            out.append(made(node, "class", f"class {node.name}{bases}", package))
            for item in node.body:
                if isinstance(item, ast.FunctionDef | ast.AsyncFunctionDef):
                    static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in item.decorator_list)
                    out.append(function(item, "method", f"{package}.{node.name}", class_name=node.name, is_static=static))
    return out


# Languages with braces


class Scanned:
    """A text with the places of its line feeds, braces and quotes."""

    def __init__(self, source: str, quotes: str):
        self.source = source
        self.feeds = [m.start() for m in re.finditer("\n", source)]
        self.marks = [(m.start(), m[0]) for m in re.finditer(f"[{{}}{quotes}]", source)]
        self.places = [at for at, _ in self.marks]

    def line(self, at: int) -> int:
        """Line, from 1, of a place."""
        return bisect_right(self.feeds, at - 1) + 1

    def body_end(self, at: int) -> int:
        """End of the balanced block that opens first after a place; the place itself if none closes. Braces in strings don't count; a quote after a backslash ends none."""
        depth, inside = 0, ""
        for place, mark in self.marks[bisect_right(self.places, at - 1) :]:
            if inside:
                if mark == inside and self.source[place - 1] != "\\":
                    inside = ""
            elif mark == "{":
                depth += 1
            elif mark == "}":
                depth -= 1
                if depth == 0:
                    return place + 1
            else:
                inside = mark
        return at

    def symbol(self, m: re.Match, kind: str, name: str, package: str, signature: str, body_from: int | None = None, **metadata: str | bool) -> Symbol:
        end = self.body_end(m.end() if body_from is None else body_from)
        return Symbol(kind, name, package, self.line(m.start()), self.line(end), signature, self.source[m.start() : max(end, m.end())], "", metadata)


SCRIPT_CLASS = re.compile(r"(?:\bexport\s+)?\bclass\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>\w+))?")
SCRIPT_FUNCTION = re.compile(r"(?:\bexport\s+)?(?P<wait>\basync\s+)?\bfunction\s+(?P<name>\w+)\s*\((?P<args>[^)]*)\)")


def script_symbols(source: str, package: str) -> list[Symbol]:
    """JavaScript and TypeScript: classes, then functions."""
    scan = Scanned(source, "\"'`")
    classes = [scan.symbol(m, "class", m["name"], package, f"class {m['name']}" + (f" extends {m['base']}" if m["base"] else "")) for m in SCRIPT_CLASS.finditer(source)]
    return classes + [
        scan.symbol(m, "function", m["name"], package, f"{'async ' * bool(m['wait'])}function {m['name']}({m['args']})", is_async=bool(m["wait"])) for m in SCRIPT_FUNCTION.finditer(source)
    ]


GO_PACKAGE = re.compile(r"\bpackage\s+(\w+)")
GO_FUNCTION = re.compile(r"\bfunc\s+(?:\(\s*(?P<self>\w+)\s+(?P<type>\*?\w+)\s*\)\s+)?(?P<name>\w+)\s*\((?P<args>[^)]*)\)[ \t]*(?P<gives>[^{\n]*)")
GO_TYPE = re.compile(r"\btype\s+(?P<name>\w+)\s+(?P<kind>struct|interface)\b")


def go_symbols(source: str, package: str) -> list[Symbol]:
    """Functions and methods, then structs and interfaces; the body is the balanced block after the header."""
    scan = Scanned(source, '"`')
    named = GO_PACKAGE.search(source)
    package = named[1] if named else package
    out = []
    for m in GO_FUNCTION.finditer(source):
        owner = f" ({m['self']} {m['type']})" if m["self"] else ""
        gives = m["gives"].strip()
        signature = f"func{owner} {m['name']}({m['args']})" + (f" {gives}" if gives else "")
        about = {"is_method": bool(owner)} | ({"receiver_type": m["type"]} if owner else {})
        out.append(scan.symbol(m, "method" if owner else "function", m["name"], package, signature, **about))
    return out + [scan.symbol(m, "class", m["name"], package, f"type {m['name']} {m['kind']}", type_kind=m["kind"]) for m in GO_TYPE.finditer(source)]


ACCESS = r"(?:\b(?:public|private|protected|internal)\s+)?"
CSHARP_SPACE = re.compile(r"\bnamespace\s+([\w.]+)")
CSHARP_TYPE = re.compile(ACCESS + r"(?:\b(?:static|abstract|sealed|partial)\s+)*\b(?P<kind>class|interface|struct)\s+(?P<name>\w+)")
CSHARP_METHOD = re.compile(ACCESS + r"(?P<static>\bstatic\s+)?(?:\b(?:virtual|override|abstract|sealed)\s+)?(?P<wait>\basync\s+)?\b(?P<gives>\w+(?:<[^>\n]+>)?)\s+(?P<name>\w+)\s*\((?P<args>[^)]*)\)")
#: Words that stand where a return type would, in front of a call.
NO_TYPE = frozenset("await return new throw else in is as yield case when using lock nameof typeof default not and or out ref".split())
NO_NAME = frozenset("if for foreach while switch catch lock using return".split())


def around(owners: list[tuple[int, int, str]], lines: list[int]) -> list[dict[str, str]]:
    """For each of the lines, which ascend, the name of the innermost of the nested types (first line, last line, name; in order) that holds it."""
    out, held, k = [], [], 0
    for line in lines:
        while k < len(owners) and owners[k][0] <= line:
            held.append(owners[k])
            k += 1
        while held and held[-1][1] < line:
            held.pop()
        out.append({"class_name": held[-1][2]} if held else {})
    return out


def csharp_symbols(source: str, package: str) -> list[Symbol]:
    """Types (their kind in the metadata), then methods (with the innermost type around each)."""
    scan = Scanned(source, "\"'")
    named = CSHARP_SPACE.search(source)
    package = named[1] if named else package
    types = [scan.symbol(m, "class", m["name"], package, f"{m['kind']} {m['name']}", class_kind=m["kind"]) for m in CSHARP_TYPE.finditer(source)]
    owners = sorted((scan.line(m.start()), t.end_line, t.name) for m, t in zip(CSHARP_TYPE.finditer(source), types, strict=True))
    methods = [m for m in CSHARP_METHOD.finditer(source) if m["gives"] not in NO_TYPE and m["name"] not in NO_NAME]
    return types + [scan.symbol(m, "method", m["name"], package, f"{m['gives']} {m['name']}({m['args']})", is_async=bool(m["wait"]), is_static=bool(m["static"]), **own) for m, own in zip(methods, around(owners, [scan.line(m.start()) for m in methods]), strict=True)]


def whole_file(source: str, path: str, language: str) -> list[Symbol]:
    name = path.rsplit("/", 1)[-1]
    return [Symbol("doc" if language == "doc" else "config", name, "", 1, source.count("\n") + 1, name, source)]


def symbols(source: str, path: str, language: str | None, package: str) -> list[Symbol]:
    """Symbols of one text by its language; none where the language is unknown."""
    if not language:
        return []
    if language == "python":
        return python_symbols(source, package)
    if language in SCRIPT:
        return script_symbols(source, package)
    if language == GO:
        return go_symbols(source, package)
    if language == CSHARP:
        return csharp_symbols(source, package)
    return whole_file(source, path, language)


def chunk_files(files: DataFrame) -> DataFrame:
    """From files with workspace_id, file_path, language, package and source: their symbols, one row each, and ``error`` for a file that
    failed. Code languages go through Python; whole-file chunks are made of columns alone."""
    keys = T.StructType([files.schema[c] for c in ("workspace_id", "file_path", "language")])
    schema = T.StructType([*keys.fields, *SYMBOL.fields, T.StructField("error", T.StringType())])
    names = SYMBOL.fieldNames()
    parsed = F.col("language").isin("python", *SCRIPT, GO, CSHARP)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for workspace, path, language, package, source in x.itertuples(index=False, name=None):
                try:
                    rows += [(workspace, path, language, *s.row(), None) for s in symbols(source or "", path, language, package or "")]
                except Exception as e:  # one bad file doesn't end the job
                    rows.append((workspace, path, language, *[None] * len(names), f"{path}: {e}"))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    code = files.filter(parsed).select("workspace_id", "file_path", "language", "package", "source").mapInPandas(run, schema)
    return code.unionByName(whole_file_chunks(files.filter(~parsed & F.col("language").isNotNull())))


def whole_file_chunks(files: DataFrame) -> DataFrame:
    """One chunk per file, without Python."""
    name = F.element_at(F.split("file_path", "/"), -1)
    return files.select(
        "workspace_id", "file_path", "language", F.when(F.col("language") == "doc", "doc").otherwise("config").alias("type"), name.alias("name"), F.lit("").alias("package"), F.lit(1).alias("start_line"),
        text_functions.line_count(F.col("source")).alias("end_line"), name.alias("signature"), F.lit("").alias("docstring"), F.col("source").alias("code"),
        F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("error"),
    )
