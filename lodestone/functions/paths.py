"""Column functions on file paths: suffix, language, exclusion, globs, folders. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix to language.
LANGUAGES = {
    ".py": "python", ".go": "go", ".js": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".cs": "csharp", ".rs": "rust",
    ".java": "java", ".rb": "ruby", ".php": "php", ".c": "cpp", ".h": "cpp", ".cpp": "cpp", ".swift": "swift", ".kt": "kotlin",
    ".md": "doc", ".markdown": "doc", ".txt": "doc",
    ".yaml": "config", ".yml": "config", ".toml": "config", ".json": "config", ".cfg": "config", ".ini": "config", ".env": "config", ".xml": "config",
}
#: The suffix by which a search keeps to a language.
SEARCH_SUFFIX = {"python": ".py", "javascript": ".js", "typescript": ".ts", "go": ".go", "csharp": ".cs", "rust": ".rs", "java": ".java", "ruby": ".rb", "php": ".php", "cpp": ".cpp", "swift": ".swift", "kotlin": ".kt"}


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix_of(path: Column) -> Column:
    """Last suffix with its dot; empty for names such as ``.env`` and ``x.``."""
    return F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1)


def language_of(path: Column) -> Column:
    """Language by suffix in lower case; null for lock files, minified scripts and unknown suffixes."""
    name = name_of(path)
    special = (name == ".DS_Store") | name.contains("-lock") | name.endswith(".lock") | name.endswith(".min.js")
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(special, None).otherwise(F.try_element_at(known, F.lower(suffix_of(path))))


def supported(path: Column, extensions: Iterable[str]) -> Column:
    """Whether the suffix, in its own case, is among the extensions."""
    return suffix_of(path).isin(*extensions)


def glob_regex(pattern: str, across: bool = True) -> str:
    """Regular expression, unanchored, of a shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``). ``across``: ``*`` and ``?`` also match ``/``."""
    any_ = r"[\s\S]" if across else "[^/]"
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c in "*?":
            out.append(any_ + ("*" if c == "*" else ""))
        elif c == "[" and (end := pattern.find("]", at + 1 + pattern.startswith("!", at))) > 0:
            inner = pattern[at:end]
            no = inner.startswith("!")
            out.append(("[^" if no else "[") + re.sub(r"([\\\[\]^&])", r"\\\1", inner[no:]) + "]")
            at = end + 1
        else:
            out.append(re.sub(r"[^A-Za-z0-9_/ ]", lambda m: "\\" + m[0], c))
    return "".join(out)


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(rf"^(?:{glob_regex(pattern)})\z")


def is_excluded(path: Column, patterns: Iterable[str], root: str = "") -> Column:
    """Whether the path under ``root``, one of its components, or (for ``*.ext``) a name with ``-ext`` in it matches a pattern. One regular
    expression holds all patterns of a kind."""
    patterns = list(patterns)
    if not patterns:
        return F.lit(False)
    inner = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 1, 1 << 30)).otherwise(path) if root else path
    whole = "|".join(glob_regex(p) for p in patterns)
    parts = "|".join(glob_regex(p, across=False) for p in patterns)
    out = inner.rlike(rf"^(?:{whole})\z") | inner.rlike(rf"(?:^|/)(?:{parts})(?:/|\z)")
    for ext in (p[2:] for p in patterns if p.startswith("*.")):
        out = out | name_of(path).contains(f"-{ext}") | name_of(path).endswith(f".{ext}")
    return out


def top_folder(path: Column) -> Column:
    """First component below the root of an absolute path; the first of a relative one."""
    parts = F.split(path, "/")
    return F.when(path.startswith("/"), F.try_element_at(parts, F.lit(2))).otherwise(F.element_at(parts, 1))


def infer_package(path: Column, package_dirs: Column) -> Column:
    """Dotted chain of the folders above that hold an ``__init__.py`` (``package_dirs``: array of those among the path's ancestors), and the
    stem of a Python file; the stem alone otherwise."""
    stem = F.regexp_replace(name_of(path), r"(?<=.)\.[^.]+$", "")
    chain = F.transform(F.array_sort(package_dirs), lambda d: F.element_at(F.split(d, "/"), -1))
    named = F.when(suffix_of(path) == ".py", F.concat(chain, F.array(stem))).otherwise(chain)
    return F.when(F.size(chain) > 0, F.concat_ws(".", named)).otherwise(stem)
