"""Tags by path rules, validation of tags against a taxonomy, and reading a model's answer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DESIGN_PATTERNS, FRAMEWORKS, PURPOSES
from .paths import name_of, suffix_of

# Rules on path components, suffixes and names.
TEST_ENDINGS = ("_test.py", "_test.js", "_test.ts", "_spec.py", "_spec.js", "_test", "_spec")
CONFIG_SUFFIXES = (".yaml", ".yml", ".toml", ".cfg", ".ini", ".json", ".env", ".xml")
DOC_SUFFIXES = (".md", ".markdown", ".txt")
LAYERS = {
    "layer:api": (("api", "routes", "views", "controllers"), ("route",)),
    "layer:model": (("models", "entities", "schemas", "db"), ("model",)),
    "layer:service": (("services", "lib", "core", "business"), ()),
    "layer:middleware": (("middleware",), ("middleware", "interceptor")),
    "layer:utils": (("utils", "helpers", "common", "shared"), ()),
}


def any_of(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def path_tags(path: Column, language: Column) -> Column:
    """Sorted tags that follow from the path alone."""
    low, name = F.lower(path), F.lower(name_of(path))
    within = lambda text, words: text.rlike(rf"(?:^|/)(?:{'|'.join(words)})(?:/|\z)")
    suffix = F.lower(suffix_of(path))
    rules = {
        "type:test": within(low, ("test", "tests", "__tests__")) | any_of(name.endswith(e) for e in TEST_ENDINGS),
        "type:config": suffix.isin(*CONFIG_SUFFIXES) | name.contains(".env"),
        "type:doc": suffix.isin(*DOC_SUFFIXES) | within(path, ("docs",)),
    } | {tag: within(low, parts) | any_of(name.contains(w) for w in words) for tag, (parts, words) in LAYERS.items()}
    found = [F.when(language.isNotNull(), F.concat(F.lit("lang:"), language)), *[F.when(test, F.lit(tag)) for tag, test in rules.items()]]
    return F.array_sort(F.array_compact(F.array(*found)))


def valid_tags(tags: Column, framework: Iterable[str] = FRAMEWORKS, design_pattern: Iterable[str] = DESIGN_PATTERNS) -> Column:
    """Sorted distinct tags that the taxonomy knows; lang, type and layer are open."""

    def known(tag: Column) -> Column:
        kind, value = F.substring_index(tag, ":", 1), F.regexp_extract(tag, r"^[^:]*:([\s\S]*)$", 1)
        return tag.contains(":") & (
            ((kind == "framework") & value.isin(*framework)) | ((kind == "design_pattern") & value.isin(*design_pattern)) | ((kind == "purpose") & value.isin(*PURPOSES)) | kind.isin("lang", "type", "layer")
        )

    return F.array_sort(F.array_distinct(F.filter(tags, known)))


def answered_tags(answer: Column) -> Column:
    """Trimmed tags of a JSON object with a list ``tags`` (none: empty); null where the answer isn't such an object."""
    read = F.from_json(F.trim(answer), "tags array<string>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    tags = F.coalesce(read["tags"], F.array().cast("array<string>"))
    return F.when(read.isNull() | read["_corrupt"].isNotNull() | ~F.trim(answer).startswith("{"), None).otherwise(F.transform(tags, lambda t: F.trim(t)))
