"""Column functions on text: cleaning, hashing, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what the index folds them to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text; invalid bytes are dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def sanitized(text: Column) -> Column:
    """Without control characters, but tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def workspace_id(root: Column) -> Column:
    return F.substring(sha256(root), 1, 12)


def folded(text: Column) -> Column:
    """Lower case, without the marks of Latin letters. Texts of one-byte characters have none to fold."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))


def token_line(text: Column) -> Column:
    """The tokens in one line, each with a space on either side shared with its neighbour; empty without tokens."""
    line = F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(line == "", F.lit("")).otherwise(F.concat(F.lit(" "), line, F.lit(" ")))


def token_count(line: Column) -> Column:
    """Tokens of a token line, or of several put together."""
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit("")))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def embed_text(signature: Column, docstring: Column, code: Column, limit: int = 8000) -> Column:
    """Signature, docstring and code by lines, the last two where there are any, cut to the limit."""
    return F.substring(F.concat_ws("\n", F.coalesce(signature, F.lit("")), F.nullif(docstring, F.lit("")), F.nullif(code, F.lit(""))), 1, limit)


def flat_metadata(fixed: dict[str, Column], extra: Column) -> Column:
    """One flat object as a variant: fixed entries, and ``meta_`` ones from an object (JSON text or variant). Scalars keep their types, lists and objects become JSON texts, nulls are
    left out. Anything but an object has no entries."""
    own = F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), v.cast("variant"))])
    entries = F.transform_keys(F.from_json(extra.cast("string"), "map<string,variant>"), lambda k, _: F.concat(F.lit("meta_"), k))
    nested = lambda v: F.schema_of_variant(v).rlike("^(?:ARRAY|OBJECT)")
    more = F.transform_values(entries, lambda _, v: F.when(nested(v), F.to_json(v).cast("variant")).otherwise(v))
    both = F.map_concat(own, F.coalesce(more, F.create_map().cast("map<string,variant>")))
    return F.to_variant_object(F.map_filter(both, lambda _, v: v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))))
