"""Schemas of the stored tables. They are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType()), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType()), "variant": T.VariantType(),
}


def struct(fields: str) -> T.StructType:
    """A schema from ``name kind`` pairs; needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in fields.split(","))])


CHUNK = struct(
    "workspace_id string, language string, chunk_id string, type string, name string, package string, file_path string, start_line int, end_line int,"
    " selection_start int, selection_end int, signature string, docstring string, code string, tags strings, metadata variant,"
    " embed_text string, embedding floats, words string, length int"
)
#: Made of each segment of chunks: the postings of its terms, and what is counted of each file, with the numbers of its chunks.
POSTING = struct("workspace_id string, language string, term string, block long, places ints, lengths ints, times ints, positions ints")
ROLLUP = struct("workspace_id string, language string, file_path string, functions long, classes long, methods long, symbols long, lines long, words long, numbers longs")
FILE = struct("workspace_id string, file_path string, language string, file_hash string, size_bytes long, indexed_at timestamp")
EDGE = struct("workspace_id string, source_symbol string, target_symbol string, symbols strings, file_path string")
USE = struct("workspace_id string, file_path string, symbol string, start_line int, own string, ref string, targets strings")
SCAN = struct("workspace_id string, files_scanned long, chunks_created long, duration_ms long, ts timestamp")
WORKSPACE = struct("id string, name string, root string, marker_type string, languages strings, created_at timestamp")
TAG_CACHE = struct("file_hash string, tags strings, created_at timestamp")
EVENT = struct("event_type string, file_path string, dest_path string, is_directory boolean, ts timestamp")

#: What a chunker returns for a file; metadata is JSON.
SYMBOL = struct(
    "type string, name string, package string, start_line int, end_line int, signature string, docstring string, code string, metadata string"
)
