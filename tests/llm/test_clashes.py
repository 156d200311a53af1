"""Extra columns may have any name: those of outputs, those used inside, in any letters, and those of the inputs in other letters."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import exact_dedup, html_text, media, mixing, near_dedup, pieces, quality, secrets, token_counts, transcripts

NAMES = [
    "Weight", "weight2", "s", "key", "stretch", "before", "at", "whole", "slope", "due", "turn", "Size", "source_size", "TARGET", "repeats", "taken", "Position", "Score", "predicted", "stats", "body", "id", "rest", "Kept", "keep_id", "GROUP_SIZE",
    "len", "gid", "digit", "end", "n", "next", "class", "round", "row", "r", "c", "words", "root", "class_id", "class_size", "Section", "start", "n_tokens", "n_crossing", "doc_tokens", "starts", "ids", "Ends", "decoded", "ids_sha256", "decoded_sha256",
    "spans_sha256", "covered_bytes", "n_bytes", "png", "Image", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", "Page", "n_chars2", "role", "content", "Formatted", "conv", "segment", "place", "hash",
    "candidate", "path", "t", "hinted", "p", "v", "p_at", "z", "shift", "k", "label", "held_out", "__text", "__doc", "c0", "C1", "c2", "c3", "c99", "v0", "none", "level", "full", "all_size", "TEXT", "Doc_ID", "SOURCE", "html2", "text.x", "with `tick",
]


@pytest.fixture(scope="module")
def extra(odd):
    """``odd`` with a column of each name."""
    return odd.select("*", *[F.lit("mine").alias(n) for n in NAMES if n.lower() != "n_chars"])


def without_case(df, columns):
    """Columns chosen by their exact names, also where others differ in letters only."""
    at = [df.columns.index(c) for c in columns]
    return sorted((tuple(r[k] for k in at) for r in df.collect()), key=str)


@pytest.mark.parametrize("operator, columns", [
    (mixing.plan, ["doc_id", "size", "target", "repeats", "taken", "position"]), (mixing.mix, ["doc_id", "text"]), (exact_dedup.exact_dedup, ["doc_id", "keep_id", "group_size", "kept"]), (near_dedup.near_classes, ["doc_id", "class_id", "class_size", "kept"]),
    (near_dedup.near_dedup, ["doc_id", "text"]), (lambda d: token_counts.count(d), ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]), (lambda d: pieces.encode(d), ["doc_id", "ids", "starts", "ends", "decoded"]),
    (lambda d: pieces.encode(d, keep="digests"), ["doc_id", "n_tokens", "ids_sha256", "spans_sha256"]), (lambda d: media.unpack(media.pack(d)), ["doc_id", "n_bytes", "payload_sha256", "tail_crc32", "feature", "error"]),
    (lambda d: html_text.extract_text(d, "text"), ["doc_id", "text", "n_chars"]), (lambda d: transcripts.parse(d, column="text"), ["doc_id", "turn", "role", "content"]), (lambda d: secrets.candidates(d), ["doc_id", "path", "start", "candidate"]),
    (lambda d: quality.with_statistics(d), ["doc_id", "stats"]),
])
def test_operator(odd, extra, operator, columns):
    assert without_case(operator(extra), columns) == without_case(operator(odd), columns)


def test_others_pass_through(extra):
    got = mixing.plan(extra)
    assert len(got.columns) == len({c.lower() for c in mixing.OUT} | {c.lower() for c in extra.columns}) + 3  # TEXT, Doc_ID and SOURCE stand beside text, doc_id and source
    assert {r[got.columns.index("Weight")] for r in got.collect()} == {"mine"}


@pytest.fixture(scope="module")
def labels(spark, odd):
    return spark.createDataFrame([(1, 1), (5, 0), (6, 0), (8, 1), (11, 1), (12, 0), (13, 0), (None, 1), (1, None)], "doc_id long, quality int")


def test_quality(odd, extra, labels):
    a, b = (quality.train(d, labels.withColumns({n: F.lit("mine") for n in ("label", "id", "y", "QUALITY2")})) for d in (odd, extra))
    assert without_case(quality.score(extra, b), ["doc_id", "score", "predicted"]) == without_case(quality.score(odd, a), ["doc_id", "score", "predicted"])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, sf_dir, extra, odd, name, stage):
    if name == "quality":
        extra, odd = (d.filter("n_chars IS NULL OR n_chars < 100") for d in (extra, odd))
    columns = ["doc_id", "n_tokens", "ids_sha256"] if name == "encoding" else odd.columns
    got = stage(spark, extra, sf_dir)
    if name != "encoding":
        assert got.columns == extra.columns
    assert without_case(got, columns) == without_case(stage(spark, odd, sf_dir), columns)
