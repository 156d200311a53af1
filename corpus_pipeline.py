"""Corpus pipeline: quality filter, exact dedup, near dedup, mixing, encoding; each stage runs one operator on all that the one before kept.

Between stages the documents are written as Parquet to the shared folder and read again, so lineage is cut and a lost executor costs one stage.
A stage returns the columns of ``documents``; the last returns one row per document of the mix with its encoding.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, mixing, near_dedup, pieces, quality
from lodestone.llm.common import SCOPE, Settled, Taken, small_batches

#: What the operators of the last stage have settled. A stage's documents are a table of their own, so it goes when the next stage begins.
_settled: list[Settled] = []


def stage(f):
    """A stage that clears up after the one before. Stages may be called one by one, so each bounds its Arrow batches."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _settled:
            _settled.pop().close()
        small_batches(spark)
        token = SCOPE.set(_settled)
        try:
            return f(spark, docs, sf_dir)
        finally:
            SCOPE.reset(token)

    return run_stage


def kept(docs: DataFrame, operator) -> DataFrame:
    """The rows of ``docs`` that the operator keeps of (id, body, rest), with their own columns, whatever their names."""
    own = Taken(docs)
    i, body = own.at("doc_id"), own.at("text")
    rest = [c for c in own.stay() if c not in (i, body)]
    rows = operator(own.rows.select(F.col(i).alias("id"), F.col(body).alias("body"), F.struct(F.lit(0).alias("none"), *rest).alias("rest")))
    return own.back(rows.select(F.col("id").alias(i), F.col("body").alias(body), *[F.col(f"rest.{c}").alias(c) for c in rest]), own.stay())


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels that fall to training, doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept(docs, lambda rows: quality.score(rows, model, "body").filter("predicted = 1"))


@stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original."""
    return kept(docs, lambda rows: exact_dedup.exact_dedup(rows, "body", "id").filter("kept"))


@stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.near_dedup(docs)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, in training order; a document stands as often as the mix repeats it."""
    return mixing.mix(docs)


@stage
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256 and the digest of the spans."""
    own = Taken(docs)
    return pieces.encode(own.rows.select(F.col(own.at("doc_id")).alias("doc_id"), F.col(own.at("text")).alias("text")), keep="digests")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The classifier and the tokenizer have no SQL form; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    done = Settled(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = done.keep(docs, name)
    return docs
