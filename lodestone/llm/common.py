"""Shared helpers of the training-data operators.

Nothing outside this subpackage imports it, and it imports nothing of the rest of the library.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that an Arrow batch holds at most in the registered queries. Spark bounds the bytes of a batch by itself (64 MB), so this only keeps batches small.
BATCH_ROWS = "512"
#: Characters of the texts that a Python operator works on at a time; a longer text is worked on alone.
PORTION = 4_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches in this session. For applications (the registered queries and the pipeline); operators leave the caller's session as it is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def portions(batches: Iterator[pd.DataFrame], column: str, most: int = PORTION) -> Iterator[pd.DataFrame]:
    """The rows of the batches in order, in frames whose texts hold at most ``most`` characters together, or are a single one."""
    for x in batches:
        size = x[column].str.len().to_numpy(int).cumsum() if len(x) else []
        at = 0
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield x.iloc[at:stop].reset_index(drop=True)
            at = stop


class Taken:
    """A caller's table under names of our own (c0, c1, ...), so no name of theirs can meet one of ours, whatever letters it is written in.

    ``rows`` is the table, ``at(name)`` our name of a column (an exact name goes before one in other letters), and ``stay(new, drop)`` our names of the columns that an
    output with the columns ``new`` passes through: all but those named like an output column, in any letters, and those dropped."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.rows = df.toDF(*[f"c{k}" for k in range(len(self.names))])

    def at(self, name: str) -> str:
        hits = [k for k, n in enumerate(self.names) if n == name] or [k for k, n in enumerate(self.names) if n.lower() == name.lower()]
        if not hits:
            raise ValueError(f"no column {name!r} among {self.names}")
        return f"c{hits[0]}"

    def has(self, name: str) -> bool:
        return name.lower() in {n.lower() for n in self.names}

    def stay(self, new: Sequence[str] = (), drop: Sequence[str] = ()) -> list[str]:
        out = {n.lower() for n in new}
        gone = {self.at(d) for d in drop}
        return [f"c{k}" for k, n in enumerate(self.names) if n.lower() not in out and f"c{k}" not in gone]

    def name(self, own: str) -> str:
        return self.names[int(own[1:])]

    def back(self, df: DataFrame, own: Sequence[str], new: Sequence[str] = ()) -> DataFrame:
        """``df``, whose columns are ``own`` and then ``new``, under the caller's names."""
        return df.select(*own, *new).toDF(*[self.name(c) for c in own], *new)

    def mapped(self, run, own: Sequence[str], new: str, **inputs: Column) -> DataFrame:
        """``mapInPandas`` over the columns ``own`` and the named inputs; ``run`` gives ``own`` and the columns of the schema ``new``."""
        added = T._parse_datatype_string(new)
        rows = self.rows.select(*own, *[c.alias(k) for k, c in inputs.items()])
        schema = T.StructType([rows.schema[c] for c in own] + added.fields)

        def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Columns of an empty frame have types of their own that don't all convert.
            return (out for out in run(x for x in batches if len(x)) if len(out))

        return self.back(rows.mapInPandas(filled, schema), own, added.fieldNames())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset in local mode (tests), a temporary one of our own. On a cluster without it this raises:
    a folder of one machine would not be the others'."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if "LODESTONE_SCRATCH" not in os.environ:
            os.environ["LODESTONE_SCRATCH"] = tempfile.mkdtemp(prefix="lodestone-")
        told = f"file://{os.environ['LODESTONE_SCRATCH']}"
    return told.rstrip("/")


#: Where a pipeline collects what the operators of a stage settle, to delete it once the stage's result is written.
SCOPE: ContextVar[list | None] = ContextVar("settled", default=None)


#: Folders of tables that are still there, for ``_clear``.
_live: dict[str, SparkSession] = {}


@atexit.register
def _clear() -> None:
    """Delete what results may have read until the end of the program."""
    for base, spark in _live.items():
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, base)
            elif base.startswith("file://"):
                shutil.rmtree(base.removeprefix("file://"), ignore_errors=True)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Settled:
    """Tables written to the shared folder to cut lineage; ``drop`` removes those that nothing reads any more. A result may read the last of them at any time, so these go
    with ``close``, at the end of a pipeline's stage or at the end of the program."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.names = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", set()
        _live[self.base] = spark
        if (scope := SCOPE.get()) is not None:
            scope.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path := f"{self.base}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.base}/{name}")
            self.names.discard(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))

    def close(self) -> None:
        _delete(self.spark, self.base)
        _live.pop(self.base, None)
        self.names.clear()
