import pytest
from pyspark.sql import types as T

from lodestone.llm import common

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(20_000))
#: Nulls in every column, empty and blank texts, ties, rows repeated in full, an id used twice, a long text.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 44), (2, "alpha  beta\ngamma delta epsilon zeta eta theta ", "en", "s1", 46), (2, "alpha  beta\ngamma delta epsilon zeta eta theta ", "en", "s1", 46), (None, "alpha beta gamma delta epsilon zeta eta theta", None, None, None),
    (5, None, "en", "s2", 0), (6, "", None, "s2", 0), (7, " \t\n", "de", None, 3), (8, LONG, "en", "s3", len(LONG)), (8, "another text under the same id", "fr", "s3", 30), (None, None, None, None, None), (11, "日本 é 𐍈 token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" x", "ja", "", 60),
    (12, "one two three", "en", "s4", 13), (13, "One two  three", "en", "s4", 14),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return lambda name: common.table(spark, sf_dir, name)


def clashing(df, *names):
    """The table with extra columns of these names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names})
