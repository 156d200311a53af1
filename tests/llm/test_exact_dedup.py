from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup as ed

from .conftest import DOCS, ODD, clashing

SPACE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, kept) of each row."""
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(SPACE)].append((-len(r[1] or ""), r[0] is None, r[0]))
    out = []
    for own in groups.values():
        own.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, own[0][2], len(own), k == 0) for k, (_, _, i) in enumerate(own)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_odd_rows(odd):
    assert found(ed.exact_dedup(odd)) == brute(ODD)


def test_several_rounds(spark):
    base = "x" * 200 + "y" * 3000
    rows = [(1, base + "a"), (2, base + "b"), (3, base), (4, base + "a "), (5, "x" * 64), (6, "x" * 65), (7, "x" * 64), (8, base[:64]), (9, base + "a" * 20_000), (10, base + "a" * 20_000 + "\t")]
    assert found(ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.text("ab \n", max_size=70))), max_size=20))
def test_property(spark, rows):
    assert found(ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_and_clashing(odd, none):
    assert ed.exact_dedup(none).count() == 0
    out = ed.exact_dedup(clashing(odd, "keep_id", "group_size", "kept", "digest"))
    assert found(out) == brute(ODD) and {r.digest for r in out.collect()} == {"mine"}


def test_query(spark, sf_dir, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert found(ed.op3(spark, sf_dir)) == brute(rows)


def test_rows_are_told_apart_alike_in_every_reading(spark):
    """Row ids are written: reading the table in other splits gives the same ones."""
    docs = spark.createDataFrame([(k // 3, f"text {k % 4}") for k in range(400)], "doc_id long, text string").repartition(6)
    rows = ed.classes(docs.select(docs.doc_id.alias("c0"), docs.text.alias("c1"), F.length("text").alias("len")), "c1")
    first = sorted(map(tuple, rows.collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        again = sorted(map(tuple, rows.select("*").filter("true").distinct().collect()))
        assert again == first and len({r[-1] for r in first}) == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
