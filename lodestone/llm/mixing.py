"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only.

Each source has a share of the total (its target) and a schedule: its weight runs linearly from ``1 - slope`` at the start of training to
``1 + slope`` at the end, in units of its mean. The integral of the schedule is the source's cumulative token demand; the cumulative size of
its documents, in an order fixed by the MD5 of the id with the text's MD5, is inverted through it to give every document (and every repetition of it) a training
position in [0, 1], by which the mix is range-sorted.

Prefix sums run in two levels, so that no task takes a whole source: the order is cut into 4,096 equal stretches of MD5 values per source,
sums of stretches are combined before the shuffle and summed over at most 4,096 rows, and a window then runs inside each stretch.

Targets by water-filling: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at three times its
source's size and the excess goes to the rest by weight until none is above. A source is repeated whole as often as its target holds it;
of the rest, a document is taken once more if its middle lies before the target. So no document is cut, and a source misses its target by
half a document at most.

Defined cases: null texts have size 0; null source is a source of its own, the last; a null id counts as an empty one in the MD5, so rows of one id, or of none, are
spread by their texts; rows alike in id and text are separate documents, equal in size, so which of them comes first changes nothing; documents of size 0 take no
words; a source of size 0 has target 0; an empty table gives an empty result; input columns named like an output column, in any letters, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Settled, Taken, text_of

CAP = 3
#: Slope of the schedule of weight 1, 2 and 3: light sources come early, heavy ones late.
SLOPES = (-0.5, 0.0, 0.5)
WORD = r"[^\x20\x09-\x0D]+"
OUT = ["size", "source_size", "target", "repeats", "taken", "position"]


def targets(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per source: s (null flag and name), source_size, weight, target."""
    by = sized.groupBy("s").agg(F.sum("size").alias("source_size"))
    # One row per source; the windows below run over these few rows only.
    by = by.withColumn("weight", (F.row_number().over(Window.orderBy("s")) - 1) % 3 + 1)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({"all_size": F.sum("source_size").over(all_rows), "all_weight": F.sum("weight").over(all_rows)})
    by = by.withColumn("level", (F.col("all_size") - cap * F.coalesce(F.sum("source_size").over(fill), F.lit(0))).cast("double") / (F.col("all_weight") - F.coalesce(F.sum("weight").over(fill), F.lit(0))).cast("double"))
    by = by.withColumn("full", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    # The level of the first source that is not capped is the level of all of those.
    level = F.min_by("level", F.struct((F.col("source_size") / F.col("weight")).alias("r"), "s")).over(Window.partitionBy("full"))
    return by.select("s", "source_size", "weight", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(level * F.col("weight")).alias("target"))


def when_due(done: Column, slope: Column) -> Column:
    """Inverse of the demand t + slope (t^2 - t), for done in [0, 1]."""
    b = 1 - slope
    root = (-b + F.sqrt(F.greatest(b * b + 4 * slope * done, F.lit(0.0)))) / (2 * slope)
    return F.least(F.greatest(F.when(F.abs(slope) < 1e-9, done).otherwise(root), F.lit(0.0)), F.lit(1.0))


def size_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    """What documents of a source are ordered by."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.md5(text)))


def source_of(source: Column) -> Column:
    """Orders as sources do, null last."""
    return F.struct(source.isNull().alias("u"), F.coalesce(source.cast("string"), F.lit("")).alias("s"))


def planned(sized: DataFrame, cap: int = CAP, slopes=SLOPES) -> DataFrame:
    """sized: s, key, size and columns named c0, c1, ...; with source_size, weight, target, repeats, taken, position, at (words of the source before the middle of the
    document) and slope."""
    sized = sized.withColumn("stretch", F.substring("key", 1, 3))
    goal = targets(sized, cap)
    before = Window.partitionBy("s").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretch = sized.groupBy("s", "stretch").agg(F.sum("size").alias("sum"))
    stretch = stretch.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum").join(goal, "s")
    within = Window.partitionBy("s", "stretch").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    # The window needs the rows of a stretch together, so the join by shuffle costs nothing further.
    rows = sized.join(stretch.hint("merge"), ["s", "stretch"]).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2)
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("repeats", F.col("whole") + (F.col("at") < F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), ((F.col("weight") - 1) % len(slopes) + 1).cast("int"))
    first = F.when((F.col("repeats") > 0) & (F.col("target") > 0), when_due(F.least(F.col("at") / F.col("target"), F.lit(1.0)), slope))
    return rows.withColumns({"taken": F.col("repeats") * F.col("size"), "position": first, "slope": slope})


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: int = CAP, slopes=SLOPES) -> DataFrame:
    """Each row of ``docs`` with size, source_size, target, repeats (0 to cap), taken = size x repeats, and the position of its first
    repetition (null if it isn't taken)."""
    own = Taken(docs)
    names, body = own.stay(OUT), text_of(own.at(text))
    sized = own.rows.select(*names, source_of(F.col(own.at(source))).alias("s"), key_of(F.col(own.at(doc_id)), body).alias("key"), size_of(body).alias("size"))
    return own.back(planned(sized, cap, slopes), names, OUT)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """The training set: the columns of ``docs``, a row for each repetition that the mix takes, range-sorted by training position."""
    own = Taken(docs)
    body = text_of(own.at(text))
    sized = own.rows.withColumns({"s": source_of(F.col(own.at(source))), "key": key_of(F.col(own.at(doc_id)), body), "size": size_of(body)})
    # Counted once: what is summed by source and stretch reads these columns only.
    sized = Settled(docs.sparkSession, "mix").keep(sized, "sized")
    rows = planned(sized, **how).filter("repeats > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    due = when_due(F.least((F.col("at") + F.col("turn") * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1e-9)), F.lit(1.0)), F.col("slope"))
    return own.back(rows.withColumn("due", due).orderBy("due", "key"), own.stay())


def op7(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position; sorted by position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(F.col("doc_id").alias("c0"), source_of(F.col("source")).alias("s"), key_of(F.col("doc_id"), text_of()).alias("key"), size_of(text_of()).alias("size"))
    rows = planned(Settled(spark, "mix").keep(sized, "sized")).orderBy("position", "key")
    return rows.select(F.col("c0").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER f, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::DOUBLE AS lev
       FROM s1 WINDOW f AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, lev * w >= 3 * source_size AS capped FROM s2),
s4 AS (SELECT source, source_size, w, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (SELECT first(lev ORDER BY source_size / w, source NULLS LAST) FROM s3 WHERE NOT capped) * w END AS target FROM s3),
r AS (SELECT d.*, s4.source_size, s4.target, CASE w WHEN 1 THEN -0.5 WHEN 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS sl,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS mid,
             CASE WHEN s4.source_size > 0 THEN floor(s4.target / s4.source_size) ELSE 0 END AS whole
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
q AS (SELECT *, (whole + CASE WHEN mid < target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS n, least(mid / target, 1.0) AS done FROM r)
SELECT doc_id, size, source_size, target, n * size AS taken,
       CASE WHEN n > 0 AND target > 0 THEN round(least(greatest(CASE WHEN sl = 0 THEN done ELSE (-(1 - sl) + sqrt(greatest((1 - sl) * (1 - sl) + 4 * sl * done, 0.0))) / (2 * sl) END, 0.0), 1.0), 9) END AS position
FROM q
"""
