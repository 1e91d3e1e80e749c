"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: all words shared out by weight, no
source above ``most`` times its own size, the excess shared again by weight. A
document's expected copies are its source's target by its source's size. Along
the documents of a source, in order of (size, a salt of doc_id, doc_id), these
expectations are summed up from one random offset, and a document is taken once
for each whole number that its part of the sum crosses. In order of size, each
stretch of like sizes gets its share, so the words taken come near the target.

The place of a document in its source is a count over smaller sizes, plus one over
smaller salts of its size, plus its row number in (source, size, salt): no window
holds a whole source or size.

The targets have a closed form: with the sources in order of cap by weight, the
level ``(all words - caps before) / weights from here on`` is largest where the
last source that is cut off has been taken out; a target is that level times the
weight, or the cap if that is less.

Cases: a null or empty text has size 0 and is sampled like any other; a null
source is a source of its own, last in order; a source without words has target
0; null doc_ids sort first; repeated rows are rows of their own; an empty table
gives an empty table; further columns are kept, and helper columns never clash,
as all work on the documents' columns goes through one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def sized(docs: DataFrame) -> DataFrame:
    """(row: all columns of docs, doc_id, source, size, salt)."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{WORD_SPACE}]+")).cast("long")
    salt = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("source"), size.alias("size"), salt.alias("salt"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, start (the random offset) from (source, source_size); one row a source throughout."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    cap = F.col("source_size") * most
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    on = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
             / F.sum("weight").over(on))
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "/"), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1, 8),
                     16, 10).cast("double") / float(1 << 32))
    return (sources.withColumn("weight", weight.cast("long")).withColumn("cap", cap.cast("long"))
            .withColumn("level", level).withColumn("level", F.max("level").over(all_rows))
            .select("source", "source_size",
                    F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"), offset.alias("start")))


def sample_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies) of every document."""
    rows = sized(docs)
    keys = ["source", "size", "salt"]
    per_salt = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    in_size = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_salt.groupBy("source", "size").agg(F.sum("n").alias("n"))
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sources = source_targets(per_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    before = F.coalesce(F.sum("n").over(in_source), F.lit(0))
    size_start = per_size.withColumn("size_start", before).select(F.col("source").alias("s1"), F.col("size").alias("z1"), "size_start")
    salt_start = per_salt.withColumn("salt_start", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    starts = (salt_start.join(size_start, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1")))
              .join(sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
              .select(*[F.col(k).alias(f"k_{k}") for k in keys], "source_size", "target", "start",
                      (F.col("size_start") + F.col("salt_start")).alias("first")))
    in_salt = Window.partitionBy(*keys).orderBy("doc_id")
    same = F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")) & (F.col("salt") == F.col("k_salt"))
    placed = rows.withColumn("place", F.row_number().over(in_salt)).join(starts, same)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    last = (F.col("first") + F.col("place")).cast("double")
    copies = F.floor(each * last + F.col("start")) - F.floor(each * (last - 1.0) + F.col("start"))
    return placed.select("row", "doc_id", "size", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return (sample_copies(docs.select("doc_id", "text", "source"))
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken."""
    taken = sample_copies(docs, weights, most).filter(F.col("copies") > 0)
    return (taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
