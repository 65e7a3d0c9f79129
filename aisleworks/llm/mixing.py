"""Mixing sources to target weights by hash-random keys, distributed prefix sums and an exact cut. DataFrame operations only.

Method: every document gets a random-looking key from a hash of its id. A source's key range is cut into equal
ranges; a window over the ranges' token sums and a window inside each range together give the tokens before every
document. A source's budget is taken in that order, whole epochs first and the rest from the start of the order,
where the document at the cut gives just the words still missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.llm.common import WORD_PATTERN, written

#: Documents that one range of a source's keys should hold, and the bounds of the number of ranges (powers of two).
RANGE_ROWS, LEAST_BITS, MOST_BITS = 512, 6, 20


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    """Per source: ``source, source_size, target, budget``.

    Sources share the whole size by weight; none gets more than ``most_repeats`` times its own. With sources in
    order of their cap per weight, the capped ones are those before the first whose share of what they leave is
    within its cap. One row per source passes through a single task here, never documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    rated = totals.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place).alias("weight"),
        (F.col("source_size") * most_repeats).alias("most"),
    ).withColumn("level", F.col("most") / F.col("weight"))
    every = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    left_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = rated.withColumn("share", left / left_weight)
    rate = F.first(F.when(F.col("share") <= F.col("level"), F.col("share")), ignorenulls=True).over(whole)
    return (
        shared.withColumn("rate", rate)
        .withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "target", F.round("target").cast("long").alias("budget"))
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most_repeats: int = 3,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Per row: ``doc_id, size, source_size, target, taken``.

    ``size`` is the number of words, ``taken`` the words the mix takes of the row, repeats counted, at most
    ``most_repeats`` times its size. A null text has size 0 and gives nothing; null sources are one source, last in
    order; rows with a null id or equal ids each count, and rows equal in id, source and size are interchangeable.
    A source of size 0 has target 0. An empty table gives no row. Other columns are not read. Reruns agree.
    """
    sizes = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size")
    ).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    sizes = written(sizes, "mix-sizes")
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(sizes.count(), 1) / RANGE_ROWS))))
    ranged = sizes.withColumn("range", F.shiftrightunsigned("key", 64 - bits))

    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("range_before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    )
    targets = source_targets(sizes, weights, most_repeats)
    ranges = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        F.col("r.source").alias("of_source"), F.col("range").alias("of_range"), "range_before", "source_size", "target", "budget"
    )
    inside = Window.partitionBy("source", "range").orderBy(F.shiftleft("key", bits), "key", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    ordered = ranged.withColumn("inside_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(ranges, ordered["source"].eqNullSafe(ranges["of_source"]) & (F.col("range") == F.col("of_range")))
    whole = F.col("source_size") > 0
    epochs = F.when(whole, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("range_before") - F.col("inside_before")))
    return joined.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + partial).cast("long").alias("taken")
    )
