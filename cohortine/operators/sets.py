"""Set and multiset operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with different columns; missing cells are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def key_set_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of the intersection and both differences of two key columns, and equality."""
    key = left.columns[0]
    both = left.select(F.col(key).alias("k"), F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(
        right.select(F.col(right.columns[0]).alias("k"), F.lit(False).alias("l"), F.lit(True).alias("r"))
    )
    flags = both.groupBy("k").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    l, r = F.col("l"), F.col("r")
    return flags.agg(
        F.count_if(l & r).alias("n_both"),
        F.count_if(l & ~r).alias("n_left_only"),
        F.count_if(r & ~l).alias("n_right_only"),
        F.coalesce(F.bool_and(l & r), F.lit(True)).alias("equal"),
    )


def multiset_counts(
    guess: DataFrame, truth: DataFrame, item: Sequence[str]
) -> DataFrame:
    """Per item: copies in each table, matched copies and the two remainders.

    Equal items are counted before they meet, so a repeated item is one row however often
    it occurs, and no pairs are formed.
    """
    cols = list(item)
    g = guess.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_guess")).withColumn("n_truth", F.lit(0).cast("bigint"))
    t = truth.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_truth")).withColumn("n_guess", F.lit(0).cast("bigint"))
    both = g.unionByName(t).groupBy(*cols).agg(F.sum("n_guess").alias("n_guess"), F.sum("n_truth").alias("n_truth"))
    tp = F.least("n_guess", "n_truth")
    return both.withColumn("tp", tp).withColumn("fp", F.col("n_guess") - tp).withColumn("fn", F.col("n_truth") - tp)
