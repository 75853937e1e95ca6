"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored(score: Column) -> Column:
    """A score from 0 to 1; null and NaN are none (NaN sorts above every number)."""
    return score.between(0, 1)


def top_n(items: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """(group, ident, rank_no) of the n best items of each group, by score from high to low, equal scores by ident from low to high.

    Rows without group, score or ident are left out, NaN scores too; repeated rows of an item count once. dense_rank with a
    rank filter lets the optimiser prune each group inside every input partition and again after the one shuffle, repeats
    being harmless to it; row_number then ranks the few that are left, on the same partitioning. A group of millions of items
    sends at most n distinct ones from each task. Fewer than n items give fewer rows; empty input gives none.
    """
    clean = items.select(F.col(group).alias("g"), F.col(score).alias("s"), F.col(ident).alias("i")).filter("g is not null and i is not null and s is not null and not isnan(s)")
    order = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i"))
    few = clean.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= n).select("g", "s", "i").distinct()
    return few.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= n).select(F.col("g").alias(group), F.col("i").alias(ident), "rank_no")
