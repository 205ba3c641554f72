"""Ranks of systems per item and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, item: list[str], score: str, label: str) -> DataFrame:
    """Adds dense, competition, fractional and ordinal ranks of ``score`` (high is first) per item.

    Ties share the first three; ordinal ranks break them by label. Null scores come last.
    """
    w = Window.partitionBy(*item).orderBy(F.desc_nulls_last(score))
    tied = Window.partitionBy(*item, score)
    return df.withColumns(
        {
            "rank_dense": F.dense_rank().over(w),
            "rank_competition": F.rank().over(w),
            "rank_fractional": F.rank().over(w) + (F.count("*").over(tied) - 1) / F.lit(2.0),
            "rank_ordinal": F.row_number().over(Window.partitionBy(*item).orderBy(F.desc_nulls_last(score), F.asc(label))),
        }
    )


def name_order_rank(df: DataFrame, item: list[str], score: str, label: str, start: int = 1) -> DataFrame:
    """The legacy rank: labels in name order, one up at every change of score from one name to the next."""
    w = Window.partitionBy(*item).orderBy(F.asc(label), F.asc(score))
    step = F.when(F.col(score) != F.lag(score).over(w), 1).otherwise(0)
    return df.withColumn("_s", step).withColumn("rank_name_order", (F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) + start).cast("int")).drop("_s")


def points(df: DataFrame, item: list[str], label: str, rank: str, worth: int, size: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Sum of ``worth - rank`` per label (and ``by``); items without exactly ``size`` ranks are skipped."""
    if size:
        whole = df.groupBy(*item).agg(F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")
        df = df.join(whole, item, "left_semi")
    return df.groupBy(*(by or []), label).agg(F.sum(worth - F.col(rank)).cast("long").alias("points"))


def borda(df: DataFrame, item: str, label: str, rank: str, worth: int = 6) -> DataFrame:
    """Items' labels by summed ``worth - rank``: score and dense place."""
    s = df.groupBy(item, label).agg(F.sum(worth - F.col(rank)).cast("long").alias("score"))
    return s.withColumn("place", F.dense_rank().over(Window.partitionBy(item).orderBy(F.desc("score"))))


def bracket_merge(first: DataFrame, final: DataFrame) -> DataFrame:
    """Ranks after a final round: the finalist's new rank holds for all models of its triplet with its old rank.

    ``first``: idx, triplet, model, rank; ``final``: idx, triplet, rank (old), new_rank; one finalist a triplet.
    """
    return first.join(final, ["idx", "triplet", "rank"], "left").select("idx", "triplet", "model", F.coalesce("new_rank", "rank").alias("rank"))


def weighted_order(df: DataFrame, key: str, terms: dict[str, float], n: int) -> DataFrame:
    """The n best rows by a weighted sum of metrics (negative weights for those to be small); ties by key."""
    total = sum((F.col(c) * F.lit(float(w)) for c, w in terms.items()), F.lit(0.0))
    return df.withColumn("objective", total).orderBy(F.desc_nulls_last("objective"), key).limit(n)


def fractional_rank(value: Column, group: list[str], ascending: bool = False) -> Column:
    """Mean rank of a tie group as a column; the order key is the value itself."""
    w = Window.partitionBy(*group).orderBy(value.asc_nulls_last() if ascending else value.desc_nulls_last())
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / F.lit(2.0)
