"""Set operations by key, with an explicit order wherever one row of several is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key in ascending ``order``; give a total order. Null keys form one key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_by_digest(df: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """Exact text de-duplication by MD5: the first row per digest in ``order``; null texts are dropped.

    The window's group limit runs before the shuffle, so a text that fills a third of the table costs no more.
    """
    w = Window.partitionBy("digest").orderBy(*order)
    hashed = df.where(F.col(text).isNotNull()).withColumn("digest", F.md5(F.col(text)))
    return hashed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def minus(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; repeated rows stay repeated."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")
