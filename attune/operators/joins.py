"""Joins whose semantics go beyond one equi-join. Sides are broadcast by the planner's own size check only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_first(df: DataFrame, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """The smallest ``value`` per key of the dictionary; null for unknown and null keys. Rows stay one to one."""
    return df.join(dictionary.groupBy(key).agg(F.min(value).alias(value)), key, "left")


def lookup_strict(df: DataFrame, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """Like a left join, but a key that the dictionary lacks fails the job with its value."""
    j = df.join(dictionary.withColumn("_hit", F.lit(True)), key, "left")
    checked = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string"))).cast(dictionary.schema[value].dataType)).otherwise(F.col(value))
    return j.withColumn(value, checked).drop("_hit")


def contained(intervals: Column, start: Column, end: Column) -> Column:
    """Intervals (struct s, e) that lie inside start..end."""
    return F.filter(intervals, lambda t: (t["s"] >= start) & (t["e"] <= end))


def in_every(lists: Column) -> Column:
    """Distinct values that every list of a non-empty list of lists has."""
    return F.aggregate(F.slice(lists, 2, F.size(lists)), F.array_distinct(F.get(lists, 0)), lambda acc, x: F.array_intersect(acc, x))


def with_reversed(forward: DataFrame, reverse: DataFrame, name: str, on: list[str]) -> DataFrame:
    """Rows of a run with those of its reversed run, matched by the name without the suffix."""
    r = reverse.withColumn(name, F.regexp_replace(name, "_reversed$", ""))
    return forward.join(r, [name, *on])
