"""Group summaries; all in one aggregation with partial sums unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_std(df: DataFrame, group: list[str], columns: dict[str, str]) -> DataFrame:
    """Mean and sample standard deviation of each named column."""
    return df.groupBy(*group).agg(*[x for n, c in columns.items() for x in (F.avg(c).alias(f"mean_{n}"), F.stddev_samp(c).alias(f"std_{n}"))])


def distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, upper median, population std, quartiles, their range, and extremes. Nulls are ignored.

    Quantiles are exact: rows are first counted per distinct value (partial sums before the shuffle), then a
    running count, which sorts with spilling and keeps no group in memory, finds the values at the ranks that
    each quantile interpolates between.
    """
    base = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("high"), F.min(value).alias("low"), F.count(value).alias("_n"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group).orderBy(value)
    sized = counts.withColumns({"_u": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(*group))})
    at = lambda rank: F.min(F.when(F.col("_u") > rank, F.col(value)))
    n = F.col("_n")
    ranks = {"_m": F.floor(n / 2)}
    for q, p in (("p25", 0.25), ("p75", 0.75)):
        ranks |= {f"_{q}l": F.floor((n - 1) * p), f"_{q}h": F.ceil((n - 1) * p)}
    g = sized.groupBy(*group, "_n").agg(*[at(r).alias(k) for k, r in ranks.items()])
    part = lambda q, p: F.col(f"_{q}l") + (F.col(f"_{q}h") - F.col(f"_{q}l")) * ((n - 1) * p - F.floor((n - 1) * p))
    g = g.select(*group, F.col("_m").alias("upper_median"), part("p25", 0.25).alias("p25"), part("p75", 0.75).alias("p75"))
    out = base.drop("_n").join(g, group, "left").withColumn("iqr", F.col("p75") - F.col("p25"))
    return out.select(*group, "mean", "upper_median", "std", "iqr", "p25", "p75", "high", "low")


def count_columns(df: DataFrame, group: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Rows of each listed kind as a column."""
    return df.groupBy(*group).agg(*[F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in kinds])


def daily_counts(df: DataFrame, ts: str, zone: str) -> DataFrame:
    """Rows per calendar day of a time zone; timestamps are UTC."""
    return df.groupBy(F.date_format(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def hour_buckets(df: DataFrame, ts: str, hours: int = 24) -> DataFrame:
    """Rows in each hour of the last day, counted from the first row of that day; empty hours are 0."""
    spark = df.sparkSession
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    x = df.select(seconds.alias("t"))
    last = x.agg(F.max("t").alias("hi"))
    day = x.join(F.broadcast(last)).where(F.col("t") > F.col("hi") - 86_400)
    base = day.agg(F.min("t").alias("base"))
    n = day.join(F.broadcast(base)).groupBy(F.floor((F.col("t") - F.col("base")) / 3600).alias("hour")).agg(F.count("*").alias("n"))
    return spark.range(hours).withColumnRenamed("id", "hour").join(F.broadcast(n), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def nested_topk(df: DataFrame, outer: str, inner: str, k: int) -> DataFrame:
    """The k most frequent inner values of every outer one; ties by value."""
    n = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    w = Window.partitionBy(outer).orderBy(F.desc("n"), F.asc(inner))
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def drop_all_null(df: DataFrame) -> DataFrame:
    """``df`` without the columns that are null in every row; one pass of counts decides."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])
