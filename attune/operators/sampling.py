"""Reproducible sampling: order by a keyed digest instead of a random generator, so every engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attune.operators.ordering import row_index
from attune.storage import cut, maybe_broadcast


def lot(key: Column, seed: int) -> Column:
    """A pseudo-random string of the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def unit(key: Column, seed: int) -> Column:
    """A pseudo-random number in [0, 1) of the key, from 28 bits."""
    return whole(key, seed) / F.lit(268435456.0)


def whole(key: Column, seed: int) -> Column:
    """A pseudo-random number of 28 bits of the key."""
    return F.conv(F.substring(lot(key, seed), 1, 7), 16, 10).cast("long")


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement (a top-n, no full sort)."""
    return df.orderBy(lot(F.col(key), seed), key).limit(n)


def shuffled(df: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """Position of every row in a shuffle of its group."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*group).orderBy(lot(F.col(key), seed), key)).cast("long"))


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of every stratum."""
    return shuffled(df, strata, key, seed).where(F.col("pos") <= n).drop("pos")


def shares(weights: DataFrame, item: str, weight: str) -> DataFrame:
    """The interval of [0, 1) that belongs to each item, in the order of items: item, _lo, _hi.

    Range partitions are summed in parallel; one sum per partition goes to the driver.
    """
    placed = cut(weights.select(item, F.col(weight).cast("double").alias("_w")).repartitionByRange(item).sortWithinPartitions(item)).withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p").orderBy(item)
    placed = placed.withColumn("_upto", F.sum("_w").over(inside)).withColumn("_before", F.coalesce(F.lag("_upto").over(inside), F.lit(0.0)))
    offsets, total = [], 0.0
    for r in placed.groupBy("_p").agg(F.max("_upto").alias("s")).orderBy("_p").collect():
        offsets.append((r["_p"], total))
        total += r["s"]
    at = F.broadcast(weights.sparkSession.createDataFrame(offsets, "_p INT, _o DOUBLE"))  # a row per partition
    return placed.join(at, "_p").select(item, ((F.col("_o") + F.col("_before")) / (total or 1.0)).alias("_lo"), ((F.col("_o") + F.col("_upto")) / (total or 1.0)).alias("_hi"))


def weighted_draw(df: DataFrame, key: str, weights: DataFrame, item: str, weight: str, seed: int, cells: int = 1024) -> DataFrame:
    """One item per row, drawn by weight: the item whose interval holds the row's number.

    Intervals are cut at ``cells`` borders, so drawing is an equi-join on the cell, broadcast only below a checked
    size; an item of great weight is in many cells, rows are dealt evenly over them. Items without weight are never drawn.
    """
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("int")
    parts = shares(weights, item, weight).where("_hi > _lo")
    parts = parts.select(item, "_lo", "_hi", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))).alias("_c"))
    drawn = df.select(key, unit(F.col(key), seed).alias("_u")).withColumn("_c", cell(F.col("_u")))
    return drawn.join(maybe_broadcast(parts), "_c").where("_lo <= _u AND _u < _hi").select(key, item)


def choice(items: Column, key: Column, seed: int) -> Column:
    """One element of a list by the key; the empty string for null and empty lists and null elements."""
    picked = F.when(F.size(items) > 0, F.get(items, (whole(key, seed) % F.size(items)).cast("int")))
    return F.coalesce(picked, F.lit(""))


def restore_percent(df: DataFrame, key: str, percent: int, seed: int) -> DataFrame:
    """Mark n * (100 - percent) // 100 rows as original, the others as perturbed."""
    n = df.count()
    placed = row_index(df.withColumn("_lot", lot(F.col(key), seed)), [F.col("_lot"), F.col(key)], "_i")
    return placed.withColumn("version", F.when(F.col("_i") < n * (100 - percent) // 100, "original").otherwise("perturbed")).drop("_lot", "_i")


def restore_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Mark the rows whose key is listed as original."""
    return df.join(ids.withColumn("_in", F.lit(True)), key, "left").withColumn("version", F.when(F.col("_in"), "original").otherwise("perturbed")).drop("_in")


def chunks(df: DataFrame, key: str, n: int) -> DataFrame:
    """Number of the equal chunk (0 to n - 1) of every row by key order, n for the remainder."""
    size = max(df.count() // n, 1)
    return row_index(df, [F.col(key)], "_i").withColumn("chunk", F.least(F.floor(F.col("_i") / size), F.lit(n)).cast("long")).drop("_i")
