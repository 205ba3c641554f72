"""Positions over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attune.storage import cut

_LOW = (1 << 33) - 1


def row_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """0-based position of every row in ``order`` (give a total order).

    Range partitions are sorted in parallel and cut from their lineage; only one count per partition goes
    to the driver, and each row adds its partition's offset to its place inside the partition.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = placed.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    counts = {r["_p"]: r["n"] for r in at.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    table = df.sparkSession.createDataFrame(offsets, "_p BIGINT, _o BIGINT")
    joined = at.join(F.broadcast(table), "_p")
    return joined.withColumn(name, F.col("_m").bitwiseAND(F.lit(_LOW)) + F.col("_o")).drop("_m", "_p", "_o")
