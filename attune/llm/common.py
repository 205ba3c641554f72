"""Small helpers shared by the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Enough partitions for a Python stage: input with fewer splits than cores need is dealt out evenly.

    Large inputs have far more splits than that and pass unchanged, without a shuffle.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 2 else df
