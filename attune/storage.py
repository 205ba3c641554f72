"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may leave it unset and then gets a folder of its own; a cluster
    without the setting is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = f"{spark._jvm.System.getProperty('java.io.tmpdir')}/attune-{sc.applicationId}"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably: later reads survive lost executors and do not recompute."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most rows that a side may have to be broadcast; callers keep rows narrow (ids, weights, counts).
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a materialised ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast behind a size check; beyond the bound the planner shuffles (AQE splits skew)."""
    return F.broadcast(df) if small(df, rows) else df
