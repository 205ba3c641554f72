"""SparkSession factory used by the tests and the bench; a driver may bring its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every plan in this library is written for. They are sizes and modes, not cluster addresses.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the library's defaults; ``extra`` overrides single settings."""
    conf = DEFAULTS | {"spark.master": master, "spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    return SparkSession.builder.appName("attune").config(map=conf).getOrCreate()
