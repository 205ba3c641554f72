"""Quality of predictions and agreement of annotators, from contingency counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy(p: Column) -> Column:
    """Binary entropy in nats."""
    return -(p * F.log(p + 1e-9) + (1 - p) * F.log(1 - p + 1e-9))


def logloss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    """Log loss of one prediction, clipped."""
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(c) + (1 - y) * F.log(1 - c))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information in nats of two discrete columns; only the contingency table leaves the first stage."""
    k = df.groupBy(x, y).agg(F.count("*").cast("double").alias("n"))
    kx, ky = (k.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in (x, y))
    t = k.agg(F.sum("n").alias("t"))
    j = k.join(kx, x).join(ky, y).crossJoin(F.broadcast(t))
    return j.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col(f"n_{x}") * F.col(f"n_{y}")))).alias("mi"))


def fleiss(df: DataFrame, subject: list[str], label: str, raters: int) -> DataFrame:
    """Fleiss' kappa; every subject must have the same number of ratings."""
    k = df.groupBy(*subject, label).agg(F.count("*").cast("double").alias("c"))
    p = k.groupBy(*subject).agg(((F.sum(F.col("c") * F.col("c")) - raters) / (raters * (raters - 1))).alias("p")).agg(F.avg("p").alias("po"))
    share = k.groupBy(label).agg(F.sum("c").alias("c")).agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("pe"))
    return p.crossJoin(share).select(((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def cohen(df: DataFrame, subject: list[str], rater: str, label: str) -> DataFrame:
    """Cohen's kappa of every pair of raters (a < b) over the subjects both rated; null if chance is certain.

    The pairs of one subject's raters meet in a join on the subject, then only counts per (a, b, label, label).
    """
    side = lambda r, v: df.select(*subject, F.col(rater).alias(r), F.col(label).alias(v))
    k = side("a", "x").join(side("b", "y"), subject).where("a < b").groupBy("a", "b", "x", "y").agg(F.count("*").cast("double").alias("n"))
    po = k.groupBy("a", "b").agg((F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0.0)) / F.sum("n")).alias("po"), F.sum("n").alias("t"))
    px, py = (k.groupBy("a", "b", F.col(c).alias("v")).agg(F.sum("n").alias(f"n{c}")) for c in "xy")
    pe = px.join(py, ["a", "b", "v"]).groupBy("a", "b").agg(F.sum(F.col("nx") * F.col("ny")).alias("s"))
    j = po.join(pe, ["a", "b"], "left").withColumn("pe", F.coalesce(F.col("s"), F.lit(0.0)) / (F.col("t") * F.col("t")))
    return j.select("a", "b", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))
