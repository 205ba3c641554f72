"""Consensus of several annotators' rankings: iteratively reweighted voting."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attune.functions.names import canonical_name
from attune.storage import cut, small


@dataclass
class Consensus:
    """scores: item, label, score, place. annotators: annotator, items, pairs, accuracy, weight. agreement: one row."""

    scores: DataFrame
    annotators: DataFrame
    agreement: DataFrame
    rounds: int
    stable: bool  # whether the weights stood still before the last allowed round


def ratings(df: DataFrame, item: str, annotator: str, ranking: str, low: int, high: int) -> tuple[DataFrame, list[str]]:
    """One row per (item, annotator) with a column r0, r1, ... of ranks per label, and the labels.

    Labels are taken in their usual spelling. Ranks that are null or outside low..high count as missing;
    a key that comes twice is one record (equal copies change nothing, differing ones are averaged). Rows
    without any valid rank, and null keys, are dropped.
    """
    pairs = df.where(F.col(item).isNotNull() & F.col(annotator).isNotNull()).select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), F.explode(ranking).alias("label", "rank"))
    pairs = pairs.where(F.col("rank").between(low, high)).withColumn("label", canonical_name(F.col("label"))).where("label IS NOT NULL")
    labels = sorted(r[0] for r in pairs.select("label").distinct().collect())  # the ranked systems, a few columns each
    each = [F.avg(F.when(F.col("label") == name, F.col("rank").cast("double"))).alias(f"r{k}") for k, name in enumerate(labels)]
    return pairs.groupBy("item", "annotator").agg(*each) if each else pairs.groupBy("item", "annotator").agg(F.count("*").alias("n")), labels


def _agreeing(batches):
    """Per row of (annotator, own scores, the others' scores): label pairs in the same order, and all untied."""
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        own, others = (np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) for c in (1, 2))
        good, pairs = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, j in itertools.combinations(range(own.shape[1]), 2):
            d = np.round((own[:, i] - own[:, j]) * (others[:, i] - others[:, j]), 9)  # missing scores are NaN
            good += d > 0
            pairs += (d > 0) | (d < 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(pairs)], names=["annotator", "good", "pairs"])


def _alpha(rated: DataFrame, k: int) -> DataFrame:
    """Krippendorff's alpha for ranks as interval values: chance-corrected and defined with missing ratings."""
    cells = F.array(*[F.struct(F.lit(i).alias("label"), F.col(f"r{i}").alias("x")) for i in range(k)])
    long = rated.select("item", F.explode(cells).alias("c")).select("item", "c.label", "c.x").where("x IS NOT NULL")
    unit = long.groupBy("item", "label").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).where("n > 1")
    observed = (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") - 1)
    t = unit.agg(F.sum(observed).alias("o"), F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.countDistinct("item").alias("items"))
    expected = (F.col("N") * F.col("Q") - F.col("S") * F.col("S")) / (F.col("N") - 1)
    return t.select(F.when(expected > 0, 1 - F.col("o") / expected).alias("alpha"), F.coalesce("N", F.lit(0)).alias("ratings"), F.coalesce("items", F.lit(0)).alias("items"))


def consensus(df: DataFrame, item: str = "idx", annotator: str = "user_id", ranking: str = "ranking", low: int = 1, high: int = 5, prior: float = 40.0, tol: float = 0.02, rounds: int = 60) -> Consensus:
    """Consensus ranking per item, reliability per annotator and agreement over all.

    Alternates two steps until no weight moves by more than ``tol`` (``stable`` tells whether that came within ``rounds``): (1) an item's score of a label is the
    weighted mean of the annotators' centred ranks; (2) an annotator's accuracy is the share of label pairs
    put in the same order as the consensus of the *other* annotators of that item, smoothed by ``prior``
    pairs at the mean accuracy; its weight is the squared log-odds of that accuracy (a precision), none at or below chance.
    Work per round: two aggregations with partial sums and one join on the item (skew is split by AQE);
    weights are one narrow row per annotator, broadcast only below a checked size.

    Items rated by one annotator follow that annotator; if all weights of an item are zero its annotators
    count alike. Ties in the score go to the label with more first places, then by name. Null rankings give nothing.
    """
    wide, labels = ratings(df, item, annotator, ranking, low, high)
    k = len(labels)
    cols = [f"r{i}" for i in range(k)]
    have = sum((F.col(c).isNotNull().cast("double") for c in cols), F.lit(0.0))
    mean = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0)) / have
    # s: high is good, centred per row; null where missing
    wide = wide.withColumn("m", mean)
    rated = cut(wide.select("item", "annotator", *cols, *[(F.col("m") - F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]))
    everyone = cut(rated.select("annotator").distinct())
    few = small(everyone)  # the same annotators in every round
    weights = everyone.withColumn("w", F.lit(1.0))
    kind = rated.schema["annotator"].dataType.simpleString()
    n = 0

    def weighted(w: DataFrame) -> DataFrame:
        # the floor keeps an item whose annotators all have weight zero decided by them alike
        return rated.join(F.broadcast(w) if few else w, "annotator").withColumn("w", F.greatest("w", F.lit(1e-6)))

    def sums(x: DataFrame) -> DataFrame:
        aggs = [F.sum(F.col("w") * F.col(f"s{i}")).alias(f"t{i}") for i in range(k)] + [F.sum(F.when(F.col(f"s{i}").isNotNull(), F.col("w"))).alias(f"n{i}") for i in range(k)]
        return x.groupBy("item").agg(*aggs, F.count("*").alias("raters"))

    stats, stable = None, not k
    for n in range(1, rounds + 1 if k else 0):
        x = weighted(weights)
        # both sides of the join derive from the checkpointed ratings
        y = x.join(sums(x).where("raters > 1"), "item")
        others = [F.when(F.col(f"n{i}") - F.col("w") > 1e-9, (F.col(f"t{i}") - F.col("w") * F.col(f"s{i}")) / (F.col(f"n{i}") - F.col("w"))) for i in range(k)]
        y = y.select("annotator", *[f"s{i}" for i in range(k)], *[o.alias(f"o{i}") for i, o in enumerate(others)])
        pair = F.array(*[f"s{i}" for i in range(k)]), F.array(*[f"o{i}" for i in range(k)])
        y = y.select("annotator", pair[0].alias("s"), pair[1].alias("o")).mapInArrow(_agreeing, f"annotator {kind}, good BIGINT, pairs BIGINT")
        stats = cut(y.groupBy("annotator").agg(F.sum("good").alias("good"), F.sum("pairs").alias("pairs"), F.count("*").alias("items")))
        total = stats.agg(F.sum("good").alias("g"), F.sum("pairs").alias("p")).first()
        base = (total["g"] or 0) / total["p"] if total["p"] else 0.5
        accuracy = (F.col("good") + prior * base) / (F.col("pairs") + prior)
        # the new weights hang on this round's checkpoint only
        stats = everyone.join(stats, "annotator", "left").select("annotator", "good", "pairs", "items", F.coalesce(accuracy, F.lit(base)).alias("accuracy"))
        stats = stats.withColumn("w", F.when(F.col("accuracy") > 0.5, F.pow(F.coalesce(F.log(F.col("accuracy") / (1 - F.col("accuracy") + 1e-9)), F.lit(0.0)), 2)).otherwise(0.0))
        moved = stats.join(weights.withColumnRenamed("w", "old"), "annotator").agg(F.max(F.abs(F.col("w") - F.col("old")))).first()[0]
        weights = stats.select("annotator", "w")
        if stable := moved is None or moved < tol:
            break
    empty = "annotator", "items", "pairs", "accuracy", "w"
    if stats is None:
        annotators = rated.select("annotator").distinct().select("annotator", F.lit(0).alias("items"), F.lit(0).alias("pairs"), F.lit(None).cast("double").alias("accuracy"), F.lit(1.0).alias("weight"))
    else:
        annotators = stats.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in ("items", "pairs") else F.col(c) for c in empty]).withColumnRenamed("w", "weight")
    x = weighted(weights)
    firsts = [F.sum(F.when(F.col(f"r{i}") == F.array_min(F.array(*cols)), 1).otherwise(0)).alias(f"f{i}") for i in range(k)]
    item_sums = sums(x).join(x.groupBy("item").agg(*firsts), "item") if k else x.groupBy("item").count()
    cells = F.array(*[F.struct(F.lit(name).alias("label"), (F.col(f"t{i}") / F.col(f"n{i}")).alias("score"), F.col(f"f{i}").alias("firsts")) for i, name in enumerate(labels)])
    if not k:
        scores = rated.sparkSession.createDataFrame([], f"item {rated.schema['item'].dataType.simpleString()}, label STRING, score DOUBLE, firsts BIGINT, raters BIGINT, place INT")
    else:
        long = item_sums.select("item", "raters", F.explode(cells).alias("c")).select("item", "c.label", "c.score", "c.firsts", "raters").where("score IS NOT NULL")
        order = Window.partitionBy("item").orderBy(F.round("score", 9).desc(), F.desc("firsts"), F.asc("label"))
        scores = long.withColumn("place", F.row_number().over(order))
    return Consensus(scores, annotators, _alpha(rated, k) if k else rated.sparkSession.createDataFrame([(None, 0, 0)], "alpha DOUBLE, ratings BIGINT, items BIGINT"), n, stable)
