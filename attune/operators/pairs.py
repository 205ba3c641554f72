"""Pairs of systems: building them, counting wins, win fractions, majority votes and Elo ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attune.storage import maybe_broadcast


def self_pairs(df: DataFrame, item: str, label: str, values: list[str]) -> DataFrame:
    """All unordered pairs of labels per item, ``values`` once per side with suffix _a and _b."""
    a = df.select(item, F.col(label).alias("a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = df.select(item, F.col(label).alias("b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, item).where("a < b")


def compare3(a: Column, b: Column) -> Column:
    """1 if a is larger, 2 if b is, 0 if equal; null where either is null or NaN."""
    bad = a.isNull() | b.isNull() | F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(bad, None).when(a > b, 1).when(a < b, 2).otherwise(0)


def directed(battles: DataFrame) -> DataFrame:
    """Every battle (a, b, result) seen from both sides: model, opponent, win (1, 0; 0.5 for a tie), tie."""
    win = lambda side: F.when(F.col("result") == side, 1.0).when(F.col("result") == 0, 0.5).otherwise(0.0)
    sides = F.array(
        F.struct(F.col("a").alias("model"), F.col("b").alias("opponent"), win(1).alias("win")),
        F.struct(F.col("b").alias("model"), F.col("a").alias("opponent"), win(2).alias("win")),
    )
    return battles.select(F.explode(sides).alias("s"), (F.col("result") == 0).alias("tie")).select("s.*", "tie")


def wins(battles: DataFrame) -> DataFrame:
    """Wins and battles per model; a tie adds nothing, every model that took part appears."""
    return directed(battles).groupBy("model").agg(F.sum((F.col("win") == 1.0).cast("long")).alias("wins"), F.count("*").alias("battles"))


def win_fraction(battles: DataFrame) -> DataFrame:
    """Share of decided battles won per ordered pair that met; null where all were ties."""
    g = directed(battles).groupBy("model", "opponent")
    won, lost = (F.sum(F.when(F.col("win") == v, 1.0).otherwise(0.0)) for v in (1.0, 0.0))
    return g.agg(won.alias("won"), lost.alias("lost")).select("model", "opponent", F.when(F.col("won") + F.col("lost") > 0, F.col("won") / (F.col("won") + F.col("lost"))).alias("fraction"))


def average_win_rate(battles: DataFrame) -> DataFrame:
    """Mean of a model's win fractions over its opponents."""
    return win_fraction(battles).groupBy("model").agg(F.avg("fraction").alias("rate"))


def majority(votes: DataFrame, item: list[str], vote: str) -> DataFrame:
    """Most frequent vote per item; 0 when no vote has a count of two or the top is tied."""
    counts = votes.groupBy(*item, vote).agg(F.count("*").alias("n"))
    top = counts.groupBy(*item).agg(F.max("n").alias("top"), F.max_by(vote, "n").alias("v"), F.max(F.struct("n", vote)).alias("hi"), F.max(F.struct(F.col("n"), (-F.col(vote)).alias("m"))).alias("lo"))
    one = F.col(f"hi.{vote}") == -F.col("lo.m")
    return top.select(*item, F.when((F.col("top") > 1) & one, F.col(f"hi.{vote}")).otherwise(0).alias("majority"))


def elo(battles: DataFrame, group: list[str], order: list[str], k: float = 4.0, scale: float = 400.0, base: float = 10.0, start: float = 1000.0) -> DataFrame:
    """Ratings after folding each group's battles in order: group, model, rating. No group gives one history.

    The fold is sequential by definition: a group is one task. It is sorted there by Spark (spilling to disk) and
    streams through in Arrow batches; only the ratings of the group at hand are carried along, so a group of
    any length fits. Equal places in ``order`` go by names and result.
    """
    cols = [*group, "a", "b", "result"]
    kinds = "".join(f"`{g}` {battles.schema[g].dataType.simpleString()}, " for g in group)
    rows = battles.repartition(*group) if group else battles.coalesce(1)
    rows = rows.sortWithinPartitions(*group, *order, "a", "b", "result").select(*cols)

    def run(batches):
        import pyarrow as pa

        n = len(group)
        schema = None
        now, r = None, {}

        def finish():
            return pa.RecordBatch.from_arrays([*(pa.array([v] * len(r), t) for v, t in zip(now, schema, strict=True)), pa.array(list(r), pa.string()), pa.array(list(r.values()), pa.float64())], names=[*group, "model", "rating"])

        for batch in batches:
            schema = [batch.schema.field(i).type for i in range(n)]
            for *key, a, b, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if r:
                        yield finish()
                    now, r = key, {}
                x, y = r.get(a, start), r.get(b, start)
                e = 1.0 / (1.0 + base ** ((y - x) / scale))
                s = 1.0 if z == 1 else 0.0 if z == 2 else 0.5
                r[a], r[b] = x + k * (s - e), y + k * (e - s)
        if r:
            yield finish()

    return rows.mapInArrow(run, f"{kinds}model STRING, rating DOUBLE")


def elo_bootstrap(battles: DataFrame, rounds: int = 1_000, seed: int = 42, k: float = 4.0, together: int = 25) -> DataFrame:
    """Median and 2.5 / 97.5 % quantiles of Elo ratings over resamples with replacement.

    A battle is told apart only by its models and result, so drawing battles with replacement is drawing from the
    counts of (a, b, result): that table, as small as the models are few, is all that travels, whatever the
    number of battles. ``together`` rounds run in one task, each step for all of them at once.
    """
    import numpy as np

    spark = battles.sparkSession
    kinds = sorted((r["a"], r["b"], r["result"], r["n"]) for r in battles.groupBy("a", "b", "result").agg(F.count("*").alias("n")).collect())
    names = sorted({x for a, b, _, _ in kinds for x in (a, b)})
    at = {m: i for i, m in enumerate(names)}
    left, right = (np.array([at[x[i]] for x in kinds], np.int64) for i in (0, 1))
    won = np.array([1.0 if x[2] == 1 else 0.0 if x[2] == 2 else 0.5 for x in kinds])
    upto = np.cumsum([x[3] for x in kinds], dtype=np.int64) if kinds else np.zeros(1, np.int64)
    data = spark.sparkContext.broadcast((names, left, right, won, upto))

    def run(batches):
        import pandas as pd

        labels, a, b, w, ends = data.value
        for batch in batches:
            for block in batch["id"]:
                n = min(together, rounds - block * together)
                rng = np.random.default_rng([seed, int(block)])
                r = np.full((n, len(labels)), 1000.0)
                row = np.arange(n)
                for begin in range(0, int(ends[-1]), 4_096):
                    drawn = np.searchsorted(ends, rng.integers(0, ends[-1], (min(4_096, int(ends[-1]) - begin), n)), "right")
                    for t in drawn:
                        i, j = a[t], b[t]
                        x, y = r[row, i], r[row, j]
                        d = k * (w[t] - 1 / (1 + 10 ** ((y - x) / 400)))
                        r[row, i] = x + d
                        r[row, j] = y - d
                yield pd.DataFrame({"round": np.repeat(block * together + row, len(labels)), "model": labels * n, "rating": r.ravel()})

    blocks = -(-rounds // together)
    each = spark.range(0, blocks, 1, blocks).mapInPandas(run, "round BIGINT, model STRING, rating DOUBLE")
    q = lambda p: F.percentile("rating", F.lit(p))
    return each.groupBy("model").agg(F.floor(q(0.5) + 0.5).alias("median"), q(0.025).alias("lower"), q(0.975).alias("upper"))


def debias(forward: Column, backward: Column) -> Column:
    """Scores of two runs with swapped answers: the mean of the forward pair and the backward one turned round."""
    return F.zip_with(forward, F.reverse(backward), lambda x, y: (x + y) / 2)


def ordered_pairs(weights: DataFrame, model: str, weight: str) -> DataFrame:
    """Ordered pairs of different models with the share of their weight product."""
    a = weights.select(F.col(model).alias("a"), F.col(weight).alias("wa"))
    b = maybe_broadcast(weights.select(F.col(model).alias("b"), F.col(weight).alias("wb")))
    p = a.join(b, F.col("a") != F.col("b")).withColumn("p", F.col("wa") * F.col("wb"))
    return p.select("a", "b", (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("share"))
