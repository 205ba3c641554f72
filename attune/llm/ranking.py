"""One ranking of all items from pairwise results: iterative Luce spectral ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attune.functions.names import canonical_name
from attune.operators.ordering import row_index
from attune.storage import cut, maybe_broadcast


def comparisons(df: DataFrame, left: str, right: str, result: str) -> DataFrame:
    """Directed wins (winner, loser, wins) of all valid rows, a tie counting half for each side.

    Rows that are equal in every column are one record. Null or blank names, an item against itself and
    results other than 0 (tie), 1 (left), 2 (right) are left out. The output has at most one row per
    ordered pair of items; partial sums are made before the shuffle, so a hot item costs nothing extra.
    """
    a, b = canonical_name(F.col(left)), canonical_name(F.col(right))
    valid = df.dropDuplicates().select(a.alias("a"), b.alias("b"), F.col(result).alias("r")).where("a <> b AND r IN (0, 1, 2)")
    half = F.when(F.col("r") == 0, 0.5)
    sides = F.array(
        F.struct(F.col("a").alias("winner"), F.col("b").alias("loser"), half.when(F.col("r") == 1, 1.0).otherwise(0.0).alias("w")),
        F.struct(F.col("b").alias("winner"), F.col("a").alias("loser"), half.when(F.col("r") == 2, 1.0).otherwise(0.0).alias("w")),
    )
    return valid.select(F.explode(sides).alias("s")).groupBy("s.winner", "s.loser").agg(F.sum("s.w").alias("wins"))


def _connected(wins: np.ndarray) -> bool:
    """Whether everyone beat everyone along some path, so that maximum-likelihood strengths exist."""
    for m in (wins > 0, wins.T > 0):
        seen = np.zeros(len(m), bool)
        seen[0] = True
        front = seen.copy()
        while front.any():
            front = m[front].any(axis=0) & ~seen
            seen |= front
        if not seen.all():
            return False
    return True


def ilsr(wins: np.ndarray, tol: float = 1e-10, rounds: int = 500) -> np.ndarray:
    """Maximum-likelihood strengths (sum 1) of ``wins[i, j]`` = wins of i over j.

    Each round rebuilds the rates of the chain that moves from a loser to its winner,
    ``wins[i, j] / (s[i] + s[j])``, from the current strengths and solves its stationary distribution.
    """
    n = len(wins)
    s = np.full(n, 1 / n)
    for _ in range(rounds):
        rate = wins.T / (s[:, None] + s[None, :])  # rate[j, i]: from loser j to winner i
        np.fill_diagonal(rate, 0)
        q = rate - np.diag(rate.sum(axis=1))
        a = np.vstack([q.T, np.ones(n)])
        new = np.clip(np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0], 1e-300, None)
        new /= new.sum()
        done = np.abs(np.log(new) - np.log(s)).max() < tol
        s = new
        if done:
            break
    return s


def _reaches_all(edges: DataFrame, source: str, target: str, start: str, n: int) -> bool:
    """Whether every one of ``n`` items can be reached from ``start``; one join a step, the front only."""
    spark = edges.sparkSession
    steps = edges.where("wins > 0").select(F.col(source).alias("item"), F.col(target).alias("next"))
    seen = front = spark.createDataFrame([(start,)], "item STRING")
    while True:
        front = cut(steps.join(front, "item").select(F.col("next").alias("item")).distinct().join(seen, "item", "left_anti"))
        if front.isEmpty():
            return seen.count() == n
        seen = cut(seen.unionByName(front))


def _distributed(edges: DataFrame, items: DataFrame, prior: float, tol: float, rounds: int) -> DataFrame:
    """The same strengths for more items than a driver should solve densely, to the same tolerance.

    Pairs stay distributed. Each round rebuilds the rates from the current strengths and makes one sweep over the
    balance equations (inflow over outflow), which has the same fixed point as solving each chain and costs two
    joins on items and one aggregation with partial sums. The virtual item has strength one, which its own balance
    allows; it is there only if some item is not reached, as in the local form.
    """
    n, start = items.count(), items.agg(F.min("model")).first()[0]
    tied = 0.0 if all(_reaches_all(edges, *way, start, n) for way in (("winner", "loser"), ("loser", "winner"))) else prior / 2
    both = cut(
        edges.groupBy(F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).agg(
            F.sum(F.when(F.col("winner") < F.col("loser"), F.col("wins")).otherwise(0.0)).alias("ab"),
            F.sum(F.when(F.col("winner") > F.col("loser"), F.col("wins")).otherwise(0.0)).alias("ba"),
        )
    )
    s = cut(items.select(F.col("model").alias("item"), F.lit(1.0).alias("s")))
    for _ in range(rounds):
        near = maybe_broadcast(s)
        known = both.join(near.select(F.col("item").alias("a"), F.col("s").alias("sa")), "a").join(near.select(F.col("item").alias("b"), F.col("s").alias("sb")), "b")
        t = F.col("sa") + F.col("sb")
        rows = F.array(
            F.struct(F.col("a").alias("item"), (F.col("ab") * F.col("sb") / t).alias("into"), (F.col("ba") / t).alias("out")),
            F.struct(F.col("b").alias("item"), (F.col("ba") * F.col("sa") / t).alias("into"), (F.col("ab") / t).alias("out")),
        )
        flow = known.select(F.explode(rows).alias("x")).groupBy("x.item").agg(F.sum("x.into").alias("into"), F.sum("x.out").alias("out"))
        own = F.lit(tied) / (F.col("s") + 1.0)
        new = cut(flow.join(s, "item").select("item", ((F.col("into") + own) / (F.col("out") + own)).alias("new"), F.col("s").alias("old")))
        moved = new.select(F.log("new") - F.log("old")).toDF("d").agg(F.min("d"), F.max("d")).first()
        s = new.select("item", F.col("new").alias("s"))
        # without a virtual item only ratios are fixed
        if (max(abs(moved[0]), abs(moved[1])) if tied else moved[1] - moved[0]) < tol:
            break
    total = s.agg(F.sum("s")).first()[0]
    return s.select(F.col("item").alias("model"), (F.col("s") / total).alias("strength"))


def global_ranking(df: DataFrame, left: str = "modela", right: str = "modelb", result: str = "result", max_local: int = 1_000, prior: float = 0.2, tol: float = 1e-10, rounds: int = 500) -> DataFrame:
    """Place, model, strength, comparisons and wins of every item that has a valid comparison.

    Strengths are the exact maximum-likelihood ones. Up to ``max_local`` items the aggregated pair table (at most
    that many squared rows, whatever the size of the input) is solved on the driver, beyond by Spark, by the same
    rules to the same tolerance. Where some items never lost or never won against the rest, no finite maximum
    exists: then each item gets ``prior`` ties with a virtual item, which makes the strengths finite. Equal
    strengths are placed by name. An empty input gives no row.
    """
    spark = df.sparkSession
    edges = cut(comparisons(df, left, right, result))
    played = edges.select(F.explode(F.array(F.struct(F.col("winner").alias("model"), F.col("wins").alias("w"), F.col("wins").alias("n")), F.struct(F.col("loser").alias("model"), F.lit(0.0).alias("w"), F.col("wins").alias("n")))).alias("x")).groupBy("x.model").agg(F.sum("x.n").alias("comparisons"), F.sum("x.w").alias("wins"))
    names = [r[0] for r in played.select("model").limit(max_local + 1).collect()]
    if len(names) > max_local:
        strengths = _distributed(edges, played.select("model"), prior, tol, rounds)
    else:
        names.sort()
        at = {m: i for i, m in enumerate(names)}
        wins = np.zeros((len(names), len(names)))
        for r in edges.collect():  # one row per ordered pair: at most max_local squared
            wins[at[r["winner"]], at[r["loser"]]] = r["wins"]
        if names and not _connected(wins):
            wins = np.pad(wins, (0, 1))
            wins[-1, :-1] = wins[:-1, -1] = prior / 2
        s = ilsr(wins, tol, rounds)[: len(names)] if names else np.zeros(0)
        s = s / s.sum() if len(s) else s
        strengths = spark.createDataFrame([(m, float(v)) for m, v in zip(names, s, strict=True)], "model STRING, strength DOUBLE")
    order: list[Column] = [F.desc("strength"), F.asc("model")]
    placed = row_index(strengths.join(played, "model"), order, "place")
    return placed.select((F.col("place") + 1).cast("int").alias("place"), "model", "strength", "comparisons", "wins")
