"""Rank correlations, tests and their combination, from grouped sums and contingency counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attune.operators.ranks import fractional_rank


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Spearman's rho per group: Pearson's r of mean ranks; null where a side is constant."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = full.withColumns({"_rx": fractional_rank(F.col(x), group), "_ry": fractional_rank(F.col(y), group)})
    g = r.groupBy(*group).agg(F.corr("_rx", "_ry").alias("rho"))
    return g.withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))


def correlation_table(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Pearson's r of every pair of columns (a < b) per group, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.groupBy(*group).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    return one.select(*group, cells.alias("c")).select(*group, "c.*")


def fisher_mean(r: Column) -> Column:
    """Mean correlation through Fisher's z; plus and minus one are left out, 0 if nothing is left."""
    return F.tanh(F.coalesce(F.avg(F.when(F.abs(r) < 1, F.atanh(r))), F.lit(0.0)))


def chi2_survival_even(x: Column, half: Column) -> Column:
    """Survival function of chi-squared with 2 * half degrees of freedom (a finite sum)."""
    h = x / 2
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(half.cast("int") - 1, F.lit(1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, k: F.struct((a["t"] * h / k).alias("t"), (a["s"] + a["t"] * h / k).alias("s")))
    return F.exp(-h) * F.when(half <= 1, 1.0).otherwise(terms["s"])


def fisher_combine(df: DataFrame, group: list[str], p: str) -> DataFrame:
    """Fisher's combined test per group: chi2 (p <= 0 left out), dof (counts all), combined p."""
    g = df.groupBy(*group).agg(F.sum(F.when(F.col(p) > 0, -2 * F.log(p))).alias("chi2"), F.count(p).alias("n"))
    return g.select(*group, "chi2", (2 * F.col("n")).alias("dof"), chi2_survival_even(F.col("chi2"), F.col("n")).alias("p"))


def friedman(df: DataFrame, block: list[str], system: str, score: str) -> DataFrame:
    """Friedman's chi-squared over complete blocks with tie correction: one row (chi2, blocks, systems)."""
    w = Window.partitionBy(*block)
    r = df.withColumn("_r", fractional_rank(F.col(score), block)).withColumn("_k", F.count("*").over(w))
    ties = r.groupBy(*block, score).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    sums = r.groupBy(system).agg(F.sum("_r").alias("s"), F.count("*").alias("n"), F.max("_k").alias("k"))
    one = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"), F.max("k").alias("k")).crossJoin(ties)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    return one.select((raw / (1 - F.col("ties") / (n * k * (k * k - 1)))).alias("chi2"), F.col("n").cast("long").alias("blocks"), F.col("k").cast("long").alias("systems"))


def mean_ranks(df: DataFrame, block: list[str], system: str, score: str) -> DataFrame:
    """Mean rank per system over the blocks, for critical-difference reports."""
    return df.withColumn("_r", fractional_rank(F.col(score), block)).groupBy(system).agg(F.avg("_r").alias("mean_rank"), F.count("*").alias("blocks"))


def range_p(q: Column, groups: Column) -> Column:
    """Upper tail of the studentised range of ``groups`` means with infinite degrees of freedom, in Arrow batches.

    The integral over the smallest of the standard normal values is summed on a fine grid.
    """
    import math

    import numpy as np

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        z = np.linspace(-9.0, 9.0, 4_001)
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        normal = lambda v: np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in v])
        at = normal(z)
        out = []
        for v, n in zip(x, k, strict=True):
            if v is None or v != v:
                out.append(None)
                continue
            inside = (normal(z + v) - at).clip(0.0, 1.0) ** (n - 1)
            out.append(float(min(max(1.0 - n * np.sum(density * inside) * (z[1] - z[0]), 0.0), 1.0)))
        return pd.Series(out, dtype="float64")

    return tail(q, groups)


def nemenyi(df: DataFrame, block: list[str], system: str, score: str) -> DataFrame:
    """Nemenyi's post-hoc p of every pair of systems (a < b) after a Friedman test over complete blocks.

    The statistic is the difference of mean ranks over sqrt(k (k + 1) / (12 n)) for k systems and n blocks.
    """
    m = mean_ranks(df, block, system, score)
    k = m.agg(F.count("*").alias("_k"))
    a, b = (m.select(F.col(system).alias(x), F.col("mean_rank").alias(f"_{x}"), F.col("blocks").alias(f"_n{x}")) for x in "ab")
    j = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(k))  # systems are few, the count is one row
    q = F.abs(F.col("_a") - F.col("_b")) / F.sqrt(F.col("_k") * (F.col("_k") + 1) / (12.0 * F.col("_na")))
    return j.select("a", "b", q.alias("q"), range_p(q, F.col("_k")).alias("p"))


def somers_d(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Somers' D of y given x per group: (concordant - discordant) / pairs untied on x.

    Pairs are counted from the contingency table (x, y), never from pairs of rows: one window per group over
    x gives, for each cell, the rows with smaller x by y. The table of a group is as large as its distinct
    values; round continuous scores first.
    """
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    k = full.groupBy(*group, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n"))
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col("a.x") < F.col("b.x")]
    j = k.alias("a").join(k.alias("b"), on)
    s = j.groupBy(*[F.col(f"a.{g}").alias(g) for g in group]).agg(F.sum(F.signum(F.col("b.y") - F.col("a.y")) * F.col("a.n") * F.col("b.n")).alias("_c"), F.sum(F.col("a.n") * F.col("b.n")).alias("_t"))
    return s.select(*group, F.when(F.col("_t") > 0, F.col("_c") / F.col("_t")).alias("d"))


def permutation_p(df: DataFrame, group: list[str], x: str, y: str, rounds: int = 5_000, seed: int = 42, max_rows: int = 100_000) -> DataFrame:
    """Two-sided p of Pearson's r per group by seeded permutations, or by all of them where there are no more than ``rounds``.

    Groups are items with bounded rows.
    A group of more than ``max_rows`` rows fails the job rather than a worker's memory.
    """
    import itertools
    import math

    import numpy as np

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > max_rows:
            raise ValueError("a group is too large for permutations")
        a, b = g[x].to_numpy(float), g[y].to_numpy(float)
        head = g[group].iloc[:1].reset_index(drop=True)
        if len(g) < 3 or a.std() == 0 or b.std() == 0:
            return head.assign(r=np.nan, p=np.nan)
        a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
        r = float(a @ b / len(a))
        if math.factorial(min(len(a), 20)) <= rounds:
            # few enough orders to take every one
            every = np.array(list(itertools.permutations(b)))
            return head.assign(r=r, p=float((np.abs(every @ a / len(a)) >= abs(r) - 1e-12).mean()))
        rng = np.random.default_rng(seed)
        hits, left = 0, rounds
        while left:
            m = min(left, max(1, 2_000_000 // len(a)))
            hits += int((np.abs(rng.permuted(np.tile(b, (m, 1)), axis=1) @ a / len(a)) >= abs(r) - 1e-12).sum())
            left -= m
        return head.assign(r=r, p=(hits + 1) / (rounds + 1))

    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y).groupBy(*group).applyInPandas(run, f"{kinds}, r DOUBLE, p DOUBLE")


def student_p(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson's r with n pairs, by the incomplete beta function in an Arrow-batched function."""
    import math

    def fraction(a: float, b: float, v: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * v / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * v / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * v / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / (c if abs(c) > tiny else tiny)
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    def beta(a: float, b: float, v: float) -> float:
        if v <= 0 or v >= 1:
            return float(v >= 1)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(v) + b * math.log1p(-v))
        return front * fraction(a, b, v) / a if v < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - v) / b

    @F.pandas_udf("double")
    def p(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or a != a or m < 3 else beta((m - 2) / 2, 0.5, max(0.0, 1 - a * a)) for a, m in zip(x, k, strict=True)], dtype="float64")

    return p(r, n)
