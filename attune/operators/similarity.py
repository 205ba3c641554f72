"""Text and vector similarity, retrieval by cosine, and n-gram scores."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attune.storage import maybe_broadcast


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; null for null or zero vectors."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def scaled(cos: Column) -> Column:
    """A cosine as similarity from 0 to 1."""
    return (1 + cos) / 2


def mean_pool(tokens: Column, mask: Column, dim: int) -> Column:
    """Mean of the unmasked token vectors, of unit length; null if all are masked."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["t"])
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dim), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    n = norm(total)
    return F.when((F.size(kept) > 0) & (n > 0), F.transform(total, lambda x: x / n))


def bertscore(candidate: Column, reference: Column) -> Column:
    """Greedy token matching on given token vectors: struct of precision, recall and f1; null without tokens.

    Each token takes its best match on the other side; a model supplies the vectors. Row-local.
    """
    side = lambda xs, ys: F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: cosine(x, y))))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)
    some = (F.size(candidate) > 0) & (F.size(reference) > 0)
    p, r = F.when(some, mean(side(candidate, reference))), F.when(some, mean(side(reference, candidate)))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r != 0, 2 * p * r / (p + r)).alias("f1"))


def pairwise_summary(df: DataFrame, group: str, key: str, vector: str, block: int = 2_000) -> DataFrame:
    """Mean, population deviation, least and largest cosine over all pairs inside each group.

    Pairs are never rows: a group is dealt into blocks by key, each pair of blocks is one bounded task that
    multiplies two matrices and gives five sums, so a hot group becomes many tasks. Null and zero vectors are
    left out, as are rows without a group and groups with fewer than two vectors.
    """
    kind = df.schema[group].dataType.simpleString()
    usable = df.where(F.col(vector).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    size = usable.groupBy("_g").agg(F.ceil(F.count("*") / block).cast("int").alias("_b"))
    dealt = usable.join(size, "_g").select("_g", "_v", "_b", F.pmod(F.xxhash64("_k"), F.col("_b")).cast("int").alias("_i"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_j")
    cells = dealt.select("_g", "_v", "_i", other).select("_g", "_v", F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"), (F.col("_i") <= F.col("_j")).alias("_first"))

    def run(key_: tuple, g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        def unit(v: pd.Series) -> np.ndarray:
            x = np.array(v.tolist(), float).reshape(len(v), -1)
            n = np.linalg.norm(x, axis=1)
            return x[n > 0] / n[n > 0, None]

        _, lo, hi = key_
        if lo == hi:
            x = unit(g["_v"])
            c = (x @ x.T)[np.triu_indices(len(x), 1)]
        else:
            c = (unit(g.loc[g["_first"], "_v"]) @ unit(g.loc[~g["_first"], "_v"]).T).ravel()
        if not len(c):
            return pd.DataFrame({"_g": [key_[0]], "n": [0], "s": [0.0], "q": [0.0], "lo": [0.0], "hi": [0.0]})
        return pd.DataFrame({"_g": [key_[0]], "n": [len(c)], "s": [c.sum()], "q": [(c * c).sum()], "lo": [c.min()], "hi": [c.max()]})

    sums = cells.groupBy("_g", "_lo", "_hi").applyInPandas(run, f"_g {kind}, n BIGINT, s DOUBLE, q DOUBLE, lo DOUBLE, hi DOUBLE")
    t = sums.where("n > 0").groupBy(F.col("_g").alias(group)).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"), F.min("lo").alias("low"), F.max("hi").alias("high"))
    mean = F.col("_s") / F.col("_n")
    return t.select(group, mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("std"), "low", "high")


def topk(queries: DataFrame, corpus: DataFrame, key: str, vector: str, text: str, n: int, slack: int = 3, label: str | None = None, strict: bool = False) -> DataFrame:
    """The n nearest corpus rows of each query by cosine: query key, key, cosine, place.

    Only rows of the query's label if one is named. The legacy rule keeps n + slack rows and then drops those
    with the query's own text, so it may give fewer than n; ``strict`` drops them first. Ties by key. Queries
    are a stated set: they are broadcast below a checked size; each task keeps the best of its rows only
    (window group limit) before the shuffle by query.
    """
    q = maybe_broadcast(queries.select(F.col(key).alias("query"), F.col(vector).alias("_qv"), F.col(text).alias("_qt"), *([F.col(label).alias("_ql")] if label else [])), 20_000)
    c = corpus.select(key, F.col(vector).alias("_v"), F.col(text).alias("_t"), *([F.col(label).alias("_l")] if label else []))
    j = c.join(q, F.col("_ql") == F.col("_l")) if label else c.crossJoin(q)
    other = ~F.col("_t").eqNullSafe(F.col("_qt"))
    s = j.where(other) if strict else j
    s = s.select("query", key, "_t", "_qt", F.round(cosine(F.col("_v"), F.col("_qv")), 9).alias("cosine")).where("cosine IS NOT NULL")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), F.asc(key))
    s = s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= (n if strict else n + slack))
    if not strict:
        s = s.where(other).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return s.select("query", key, "cosine", F.col("_r").alias("place"))


def tokens(c: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams joined by a blank; empty if there are too few words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def overlaps(a: Column, b: Column, order: int) -> Column:
    """Clipped n-gram overlap of two texts for n = 1 to ``order``: an array of [n-grams of a, of b, in both].

    Counted inside the row, in Arrow batches, so no n-gram is ever shuffled. Null texts have no n-grams.
    """

    @F.pandas_udf("array<array<bigint>>")
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = (() if w is None else list(w) for w in (p, q))
            row = []
            for n in range(1, order + 1):
                g, h = (Counter(zip(*(w[i:] for i in range(n)), strict=False)) for w in (p, q))
                row.append([g.total(), h.total(), (g & h).total()])
            out.append(row)
        return pd.Series(out)

    return count(tokens(a), tokens(b))


def rouge(df: DataFrame, key: list[str], reference: str, candidate: str, orders: tuple[int, ...]) -> DataFrame:
    """ROUGE-n F measures as rouge1, rouge2, ... of every row in which either text has a word; 0 without overlap."""
    o = df.select(*key, overlaps(F.col(reference), F.col(candidate), max(orders)).alias("_o")).where("_o[0][0] + _o[0][1] > 0")

    def f(n: int) -> Column:
        both = F.col("_o")[n - 1][2]
        r, p = both / F.col("_o")[n - 1][0], both / F.col("_o")[n - 1][1]
        return F.when(both > 0, 2 * r * p / (r + p)).otherwise(0.0).alias(f"rouge{n}")

    return o.select(*key, *map(f, orders))


def rouge_n(df: DataFrame, key: list[str], reference: str, candidate: str, n: int) -> DataFrame:
    """ROUGE-n F measure; 0 without overlap."""
    return rouge(df, key, reference, candidate, (n,))


def rouge_l(reference: Column, candidate: Column) -> Column:
    """ROUGE-L F measure of two texts; 0 without a common word or for null and empty texts.

    A data-dependent table per row is what Catalyst cannot express well, so the length of the longest common
    subsequence is found in an Arrow-batched function, bit-parallel: one big-integer step per word.
    """
    def length(a: list[str], b: list[str]) -> int:
        masks: dict[str, int] = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        full = (1 << len(a)) - 1
        v = full
        for w in b:
            u = v & masks.get(w, 0)
            v = ((v + u) | (v - u)) & full
        return len(a) - v.bit_count()

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            if a is None or b is None or not len(a) or not len(b):
                out.append(0.0)
                continue
            n = length(list(a), list(b))
            out.append(2 * n / (len(a) + len(b)))
        return pd.Series(out)

    return score(tokens(reference), tokens(candidate))


def bleu(df: DataFrame, key: list[str], reference: str, candidate: str, order: int = 4, eps: float = 0.1) -> DataFrame:
    """Sentence BLEU with the counts of empty matches smoothed to ``eps``; 0 for empty candidates.

    Orders for which the candidate has no n-gram are left out of the mean. Row-local, no shuffle.
    """
    out = df.select(*key, overlaps(F.col(reference), F.col(candidate), order).alias("_o"))
    logs, used = F.lit(0.0), F.lit(0.0)
    for n in range(order):
        m, b = F.col("_o")[n][1], F.col("_o")[n][2]
        logs = logs + F.when(m > 0, F.log(F.when(b > 0, b.cast("double")).otherwise(eps) / m)).otherwise(0.0)
        used = used + F.when(m > 0, 1.0).otherwise(0.0)
    r, c = F.col("_o")[0][0], F.col("_o")[0][1]
    penalty = F.when(c >= r, 1.0).otherwise(F.exp(1 - r / c))
    return out.select(*key, F.when(F.col("_o")[0][2] > 0, penalty * F.exp(logs / used)).otherwise(0.0).alias("bleu"))


def self_bleu(df: DataFrame, group: list[str], key: str, text: str, order: int = 2, eps: float = 0.1) -> DataFrame:
    """Each text against all others of its group: clipped by the largest count among the others.

    No pair of texts is built: per (group, n-gram) the two largest counts suffice, since the largest among
    the others is the top one or, for its owner, the second.
    """
    out = None
    for n in range(1, order + 1):
        g = df.select(*group, key, F.explode(ngrams(tokens(F.col(text)), n)).alias("_g")).groupBy(*group, key, "_g").agg(F.count("*").alias("_c"))
        top = g.groupBy(*group, "_g").agg(F.max("_c").alias("_m1"), F.sum((F.lit(1))).alias("_n"), F.max(F.struct("_c", key)).alias("_hi"))
        rest = g.join(top.select(*group, "_g", F.col(f"_hi.{key}").alias("_o")), [*group, "_g"]).where(F.col(key) != F.col("_o")).groupBy(*group, "_g").agg(F.max("_c").alias("_m2"))
        j = g.join(top, [*group, "_g"]).join(rest, [*group, "_g"], "left")
        others = F.when(F.col(key) == F.col(f"_hi.{key}"), F.coalesce("_m2", F.lit(0))).otherwise(F.col("_m1"))
        p = j.groupBy(*group, key).agg(F.sum("_c").alias("_t"), F.sum(F.least(F.col("_c"), others)).alias("_b"))
        p = p.select(*group, key, (F.when(F.col("_b") > 0, F.col("_b").cast("double")).otherwise(eps) / F.col("_t")).alias(f"p{n}"))
        out = p if out is None else out.join(p, [*group, key], "left")
    logs = sum((F.log(F.coalesce(F.col(f"p{n}"), F.lit(1.0))) for n in range(1, order + 1)), F.lit(0.0))
    return out.select(*group, key, F.exp(logs / order).alias("self_bleu"))
