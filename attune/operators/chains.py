"""Scores of reasoning chains from step vectors and supplied probabilities; all inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attune.operators.similarity import cosine, scaled


def alignment(steps: Column, reference: Column) -> Column:
    """For each step vector the best scaled cosine with a reference step; empty if either side is."""
    best = F.transform(steps, lambda s: F.array_max(F.transform(reference, lambda r: scaled(cosine(s, r)))))
    return F.when(F.size(reference) > 0, best).otherwise(F.array().cast("array<double>"))


def mean(values: Column) -> Column:
    """Mean of an array, 0 if empty; nulls are passed over."""
    v = F.array_compact(values)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.0)


def repetition(steps: Column) -> Column:
    """Largest cosine of a step with any step before it; null for chains of one step."""
    pairs = F.flatten(F.transform(steps, lambda s, i: F.transform(F.slice(steps, F.lit(1), i), lambda p: cosine(s, p))))
    return F.array_max(pairs)


def scores(df: DataFrame, key: str, hypothesis: str, context: str, reference: str, h_chain: str, c_chain: str, r_chain: str) -> DataFrame:
    """Embedding scores of a chain against its context and a reference; an empty chain has nulls only."""
    h, c, r = F.col(hypothesis), F.col(context), F.col(reference)
    a = df.withColumns({"hc": alignment(h, c), "ch": alignment(c, h), "hr": alignment(h, r), "rh": alignment(r, h), "rc": alignment(r, c)})
    cols = {
        "faithfulness": mean(F.col("hc")),
        "faithfulness_ww": mean(F.concat("hc", "hr")),
        "informativeness_step": (mean(F.col("hc")) + mean(F.col("ch"))) / 2,
        "informativeness_chain": scaled(scaled(cosine(F.col(h_chain), F.col(c_chain)))),
        "repetition_step": F.coalesce((1 - repetition(h)) / 2, F.lit(1.0)),
        "repetition_word": F.coalesce(1 - scaled(repetition(h)), F.lit(1.0)),
        "alignment_ref": mean(F.col("hr")),
        "ext_hallucination": 1 - F.array_max(F.zip_with("hr", "hc", lambda x, y: (1 - x) * (1 - y))),
        "redundancy": F.array_min("hr"),
        "common_sense": 1 - F.array_max(F.zip_with("rh", "rc", lambda x, y: (1 - x) * (1 - y))),
        "missing_step": F.array_min("rh"),
        "coverage_step": 1 - F.abs(mean(F.col("rc")) - mean(F.col("hc"))),
        "coverage_chain": scaled(scaled(cosine(F.col(h_chain), F.col(r_chain)))),
    }
    return a.select(key, *[F.when(F.size(h) > 0, v).alias(n) for n, v in cols.items()])


def discourse(contradiction: Column) -> Column:
    """1 less the largest contradiction probability of (context, step) pairs."""
    return 1 - F.array_max(contradiction)


def perplexity(losses: Column, counts: Column) -> Column:
    """Inverse of the token-weighted mean perplexity."""
    total = F.aggregate(F.zip_with(losses, counts, lambda p, n: p * n), F.lit(0.0), lambda a, x: a + x)
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when((n > 0) & (total > 0), n / total)


#: Which group each score belongs to.
GROUPS = {
    "SA": ("faithfulness", "faithfulness_ww", "informativeness_step", "repetition_word", "alignment_ref", "ext_hallucination", "redundancy", "common_sense", "missing_step", "coverage_step"),
    "SS": ("informativeness_chain", "repetition_step", "coverage_chain"),
    "LI": ("discourse_representation", "coherence_step_vs_step"),
    "LC": ("perplexity_step", "perplexity_chain", "perplexity_step_max", "grammar_step", "grammar_step_max"),
}

#: Short names of annotation labels.
SHORT_NAMES = {
    "grammar": "GRAM", "factuality": "FACT", "hallucination": "HALL", "redundancy": "RED", "repetition": "REP", "missing_step": "MISS",
    "logical_deduction": "LOGIC", "commonsense": "COMMON", "arithmetic": "MATH", "quality": "QUAL", "coherency": "COH",
}
