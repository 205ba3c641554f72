"""The model boundary with deterministic stand-ins, and word attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attune.operators import inference
from attune.plans.base import GENERATIONS, generations
from attune.plans.registry import query, table


@query()
def udf_batch_model(spark, d):
    """A batched model call behind the client protocol (stand-in: words reversed); checked by brute force, as the engines' blanks differ beyond ASCII."""
    g = generations(spark, d).where("result.paraphrase IS NOT NULL")
    return g.select("gen_id", inference.generate(inference.EchoClient, F.lit("S: "), F.col("result.paraphrase")).alias("answer"))


def _share_of_vowels():
    return lambda texts: [sum(c in "aeiou" for c in t) / max(len(t), 1) for t in texts]


@query("SELECT doc_id, (len(regexp_extract_all(text, '[aeiou]')) / greatest(length(text), 1) > 0.3)::INT AS label FROM documents WHERE text IS NOT NULL")
def udf_batch_classifier(spark, d):
    """Classifier probability and its threshold (stand-in: share of vowels)."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", (inference.classify(_share_of_vowels, F.col("text")) > 0.3).cast("int").alias("label"))


def _lengths():
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query("SELECT doc_id, coalesce(length(text), 0)::DOUBLE AS first, CASE WHEN coalesce(text, '') = '' THEN 'empty' END AS error FROM documents")
def udf_embeddings(spark, d):
    """Batched embeddings with an error value per row (stand-in: lengths)."""
    e = table(spark, d, "documents").select("doc_id", inference.embed(_lengths, F.col("text")).alias("e"))
    return e.select("doc_id", F.col("e.vector")[0].alias("first"), F.col("e.error").alias("error"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 3 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS trial FROM events")
def udf_retry_loop(spark, d):
    """Rows that fail are tried again, finished ones are not."""
    e = table(spark, d, "events").select("event_id")
    need = F.when(F.col("event_id") % 4 == 0, 3).when(F.col("event_id") % 2 == 0, 2).otherwise(1)
    return inference.with_retries(e, "event_id", lambda rows, trial: rows.withColumn("answer", F.when(need <= trial, "ok")), F.col("answer") == "ok").select("event_id", "trial")


@query(f"WITH {GENERATIONS} SELECT gen_id, length(result.paraphrase)::DOUBLE / length(paraphrase) AS length_ratio FROM g WHERE length(paraphrase) > 0 AND result.paraphrase IS NOT NULL")
def udf_scorer_registry(spark, d):
    g = generations(spark, d).where("length(paraphrase) > 0 AND result.paraphrase IS NOT NULL")
    return g.select("gen_id", inference.SCORERS["length_ratio"](F.col("paraphrase"), F.col("result.paraphrase")).alias("length_ratio"))


@query("SELECT event_id, value * 2 AS doubled FROM events")
def udf_scalar_chunk(spark, d):
    return inference.map_chunks(table(spark, d, "events").select("event_id", "value"), lambda b: b.assign(doubled=b["value"] * 2)[["event_id", "doubled"]], "event_id BIGINT, doubled DOUBLE")


@query("SELECT doc_id, length(text) % 7 AS m FROM documents")
def udf_row_apply(spark, d):
    """What is applied row by row elsewhere is an expression here."""
    return table(spark, d, "documents").select("doc_id", (F.length("text") % 7).cast("long").alias("m"))


@query(f"WITH {GENERATIONS} SELECT gen_id, unnest(shap_values) AS word FROM g")
def udtf(spark, d):
    """One row to many."""
    return generations(spark, d).select("gen_id", F.explode("shap_values").alias("word"))


@query("SELECT doc_id, (len(string_split(text, ' ')) > 100)::INT AS fluent, (length(text) > 500)::INT AS style FROM documents WHERE text IS NOT NULL")
def cls_fluency(spark, d):
    """Thresholded classifier scores (stand-ins by length); the model sits behind inference.classify."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    words = inference.classify(lambda: lambda xs: [float(x.count(" ") + 1) for x in xs], F.col("text"))
    chars = inference.classify(lambda: lambda xs: [float(len(x)) for x in xs], F.col("text"))
    return t.select("doc_id", (words > 100).cast("int").alias("fluent"), (chars > 500).cast("int").alias("style"))


@query("SELECT doc_id, (length(text) > 500)::INT AS style FROM documents WHERE text IS NOT NULL")
def cls_style(spark, d):
    """Style transfer as a thresholded probability (stand-in by length)."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", (inference.classify(lambda: lambda xs: [float(len(x) > 500) for x in xs], F.col("text")) > 0.5).cast("int").alias("style"))


@query("SELECT doc_id, len(regexp_extract_all(text, '!')) / greatest(length(text), 1)::DOUBLE AS toxicity FROM documents WHERE text IS NOT NULL")
def cls_toxic(spark, d):
    """Toxicity as the first label's score (stand-in: share of exclamation marks)."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", inference.classify(lambda: lambda xs: [x.count("!") / max(len(x), 1) for x in xs], F.col("text")).alias("toxicity"))


@query("SELECT event_type, sum(value * value) / sum(value) AS weighted FROM events GROUP BY 1")
def udaf(spark, d):
    """An own aggregate is composed of built-in ones, so partial sums are made before the shuffle."""
    return table(spark, d, "events").groupBy("event_type").agg((F.sum(F.col("value") * F.col("value")) / F.sum("value")).alias("weighted"))
