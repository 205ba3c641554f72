"""Common inputs of the queries: cleaned battles, rankings in long form, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attune.functions.names import canonical_name
from attune.plans.registry import table


def battles(spark: SparkSession, d: str) -> DataFrame:
    """Valid pairwise results (idx, a, b, result, rated_at), copies of a row once."""
    r = table(spark, d, "reasoningannotation_majority_ratings").dropDuplicates()
    r = r.select("idx", canonical_name(F.col("modela")).alias("a"), canonical_name(F.col("modelb")).alias("b"), "result", "rated_at")
    return r.where("a <> b AND result IN (0, 1, 2)")


BATTLES = """b AS (
  SELECT idx, replace(lower(trim(modela)), '_', '-') AS a, replace(lower(trim(modelb)), '_', '-') AS b, result, rated_at
  FROM (SELECT DISTINCT * FROM reasoningannotation_majority_ratings)
  WHERE result IN (0, 1, 2) AND replace(lower(trim(modela)), '_', '-') <> replace(lower(trim(modelb)), '_', '-'))"""


def rankings(spark: SparkSession, d: str) -> DataFrame:
    """Valid ranks in long form (idx, user_id, model, rank), copies once."""
    r = table(spark, d, "paraphrasing_human_evaluation_users").select("idx", "user_id", F.explode("ranking").alias("k", "rank"))
    return r.select("idx", "user_id", canonical_name(F.col("k")).alias("model"), "rank").where("rank BETWEEN 1 AND 5").distinct()


RANKINGS = """r AS (
  SELECT DISTINCT idx, user_id, replace(lower(trim(e.key)), '_', '-') AS model, e.value AS rank
  FROM (SELECT idx, user_id, unnest(map_entries(ranking)) AS e FROM paraphrasing_human_evaluation_users)
  WHERE e.value BETWEEN 1 AND 5)"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The comment corpus, a key once."""
    return table(spark, d, "combined_corpus").dropDuplicates(["idx"])


CORPUS = "c AS (SELECT * FROM combined_corpus QUALIFY row_number() OVER (PARTITION BY idx ORDER BY idx) = 1)"


def generations(spark: SparkSession, d: str) -> DataFrame:
    """Model answers, a key once."""
    return table(spark, d, "paraphrase_generation").dropDuplicates(["gen_id"])


GENERATIONS = "g AS (SELECT * FROM paraphrase_generation QUALIFY row_number() OVER (PARTITION BY gen_id ORDER BY gen_id) = 1)"
