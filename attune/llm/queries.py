"""Queries of the training-data operators over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attune.llm import abuse, consensus, defects, forest, leakage, pii, ranking, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# 1. Consensus from several annotators' labels


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The system that careful annotators, taken together, place first for each ranked item."""
    c = consensus.consensus(table(spark, d, "paraphrasing_human_evaluation_users"))
    return c.scores.where("place = 1").select(F.col("item").alias("idx"), F.col("label").alias("model"))


@query
def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of every annotator."""
    c = consensus.consensus(table(spark, d, "paraphrasing_human_evaluation_users"))
    return c.annotators.select(F.col("annotator").alias("user_id"), "items", "pairs", F.round("accuracy", 4).alias("accuracy"), F.round("weight", 4).alias("weight"))


@query
def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Chance-corrected agreement of all annotators."""
    c = consensus.consensus(table(spark, d, "paraphrasing_human_evaluation_users"), rounds=1)
    return c.agreement.select(F.round("alpha", 6).alias("alpha"), "ratings", "items")


# 4. Global ranking from pairwise comparisons


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All systems by maximum-likelihood strength."""
    return ranking.global_ranking(table(spark, d, "reasoningannotation_majority_ratings")).select("place", "model")


@query
def p4_strengths(spark: SparkSession, d: str) -> DataFrame:
    """Strength, comparisons and wins behind the places."""
    r = ranking.global_ranking(table(spark, d, "reasoningannotation_majority_ratings"))
    return r.select("place", "model", F.round("strength", 6).alias("strength"), "comparisons", "wins")


# 6. Encoding of the whole corpus with a public tokenizer


@query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k, without special tokens."""
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text", f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")


@query
def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts, tokens and texts that do not come back byte for byte (none)."""
    return tokens.round_trip(table(spark, d, "documents"), "doc_id", "text", f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")


# 5. Most similar vectors for every vector


def _similar(spark: SparkSession, d: str) -> DataFrame:
    return forest.similar(table(spark, d, "paraphrase_vectors"), "id", "vector", dim=96, k=5, least=0.8)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cosine 0.80 or more, one being among the five most similar of the other."""
    near = _similar(spark, d)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


@query
def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar rows of 0.80 or more of every row, with their cosine and place."""
    return _similar(spark, d).select("id", "other", F.round("cosine", 6).alias("cosine"), "place")


# 7. Evaluation texts leaking into training text


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation item's own wording, with the item."""
    return leakage.contaminated(table(spark, d, "documents"), table(spark, d, "evaluation_items"))


@query
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents leak each item."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


# 8. Personal information inside free text


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of personal data with its kind."""
    return pii.personal_data(table(spark, d, "documents")).select("doc_id", "kind", "pii_text").distinct()


@query
def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All documents with typed placeholders."""
    return pii.redacted(table(spark, d, "documents"))


@query
def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and affected documents per kind."""
    found = pii.personal_data(table(spark, d, "documents"))
    return found.groupBy("kind").agg(F.count("*").alias("pieces"), F.countDistinct("doc_id").alias("documents"))


# 3. Abusive, hateful or sexual content


def _abuse(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "combined_corpus")
    # the vector store keeps a label per sentence, some of them wrong
    labelled = table(spark, d, "paraphrase_vectors").select("id", "sentence", F.lower(F.trim("label")).alias("label"))
    toxic = F.when(F.col("label") == "toxic", True).when(F.col("label") == "non-toxic", False)
    model = abuse.detector(labelled, "id", "sentence", toxic, corpus, "idx", "paraphrase", table(spark, d, "profanity_wordlist"))
    return abuse.scored(corpus, model, "idx", "sentence", "paraphrase", ("source",))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and rewrite lists that hold such language."""
    s = _abuse(spark, d)
    fields = F.array(F.when(F.col("sentence_score") > 0, F.lit("sentence")), F.when(F.col("rewrite_score") > 0, F.lit("paraphrase")))
    return s.select("idx", F.explode(F.array_compact(fields)).alias("field")).distinct()


@query
def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every sentence and rewrite list (log-odds over the threshold)."""
    return _abuse(spark, d).dropDuplicates(["idx"]).select("idx", F.round("sentence_score", 4).alias("sentence_score"), F.round("rewrite_score", 4).alias("rewrite_score"))


@query
def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of such language per source."""
    s = _abuse(spark, d).dropDuplicates(["idx"])
    rate = lambda c: F.round(F.avg((F.coalesce(F.col(c), F.lit(-1.0)) > 0).cast("double")), 6)
    return s.groupBy("source").agg(F.count("*").alias("n"), rate("sentence_score").alias("sentence_rate"), rate("rewrite_score").alias("paraphrase_rate"))


# 2. Broken prompt and response pairs


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective results with their type of defect."""
    return defects.broken_pairs(table(spark, d, "paraphrase_generation")).select("gen_id", "defect").distinct()


@query
def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Defective results per type."""
    return p2_found(spark, d).groupBy("defect").agg(F.count("*").alias("results"))
