"""Aggregations: summaries, quality measures, agreement and log counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attune.operators import agreement, summaries
from attune.plans.base import BATTLES, CORPUS, GENERATIONS, RANKINGS, battles, corpus, generations, rankings
from attune.plans.registry import query, table


@query(f"WITH {GENERATIONS} SELECT idx, list_sort(list(DISTINCT model)) AS models FROM g GROUP BY idx")
def agg_collect_set(spark, d):
    return generations(spark, d).groupBy("idx").agg(F.sort_array(F.collect_set("model")).alias("models"))


@query(f"WITH {GENERATIONS} SELECT gen_id, len(list_distinct(list_filter([sentence, paraphrase, result.paraphrase], lambda x: x IS NOT NULL)))::INT AS n FROM g")
def agg_distinct_cols(spark, d):
    return generations(spark, d).select("gen_id", F.size(F.array_distinct(F.array_compact(F.array("sentence", "paraphrase", "result.paraphrase")))).alias("n"))


@query("SELECT source, avg(n_chars) AS mean_chars, count(*) AS n FROM documents GROUP BY 1")
def agg_mean_by_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean_chars"), F.count("*").alias("n"))


@query("SELECT l_returnflag, avg(l_quantity) * avg(l_discount) * avg(l_tax) AS joint FROM lineitem GROUP BY 1")
def agg_joint_of_means(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg((F.avg("l_quantity") * F.avg("l_discount") * F.avg("l_tax")).alias("joint"))


@query("SELECT l_returnflag, avg(l_quantity * l_discount * l_tax) AS joint FROM lineitem GROUP BY 1")
def agg_joint_rowwise(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg(F.col("l_quantity") * F.col("l_discount") * F.col("l_tax")).alias("joint"))


@query("SELECT l_linestatus, avg(l_quantity) AS mean_quantity, stddev_samp(l_quantity) AS std_quantity, avg(l_tax) AS mean_tax, stddev_samp(l_tax) AS std_tax FROM lineitem GROUP BY 1")
def agg_mean_std_cols(spark, d):
    return summaries.mean_std(table(spark, d, "lineitem"), ["l_linestatus"], {"quantity": "l_quantity", "tax": "l_tax"})


@query("SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def agg_describe_list(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("""SELECT event_type, avg(value) AS mean, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, stddev_pop(value) AS std, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, max(value) AS high, min(value) AS low FROM events GROUP BY 1""")
def agg_dist_summary(spark, d):
    return summaries.distribution(table(spark, d, "events"), ["event_type"], "value")


@query("""WITH s AS (SELECT DISTINCT id, sentence, paraphrase FROM paraphrase_vectors WHERE sentence IS NOT NULL AND paraphrase IS NOT NULL)
SELECT sentence, min(paraphrase) AS best FROM (SELECT *, min(levenshtein(lower(left(sentence, 60)), lower(left(paraphrase, 60)))) OVER (PARTITION BY sentence) AS m FROM s) WHERE levenshtein(lower(left(sentence, 60)), lower(left(paraphrase, 60))) = m GROUP BY 1""".replace("left(sentence, 60)", "sentence").replace("left(paraphrase, 60)", "paraphrase"))
def agg_argmin_weighted(spark, d):
    """Candidate with the least weighted cost per sentence; the first by text on ties."""
    v = table(spark, d, "paraphrase_vectors").where("sentence IS NOT NULL AND paraphrase IS NOT NULL").select("sentence", "paraphrase").distinct()
    cost = F.levenshtein(F.lower("sentence"), F.lower("paraphrase"))
    return v.groupBy("sentence").agg(F.min(F.struct(cost.alias("c"), F.col("paraphrase").alias("p"))).alias("b")).select("sentence", F.col("b.p").alias("best"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def agg_vote_events(spark, d):
    """Events of chosen types per user, one column each, in one pass."""
    return summaries.count_columns(table(spark, d, "events"), ["user_id"], "event_type", ["click", "view", "error"])


@query("SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def agg_daily_counts(spark, d):
    return summaries.daily_counts(table(spark, d, "events"), "ts", "America/Los_Angeles")


@query("""WITH m AS (SELECT max(ts) AS hi FROM events), l AS (SELECT ts FROM events, m WHERE ts > hi - INTERVAL 1 DAY), b AS (SELECT min(ts) AS base FROM l),
h AS (SELECT floor((epoch(ts) - epoch(base)) / 3600)::BIGINT AS hour, count(*) AS n FROM l, b GROUP BY 1)
SELECT s.hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 24)) AS hour) s LEFT JOIN h USING (hour)""")
def agg_hour_buckets(spark, d):
    return summaries.hour_buckets(table(spark, d, "events"), "ts")


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 20")
def agg_nested_topk(spark, d):
    return summaries.nested_topk(table(spark, d, "events"), "event_type", "user_id", 20)


@query("SELECT count(*) AS votes, count(DISTINCT user_id) AS users, (SELECT count(*) FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)) AS keys FROM events")
def agg_count_distinct(spark, d):
    e = table(spark, d, "events").agg(F.count("*").alias("votes"), F.countDistinct("user_id").alias("users"))
    k = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").select("c_custkey")).distinct().agg(F.count("*").alias("keys"))
    return e.crossJoin(k)


@query("SELECT lower(trim(sentence)) AS prompt, count(*) AS n FROM combined_corpus GROUP BY 1 ORDER BY n DESC, prompt NULLS FIRST LIMIT 10")
def agg_prompt_frequency(spark, d):
    g = table(spark, d, "combined_corpus").groupBy(F.lower(F.trim("sentence")).alias("prompt")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), F.asc_nulls_first("prompt")).limit(10)


_P = "p AS (SELECT event_id, least(greatest(value / 100.0::DOUBLE, 0.0), 1.0) AS p, (event_id % 2)::INT AS y FROM events)"


def _p(spark, d):
    return table(spark, d, "events").select("event_id", F.least(F.greatest(F.col("value") / 100.0, F.lit(0.0)), F.lit(1.0)).alias("p"), (F.col("event_id") % 2).cast("int").alias("y"))


@query(f"WITH {_P} SELECT avg(-(p * ln(p + 1e-9) + (1 - p) * ln(1 - p + 1e-9))) AS entropy FROM p")
def agg_quality_entropy(spark, d):
    return _p(spark, d).agg(F.avg(agreement.entropy(F.col("p"))).alias("entropy"))


@query(f"WITH {_P} SELECT avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS logloss FROM p")
def agg_quality_logloss(spark, d):
    return _p(spark, d).agg(F.avg(agreement.logloss(F.col("p"), F.col("y"))).alias("logloss"))


@query(f"WITH {_P}, k AS (SELECT (p > 0.5)::INT AS x, y, count(*)::DOUBLE AS n FROM p GROUP BY ALL), t AS (SELECT sum(n) AS n FROM k) SELECT sum(k.n / t.n * ln(k.n * t.n / (kx.n * ky.n))) AS mi FROM k, t, (SELECT x, sum(n) AS n FROM k GROUP BY 1) kx, (SELECT y, sum(n) AS n FROM k GROUP BY 1) ky WHERE k.x = kx.x AND k.y = ky.y")
def agg_quality_mi(spark, d):
    return agreement.mutual_information(_p(spark, d).select((F.col("p") > 0.5).cast("int").alias("x"), "y"), "x", "y")


@query(f"WITH {_P} SELECT y, avg(((p > 0.5)::INT = y)::INT) AS accuracy, avg(CASE WHEN y = 1 THEN p ELSE 1 - p END) AS confidence FROM p GROUP BY 1")
def agg_quality_accuracy(spark, d):
    return _p(spark, d).groupBy("y").agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"), F.avg(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))).alias("confidence"))


@query(f"WITH {BATTLES} SELECT idx FROM b GROUP BY idx HAVING count(*) FILTER (result <> 0) = 0")
def agg_all_models_wrong(spark, d):
    """Items that no system got right (here: none won any of its comparisons)."""
    return battles(spark, d).groupBy("idx").agg(F.max("result").alias("n")).where("n = 0").select("idx")


_FLEISS = f"""WITH {RANKINGS}, u AS (SELECT idx, model, count(*)::DOUBLE AS n FROM r GROUP BY ALL HAVING count(*) = 5), k AS (SELECT idx, model, rank, count(*)::DOUBLE AS c FROM r JOIN u USING (idx, model) GROUP BY ALL)
SELECT (avg_p - pe) / (1 - pe) AS kappa FROM (SELECT avg(p) AS avg_p FROM (SELECT (sum(c * c) - 5) / (5 * 4) AS p FROM k GROUP BY idx, model)), (SELECT sum(q * q) AS pe FROM (SELECT sum(c) / (SELECT sum(c) FROM k) AS q FROM k GROUP BY rank))"""


@query(_FLEISS)
def agg_kappa_fleiss(spark, d):
    """Fleiss' kappa over the subjects that exactly five annotators rated."""
    r = rankings(spark, d)
    five = r.groupBy("idx", "model").agg(F.count("*").alias("n")).where("n = 5")
    return agreement.fleiss(r.join(five, ["idx", "model"], "left_semi"), ["idx", "model"], "rank", 5)


@query(f"""WITH {RANKINGS}, j AS (SELECT a.user_id AS a, b.user_id AS b, a.rank AS x, b.rank AS y FROM r a JOIN r b ON a.idx = b.idx AND a.model = b.model AND a.user_id < b.user_id),
n AS (SELECT a, b, count(*)::DOUBLE AS n, avg((x = y)::INT) AS po FROM j GROUP BY ALL), px AS (SELECT a, b, x AS v, count(*)::DOUBLE AS n FROM j GROUP BY ALL), py AS (SELECT a, b, y AS v, count(*)::DOUBLE AS n FROM j GROUP BY ALL),
e AS (SELECT n.a, n.b, coalesce(sum(px.n * py.n), 0) / max(n.n * n.n) AS pe FROM n LEFT JOIN px ON n.a = px.a AND n.b = px.b LEFT JOIN py ON px.a = py.a AND px.b = py.b AND px.v = py.v GROUP BY ALL)
SELECT n.a, n.b, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM n JOIN e ON n.a = e.a AND n.b = e.b""")
def agg_kappa_cohen(spark, d):
    """Cohen's kappa of every pair of annotators over the subjects they share."""
    return agreement.cohen(rankings(spark, d), ["idx", "model"], "user_id", "rank")


@query("SELECT l_orderkey, min(l_discount) AS any_discount, min(CASE WHEN l_tax > 0 THEN l_tax END) AS any_tax, bool_or(l_discount > 0.09 OR l_tax > 0.07) AS any_issue FROM lineitem GROUP BY 1")
def agg_min_over_steps(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_discount").alias("any_discount"), F.min(F.when(F.col("l_tax") > 0, F.col("l_tax"))).alias("any_tax"), F.bool_or((F.col("l_discount") > 0.09) | (F.col("l_tax") > 0.07)).alias("any_issue"))


@query(f"WITH {CORPUS}, s AS (SELECT len(paraphrase) AS n FROM c WHERE paraphrase IS NOT NULL) SELECT k AS step, count(*) AS examples FROM s, (SELECT unnest(range(1, 8)) AS k) WHERE k <= n GROUP BY 1")
def agg_step_count_stats(spark, d):
    """How many examples reach each step number."""
    return corpus(spark, d).select(F.posexplode("paraphrase")).groupBy((F.col("pos") + 1).cast("long").alias("step")).agg(F.count("*").alias("examples")).where("step < 8")


@query("SELECT l_returnflag, max(CASE WHEN l_tax < 0.05 THEN l_discount END) AS top FROM lineitem GROUP BY 1")
def agg_significant_max(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max(F.when(F.col("l_tax") < 0.05, F.col("l_discount"))).alias("top"))


@query("SELECT l_suppkey, avg(l_quantity) AS mean_stat, avg(l_tax) AS mean_p, max(l_extendedprice) AS max_stat, max_by(l_tax, l_extendedprice) AS p_at_max FROM lineitem GROUP BY 1")
def agg_avg_and_argmax(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean_stat"), F.avg("l_tax").alias("mean_p"), F.max("l_extendedprice").alias("max_stat"), F.max_by("l_tax", "l_extendedprice").alias("p_at_max"))


@query()
def agg_drop_all_null_cols(spark, d):
    """Columns that hold any value; which those are depends on the data."""
    e = table(spark, d, "events").select("event_id", "value", F.lit(None).cast("double").alias("nothing"))
    return summaries.drop_all_null(e)
