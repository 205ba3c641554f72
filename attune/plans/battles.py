"""Pairs, wins, votes, Elo and judge agreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attune.operators import pairs, ranks
from attune.plans.base import BATTLES, RANKINGS, battles, rankings
from attune.plans.registry import query, table

_DIRECTED = """, s AS (SELECT a AS model, b AS opponent, CASE result WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS win FROM b
  UNION ALL SELECT b, a, CASE result WHEN 2 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END::DOUBLE FROM b)"""
_FRACTION = _DIRECTED + """, f AS (SELECT model, opponent, CASE WHEN count(*) FILTER (win <> 0.5) > 0 THEN count(*) FILTER (win = 1)::DOUBLE / count(*) FILTER (win <> 0.5) END AS fraction FROM s GROUP BY ALL)"""


@query(f"""WITH {BATTLES}{_FRACTION}, w AS (SELECT model, count(*) FILTER (win = 1) AS wins, count(*) AS battles FROM s GROUP BY 1), r AS (SELECT model, avg(fraction) AS rate FROM f GROUP BY 1)
SELECT model, wins, battles, rate, dense_rank() OVER (ORDER BY wins DESC) AS place, rank() OVER (ORDER BY rate DESC) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0::DOUBLE AS rate_rank FROM w JOIN r USING (model)""")
def leaderboard(spark, d):
    """Flagship: wins, battles, average win rate and ranks of every system."""
    b = battles(spark, d)
    both = pairs.wins(b).join(pairs.average_win_rate(b), "model")
    everyone = Window.partitionBy()
    return both.select(
        "model", "wins", "battles", "rate",
        F.dense_rank().over(everyone.orderBy(F.desc("wins"))).cast("long").alias("place"),
        (F.rank().over(everyone.orderBy(F.desc("rate"))) + (F.count("*").over(Window.partitionBy("rate")) - 1) / F.lit(2.0)).alias("rate_rank"),
    )


@query(f"WITH {BATTLES}{_DIRECTED} SELECT model, count(*) FILTER (win = 1) AS wins, count(*) AS battles FROM s GROUP BY 1")
def agg_wins(spark, d):
    return pairs.wins(battles(spark, d))


@query(f"WITH {BATTLES}{_FRACTION} SELECT * FROM f")
def agg_win_fraction(spark, d):
    return pairs.win_fraction(battles(spark, d))


@query(f"WITH {BATTLES}{_FRACTION} SELECT model, avg(fraction) AS rate FROM f GROUP BY 1")
def agg_avg_win_rate(spark, d):
    return pairs.average_win_rate(battles(spark, d))


@query(f"WITH {BATTLES} SELECT a, b, count(*) AS n FROM b GROUP BY ALL")
def agg_pivot_count(spark, d):
    return battles(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"""WITH {BATTLES}, n AS (SELECT idx, least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a < b OR result = 0 THEN result ELSE 3 - result END AS vote FROM b),
k AS (SELECT idx, a, b, vote, count(*) AS n FROM n GROUP BY ALL)
SELECT idx, a, b, CASE WHEN max(n) > 1 AND count(*) FILTER (n = m) = 1 THEN max(CASE WHEN n = m THEN vote END) ELSE 0 END AS majority FROM (SELECT *, max(n) OVER (PARTITION BY idx, a, b) AS m FROM k) GROUP BY idx, a, b""")
def agg_majority(spark, d):
    b = battles(spark, d)
    turned = F.when((F.col("a") < F.col("b")) | (F.col("result") == 0), F.col("result")).otherwise(3 - F.col("result"))
    votes = b.select("idx", F.least("a", "b").alias("l"), F.greatest("a", "b").alias("g"), turned.alias("vote")).withColumnsRenamed({"l": "a", "g": "b"})
    return pairs.majority(votes, ["idx", "a", "b"], "vote")


@query()
def agg_elo(spark, d):
    """Elo over the whole history, an ordered fold; checked against a loop in the tests."""
    return pairs.elo(battles(spark, d), [], ["rated_at", "idx"]).withColumn("rating", F.round("rating", 6))


@query()
def agg_elo_by_quarter(spark, d):
    """Elo per quarter of ratings."""
    b = battles(spark, d).withColumn("period", F.concat_ws("-", F.year("rated_at"), F.quarter("rated_at")))
    return pairs.elo(b, ["period"], ["rated_at", "idx"]).withColumn("rating", F.round("rating", 6))


@query()
def agg_elo_bootstrap(spark, d):
    """Median and interval of Elo over 1,000 resamples; random by nature."""
    return pairs.elo_bootstrap(battles(spark, d), 1_000)


@query(f"WITH {RANKINGS} SELECT x.idx, x.user_id, x.model AS a, y.model AS b, x.rank AS rank_a, y.rank AS rank_b FROM r x JOIN r y ON x.idx = y.idx AND x.user_id = y.user_id AND x.model < y.model")
def jn_self_pairs(spark, d):
    r = rankings(spark, d).withColumn("item", F.struct("idx", "user_id"))
    return pairs.self_pairs(r, "item", "model", ["rank"]).select("item.*", "a", "b", "rank_a", "rank_b")


@query(f"""WITH {BATTLES}, m AS (SELECT a AS model, count(*)::DOUBLE AS w FROM b GROUP BY 1), p AS (SELECT x.model AS a, y.model AS b, x.w * y.w AS p FROM m x JOIN m y ON x.model <> y.model)
SELECT a, b, p / sum(p) OVER () AS share FROM p""")
def jn_self_pairs_ordered(spark, d):
    return pairs.ordered_pairs(battles(spark, d).groupBy(F.col("a").alias("model")).agg(F.count("*").cast("double").alias("w")), "model", "w")


@query(f"WITH {RANKINGS} SELECT x.idx, x.user_id, x.model AS a, y.model AS b, CASE WHEN x.rank > y.rank THEN 1 WHEN x.rank < y.rank THEN 2 ELSE 0 END AS result FROM r x JOIN r y ON x.idx = y.idx AND x.user_id = y.user_id AND x.model < y.model")
def mth_compare3(spark, d):
    r = rankings(spark, d).withColumn("item", F.struct("idx", "user_id"))
    return pairs.self_pairs(r, "item", "model", ["rank"]).select("item.*", "a", "b", pairs.compare3(F.col("rank_a"), F.col("rank_b")).alias("result"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - l_discount * 500) <= 5 THEN 0 WHEN l_quantity > l_discount * 500 THEN 1 ELSE -1 END AS win FROM lineitem")
def mth_win_list(spark, d):
    diff = F.col("l_quantity") - F.col("l_discount") * 500
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.abs(diff) <= 5, 0).when(diff > 0, 1).otherwise(-1).alias("win"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity + l_discount * 100) / 2 AS a, (l_extendedprice / 1000 + l_tax * 100) / 2 AS b FROM lineitem""")
def mth_position_debias(spark, d):
    f = F.array("l_quantity", F.col("l_extendedprice") / 1000)
    r = F.array(F.col("l_tax") * 100, F.col("l_discount") * 100)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pairs.debias(f, r).alias("s")).select("l_orderkey", "l_linenumber", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))


_JUDGE = f"""WITH {BATTLES}, t AS (SELECT idx, CASE result WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS gold, (extract(day FROM rated_at)::INT % 3) - 1 AS pred FROM b)"""


def _judge(spark, d):
    gold = F.when(F.col("result") == 1, 1).when(F.col("result") == 2, -1).otherwise(0)
    return battles(spark, d).select("idx", gold.alias("gold"), (F.dayofmonth("rated_at") % 3 - 1).alias("pred"))


@query(_JUDGE + """, k AS (SELECT v, count(*) FILTER (gold = v AND pred = v)::DOUBLE AS tp, count(*) FILTER (pred = v)::DOUBLE AS p, count(*) FILTER (gold = v)::DOUBLE AS g FROM t, (VALUES (-1), (0), (1)) c(v) GROUP BY v),
m AS (SELECT CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pr, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS re FROM k)
SELECT (SELECT avg((gold = pred)::INT) FROM t) AS accuracy, avg(pr) AS precision, avg(re) AS recall, avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) AS f1 FROM m""")
def agg_confusion_metrics(spark, d):
    """Accuracy and macro precision, recall and F1 of a judge over win, tie and loss in one pass."""
    t = _judge(spark, d)
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    one = t.agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"), *[x for v in (-1, 0, 1) for x in (n((F.col("gold") == v) & (F.col("pred") == v)).alias(f"tp{v + 1}"), n(F.col("pred") == v).alias(f"p{v + 1}"), n(F.col("gold") == v).alias(f"g{v + 1}"))])
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    pr, re = ([part(f"tp{k}", f"{s}{k}") for k in range(3)] for s in "pg")
    f1 = [F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0) for a, b in zip(pr, re, strict=True)]
    return one.select("accuracy", *[(sum(x, F.lit(0.0)) / 3).alias(k) for k, x in (("precision", pr), ("recall", re), ("f1", f1))])


@query(_JUDGE + """ SELECT avg((gold = -pred)::INT) AS consistency, avg((gold = 1 AND pred = 1)::INT) AS prefer_before, avg((gold = -1 AND pred = -1)::INT) AS prefer_after, avg((gold = 1 AND pred = 1)::INT) - avg((gold = -1 AND pred = -1)::INT) AS delta_bias, avg((gold = 1 AND pred = 1)::INT) + avg((gold = -1 AND pred = -1)::INT) AS total_bias FROM t""")
def agg_consistency_bias(spark, d):
    """Agreement of a forward run with the run on swapped answers, and which place it prefers."""
    share = lambda c: F.avg(c.cast("double"))
    before, after = share((F.col("gold") == 1) & (F.col("pred") == 1)), share((F.col("gold") == -1) & (F.col("pred") == -1))
    return _judge(spark, d).agg(share(F.col("gold") == -F.col("pred")).alias("consistency"), before.alias("prefer_before"), after.alias("prefer_after"), (before - after).alias("delta_bias"), (before + after).alias("total_bias"))


@query(_JUDGE + " SELECT idx, count(*) FILTER (gold <> pred) AS differing FROM t GROUP BY idx")
def agg_prompt_variant_diff(spark, d):
    return _judge(spark, d).groupBy("idx").agg(F.count(F.when(F.col("gold") != F.col("pred"), 1)).alias("differing"))


@query(f"""WITH {BATTLES}{_DIRECTED}, w AS (SELECT idx, a, b, result FROM b), x AS (SELECT idx, a AS model, (result = 1)::INT AS win FROM w UNION ALL SELECT idx, b, (result = 2)::INT FROM w),
k AS (SELECT idx, model, sum(win) AS wins FROM x GROUP BY ALL) SELECT idx, model, wins::BIGINT AS wins FROM k QUALIFY row_number() OVER (PARTITION BY idx ORDER BY wins DESC, model) = 1""")
def agg_best_of_group(spark, d):
    """The model with the most wins per item; ties by name."""
    b = battles(spark, d)
    sides = F.array(F.struct(F.col("a").alias("model"), (F.col("result") == 1).cast("long").alias("win")), F.struct(F.col("b").alias("model"), (F.col("result") == 2).cast("long").alias("win")))
    k = b.select("idx", F.explode(sides).alias("s")).groupBy("idx", "s.model").agg(F.sum("s.win").alias("wins"))
    w = Window.partitionBy("idx").orderBy(F.desc("wins"), "model")
    return k.withColumn("n", F.row_number().over(w)).where("n = 1").select("idx", "model", "wins")
