"""Ranks, points, Borda counts, brackets and window shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attune.operators import ranks, sampling
from attune.plans.base import CORPUS, RANKINGS, corpus, rankings
from attune.plans.registry import query, table

_S = "s AS (SELECT source AS item, lang AS label, round(avg(n_chars), -2)::DOUBLE AS score FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL)"


def _scores(spark, d):
    return table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").groupBy(F.col("source").alias("item"), F.col("lang").alias("label")).agg(F.round(F.avg("n_chars"), -2).alias("score"))


@query(f"WITH {_S} SELECT item, label, dense_rank() OVER (PARTITION BY item ORDER BY score DESC) AS rank FROM s")
def win_rank_dense(spark, d):
    return ranks.ranked(_scores(spark, d), ["item"], "score", "label").select("item", "label", F.col("rank_dense").cast("long").alias("rank"))


@query(f"WITH {_S} SELECT item, label, rank() OVER (PARTITION BY item ORDER BY score DESC) AS rank FROM s")
def win_rank_competition(spark, d):
    return ranks.ranked(_scores(spark, d), ["item"], "score", "label").select("item", "label", F.col("rank_competition").cast("long").alias("rank"))


@query(f"WITH {_S} SELECT item, label, rank() OVER (PARTITION BY item ORDER BY score DESC) + (count(*) OVER (PARTITION BY item, score) - 1) / 2.0::DOUBLE AS rank FROM s")
def win_rank_fractional(spark, d):
    return ranks.ranked(_scores(spark, d), ["item"], "score", "label").select("item", "label", F.col("rank_fractional").alias("rank"))


@query(f"WITH {_S} SELECT item, label, row_number() OVER (PARTITION BY item ORDER BY score DESC, label) AS rank FROM s")
def win_rank_ordinal(spark, d):
    return ranks.ranked(_scores(spark, d), ["item"], "score", "label").select("item", "label", F.col("rank_ordinal").cast("long").alias("rank"))


@query(f"WITH {_S}, t AS (SELECT *, CASE WHEN score <> lag(score) OVER (PARTITION BY item ORDER BY label) THEN 1 ELSE 0 END AS st FROM s) SELECT item, label, (1 + sum(st) OVER (PARTITION BY item ORDER BY label))::INT AS rank FROM t")
def win_rank_name_order(spark, d):
    return ranks.name_order_rank(_scores(spark, d), ["item"], "score", "label").select("item", "label", F.col("rank_name_order").alias("rank"))


@query("""WITH v AS (SELECT id, m, v FROM (SELECT row_number() OVER () AS id, l_quantity AS quantity, l_extendedprice / 1000 AS price, l_discount * 500 AS discount FROM lineitem) UNPIVOT (v FOR m IN (quantity, price, discount))),
r AS (SELECT m, rank() OVER (PARTITION BY id ORDER BY v DESC) + (count(*) OVER (PARTITION BY id, v) - 1) / 2.0::DOUBLE AS r FROM v) SELECT m AS metric, avg(r) AS mean_rank FROM r GROUP BY m""")
def win_rank_columns(spark, d):
    """Mean rank of each column over the rows: ranks inside a row are counted in place, without a shuffle."""
    l = table(spark, d, "lineitem").select(F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 500).alias("v"))
    rank = lambda i: 1 + F.size(F.filter("v", lambda x: x > F.col("v")[i])) + (F.size(F.filter("v", lambda x: x == F.col("v")[i])) - 1) / F.lit(2.0)
    one = l.agg(*[F.avg(rank(i)).alias(n) for i, n in enumerate(("quantity", "price", "discount"))])
    return one.unpivot([], ["quantity", "price", "discount"], "metric", "mean_rank")


@query("SELECT o_orderkey, o_totalprice * 1.0::DOUBLE + (o_orderkey % 7) * -3.0::DOUBLE AS objective FROM orders ORDER BY 2 DESC, 1 LIMIT 25")
def win_weighted_order(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 7).cast("double").alias("m"))
    return ranks.weighted_order(o, "o_orderkey", {"o_totalprice": 1, "m": -3}, 25).select("o_orderkey", "objective")


@query(f"WITH {RANKINGS} SELECT idx, user_id, model, rank + 2 AS rank FROM r WHERE rank <= 3")
def win_round1_offset(spark, d):
    return rankings(spark, d).where("rank <= 3").select("idx", "user_id", "model", (F.col("rank") + 2).alias("rank"))


_BR = f"{RANKINGS}, o AS (SELECT idx, user_id, model, rank + 2 AS rank, (row_number() OVER (PARTITION BY idx, user_id ORDER BY model) - 1) // 3 AS triplet FROM r)"


def _triplets(spark, d):
    n = F.row_number().over(Window.partitionBy("idx", "user_id").orderBy("model"))
    return rankings(spark, d).select(F.struct("idx", "user_id").alias("idx"), "model", (F.col("rank") + 2).alias("rank"), F.floor((n - 1) / 3).alias("triplet"))


@query(f"WITH {_BR}, m AS (SELECT idx, user_id, triplet, min(rank) AS rank FROM o GROUP BY ALL) SELECT o.idx, o.user_id, o.triplet, o.model, CASE WHEN m.rank IS NULL THEN o.rank ELSE (o.triplet + 1)::INT END AS rank FROM o LEFT JOIN m ON o.idx = m.idx AND o.user_id = m.user_id AND o.triplet = m.triplet AND o.rank = m.rank")
def win_bracket_merge(spark, d):
    first = _triplets(spark, d)
    final = first.groupBy("idx", "triplet").agg(F.min("rank").alias("rank")).withColumn("new_rank", (F.col("triplet") + 1).cast("int"))
    return ranks.bracket_merge(first, final).select("idx.*", "triplet", "model", "rank")


@query(f"WITH {_BR} SELECT idx, user_id, triplet, model FROM o QUALIFY row_number() OVER (PARTITION BY idx, user_id, triplet ORDER BY rank, md5(concat('11:', idx, '-', user_id, '-', model)), model) = 1")
def win_second_round(spark, d):
    """Winner of every triplet; ties by a keyed lot."""
    t = _triplets(spark, d)
    lot = sampling.lot(F.concat_ws("-", "idx.idx", "idx.user_id", "model"), 11)
    w = Window.partitionBy("idx", "triplet").orderBy("rank", lot, "model")
    return t.withColumn("n", F.row_number().over(w)).where("n = 1").select("idx.*", "triplet", "model")


@query(f"WITH {RANKINGS} SELECT idx, user_id, model FROM r QUALIFY row_number() OVER (PARTITION BY idx, user_id ORDER BY rank, md5(concat('5:', idx, '-', user_id, '-', model)), model) = 1")
def win_best_random(spark, d):
    lot = sampling.lot(F.concat_ws("-", "idx", "user_id", "model"), 5)
    w = Window.partitionBy("idx", "user_id").orderBy("rank", lot, "model")
    return rankings(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("idx", "user_id", "model")


@query("SELECT user_id, dense_rank() OVER (ORDER BY first_seen, user_id) - 1 AS uid FROM (SELECT user_id, min(ts) AS first_seen FROM events GROUP BY 1)")
def win_dense_user_id(spark, d):
    from attune.operators.ordering import row_index

    first = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    return row_index(first, [F.col("first_seen"), F.col("user_id")], "uid").select("user_id", "uid")


@query("SELECT l_orderkey, l_linenumber, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_last FROM lineitem")
def win_last_step(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))).alias("is_last"))


@query("SELECT l_orderkey, l_linenumber, l_quantity > max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rises FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity)")
def win_repetition_prev(spark, d):
    """Each step against the maximum of all steps before it."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    return l.select("l_orderkey", "l_linenumber", (F.col("q") > F.max("q").over(w)).alias("rises"))


@query(f"WITH {RANKINGS}, w AS (SELECT idx, user_id FROM r GROUP BY ALL HAVING count(*) = 9) SELECT model, sum(5 - rank)::BIGINT AS points FROM r JOIN w USING (idx, user_id) GROUP BY 1")
def agg_points(spark, d):
    return ranks.points(rankings(spark, d), ["idx", "user_id"], "model", "rank", 5, size=9)


@query(f"WITH {RANKINGS}, {CORPUS} SELECT source, model, grouping(source)::INT AS total, sum(5 - rank)::BIGINT AS points FROM r JOIN c USING (idx) GROUP BY GROUPING SETS ((source, model), (model))")
def agg_points_by_source(spark, d):
    j = rankings(spark, d).join(corpus(spark, d).select("idx", "source"), "idx")
    return j.groupingSets([[F.col("source"), F.col("model")], [F.col("model")]], "source", "model").agg(F.grouping("source").cast("int").alias("total"), F.sum(5 - F.col("rank")).cast("long").alias("points"))


@query(f"WITH {RANKINGS}, s AS (SELECT idx, model, sum(6 - rank)::BIGINT AS score FROM r GROUP BY ALL) SELECT idx, model, score, dense_rank() OVER (PARTITION BY idx ORDER BY score DESC)::INT AS place FROM s")
def agg_borda5(spark, d):
    return ranks.borda(rankings(spark, d), "idx", "model", "rank", 6)


@query(f"WITH {RANKINGS} SELECT model, sum(4 - rank)::BIGINT AS score FROM r WHERE rank <= 3 GROUP BY 1")
def agg_borda3(spark, d):
    return rankings(spark, d).where("rank <= 3").groupBy("model").agg(F.sum(4 - F.col("rank")).alias("score"))


@query(f"WITH {_BR}, s AS (SELECT idx, triplet, model, sum(rank) AS s FROM o GROUP BY ALL) SELECT idx, triplet, min(s) = max(s) AS disputed FROM s GROUP BY ALL HAVING count(*) > 1")
def agg_disagreement(spark, d):
    """A triplet is in dispute when all its models have the same sum of ranks."""
    s = _triplets(spark, d).groupBy("idx.idx", "triplet", "model").agg(F.sum("rank").alias("s"))
    return s.groupBy("idx", "triplet").agg((F.min("s") == F.max("s")).alias("disputed"), F.count("*").alias("n")).where("n > 1").drop("n")


@query(f"WITH {RANKINGS} SELECT user_id, count(DISTINCT idx) AS responses FROM r GROUP BY 1 HAVING count(DISTINCT idx) >= 20")
def agg_active_annotators(spark, d):
    return rankings(spark, d).groupBy("user_id").agg(F.countDistinct("idx").alias("responses")).where("responses >= 20")


@query(f"WITH {RANKINGS} SELECT user_id, model, count(*) AS n, avg(rank) AS mean_rank FROM r GROUP BY ALL")
def agg_split_by_user(spark, d):
    return rankings(spark, d).groupBy("user_id", "model").agg(F.count("*").alias("n"), F.avg("rank").alias("mean_rank"))


@query(f"WITH {RANKINGS}, n AS (SELECT idx, model, row_number() OVER (PARTITION BY idx ORDER BY md5(concat('13:', idx, '-', model)), model) - 1 AS p FROM (SELECT DISTINCT idx, model FROM r)), t AS (SELECT idx, model, p // 3 AS triplet FROM n), w AS (SELECT idx FROM t GROUP BY idx HAVING count(*) = 9) SELECT idx, triplet, string_agg(model, '|' ORDER BY model) AS models FROM t JOIN w USING (idx) GROUP BY idx, triplet")
def tri_build(spark, d):
    """Nine systems shuffled into three triplets per item; items without all nine are left out."""
    m = rankings(spark, d).select("idx", "model").distinct()
    w = Window.partitionBy("idx")
    n = F.row_number().over(w.orderBy(sampling.lot(F.concat_ws("-", "idx", "model"), 13), "model")) - 1
    t = m.select("idx", "model", F.floor(n / 3).alias("triplet"), F.count("*").over(w).alias("all")).where("all = 9")
    return t.groupBy("idx", "triplet").agg(F.array_join(F.array_sort(F.collect_list("model")), "|").alias("models"))


@query(f"WITH {RANKINGS} SELECT idx, model, (row_number() OVER (PARTITION BY idx ORDER BY model) - 1) // 3 AS file FROM (SELECT DISTINCT idx, model FROM r)")
def tri_regroup(spark, d):
    n = F.row_number().over(Window.partitionBy("idx").orderBy("model")) - 1
    return rankings(spark, d).select("idx", "model").distinct().select("idx", "model", F.floor(n / 3).alias("file"))
