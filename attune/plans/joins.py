"""Joins by key, lookups, interval containment and list intersections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attune.operators import joins
from attune.operators.ordering import row_index
from attune.plans.base import CORPUS, GENERATIONS, RANKINGS, corpus, generations, rankings
from attune.plans.registry import query, table


@query(f"WITH {CORPUS}, {GENERATIONS} SELECT g.gen_id, g.model, c.source, c.label FROM g JOIN c ON g.idx = c.idx")
def jn_inner_idx(spark, d):
    g = generations(spark, d).select("gen_id", "idx", "model")
    return g.join(corpus(spark, d).select("idx", "source", "label"), "idx").drop("idx")


@query("""SELECT event_type, count(*) AS all_time, count(*) FILTER (ts > m - INTERVAL 1 DAY) AS last_day, count(*) FILTER (ts > m - INTERVAL 1 HOUR) AS last_hour
FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1 HAVING count(*) FILTER (ts > m - INTERVAL 1 HOUR) > 0""")
def jn_multiway_counts(spark, d):
    """Counts of several recent windows in one pass; values absent from the last hour drop out."""
    e = table(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("m"))))
    since = lambda x: F.count(F.when(F.col("ts") > F.col("m") - F.expr(f"INTERVAL {x}"), 1))
    return e.groupBy("event_type").agg(F.count("*").alias("all_time"), since("1 DAY").alias("last_day"), since("1 HOUR").alias("last_hour")).where("last_hour > 0")


@query(f"WITH {CORPUS} SELECT v.id, coalesce(f.idx, -1) AS idx FROM (SELECT DISTINCT id, sentence FROM paraphrase_vectors) v LEFT JOIN (SELECT sentence, min(idx) AS idx FROM c GROUP BY 1) f USING (sentence)")
def jn_lookup_first(spark, d):
    v = table(spark, d, "paraphrase_vectors").select("id", "sentence").distinct()
    return joins.lookup_first(v, corpus(spark, d).select("idx", "sentence"), "sentence", "idx").select("id", F.coalesce("idx", F.lit(-1)).alias("idx"))


@query(f"WITH {RANKINGS}, {CORPUS} SELECT r.idx, user_id, model, source FROM r LEFT JOIN c USING (idx)")
def jn_lookup_source(spark, d):
    return rankings(spark, d).join(corpus(spark, d).select("idx", "source"), "idx", "left").select("idx", "user_id", "model", "source")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jn_lookup_strict(spark, d):
    """A lookup that must find every key; an unknown key fails the job."""
    return joins.lookup_strict(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "c_name").select("o_orderkey", "c_name")


@query(f"WITH {GENERATIONS}, {CORPUS} SELECT 'hit' AS kind, count(*) AS n FROM g WHERE idx IN (SELECT idx FROM c WHERE paraphrase IS NOT NULL) UNION ALL SELECT 'miss', count(*) FROM g WHERE idx NOT IN (SELECT idx FROM c WHERE paraphrase IS NOT NULL)")
def jn_reasoning_by_key(spark, d):
    g, c = generations(spark, d).select("idx"), corpus(spark, d).where("paraphrase IS NOT NULL").select("idx")
    one = lambda how, name: g.join(c, "idx", how).agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return one("left_semi", "hit").unionByName(one("left_anti", "miss"))


@query("SELECT concat_ws(chr(9), l_orderkey, l_linenumber) AS k, count(*) AS n FROM lineitem GROUP BY 1")
def jn_composite_key(spark, d):
    """Keys of all lines."""
    return table(spark, d, "lineitem").groupBy(F.concat_ws("\t", "l_orderkey", "l_linenumber").alias("k")).agg(F.count("*").alias("n"))


@query(f"WITH {RANKINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY idx, user_id ORDER BY model) AS pos FROM r) SELECT a.idx, a.pos, a.model, a.rank AS rank_a, b.rank AS rank_b, a.user_id AS user_a, b.user_id AS user_b FROM p a JOIN p b ON a.idx = b.idx AND a.pos = b.pos AND a.model = b.model AND a.user_id < b.user_id")
def jn_positional(spark, d):
    """Frames aligned by position: a keyed join on (item, position), with the position made explicit."""
    p = rankings(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("idx", "user_id").orderBy("model")).cast("long"))
    side = lambda s: p.select("idx", "pos", "model", F.col("rank").alias(f"rank_{s}"), F.col("user_id").alias(f"user_{s}"))
    return side("a").join(side("b"), ["idx", "pos", "model"]).where("user_a < user_b")


@query(f"WITH {GENERATIONS}, a AS (SELECT idx, min(gen_id) AS ga, any_value(sentence ORDER BY gen_id) AS s FROM g GROUP BY idx), b AS (SELECT idx, max(gen_id) AS gb, max_by(sentence, gen_id) AS t FROM g GROUP BY idx) SELECT coalesce(a.idx, b.idx) AS idx, ga, gb, min_s IS NOT DISTINCT FROM t AS same FROM (SELECT idx, ga, (SELECT sentence FROM g WHERE g.gen_id = ga) AS min_s FROM a) a FULL JOIN b ON a.idx = b.idx")
def jn_zip_assert(spark, d):
    """Two answer files by question with a check that the question is the same."""
    g = generations(spark, d).select("idx", "gen_id", "sentence")
    a = g.groupBy("idx").agg(F.min_by(F.struct("gen_id", "sentence"), "gen_id").alias("a"))
    b = g.groupBy("idx").agg(F.max_by(F.struct("gen_id", "sentence"), "gen_id").alias("b"))
    return a.join(b, "idx", "full").select("idx", F.col("a.gen_id").alias("ga"), F.col("b.gen_id").alias("gb"), F.col("a.sentence").eqNullSafe(F.col("b.sentence")).alias("same"))


@query("SELECT i.item_id, d.doc_id, row_number() OVER (ORDER BY i.item_id) - 1 AS question_id FROM (SELECT DISTINCT item_id FROM evaluation_items) i JOIN documents d ON i.item_id = d.doc_id")
def jn_dict_key_merge(spark, d):
    i = table(spark, d, "evaluation_items").select("item_id").distinct()
    j = i.join(table(spark, d, "documents").select("doc_id"), F.col("item_id") == F.col("doc_id"))
    return row_index(j, [F.col("item_id")], "question_id")


@query(f"WITH {CORPUS}, {GENERATIONS}, {RANKINGS}, h AS (SELECT idx, avg(rank) AS human FROM r GROUP BY 1), k AS (SELECT idx, count(*) AS answers FROM g GROUP BY 1) SELECT c.idx, human, answers, label FROM c JOIN h USING (idx) JOIN k USING (idx) WHERE c.idx % 10 <> 0")
def jn_score_merge(spark, d):
    h = rankings(spark, d).groupBy("idx").agg(F.avg("rank").alias("human"))
    k = generations(spark, d).groupBy("idx").agg(F.count("*").alias("answers"))
    removed = corpus(spark, d).where("idx % 10 = 0").select("idx")
    return corpus(spark, d).select("idx", "label").join(h, "idx").join(k, "idx").join(removed, "idx", "left_anti").select("idx", "human", "answers", "label")


@query("SELECT a.l_orderkey, count(*) AS pairs, max(a.l_quantity * b.l_discount) AS top FROM lineitem a JOIN lineitem b USING (l_orderkey) GROUP BY 1")
def jn_cartesian(spark, d):
    """Step by step products inside a group, including a step with itself: in the row, no self-join."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("c"))
    return g.select("l_orderkey", (F.col("n") * F.col("n")).alias("pairs"), (F.col("q") * F.col("c")).alias("top"))


@query("""WITH t AS (SELECT doc_id, unnest(list_transform(range(0, greatest(length(text) // 5, 1)), lambda i: i * 5)) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (s >= 20 AND s + 5 <= 60) AS inside FROM t GROUP BY 1""")
def jn_interval_contain(spark, d):
    """Token intervals inside a word interval, counted in the row."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length("text") / 5), F.lit(1)) - 1), lambda i: F.struct((i * 5).alias("s"), (i * 5 + 5).alias("e"))).alias("t"))
    return t.select("doc_id", F.size(joins.contained(F.col("t"), F.lit(20), F.lit(60))).cast("long").alias("inside"))


@query(f"WITH {CORPUS}, w AS (SELECT idx, list_filter(paraphrase, lambda x: x IS NOT NULL) AS p FROM c) SELECT idx, len(list_intersect(list_distinct(string_split(p[1], ' ')), list_distinct(string_split(p[2], ' '))))::BIGINT AS shared FROM w WHERE len(p) >= 2")
def jn_list_intersection(spark, d):
    """Values present in all lists (here: words of the first two rewrites)."""
    p = corpus(spark, d).select("idx", F.array_compact("paraphrase").alias("p")).where(F.size("p") >= 2)
    lists = F.transform(F.slice("p", 1, 2), lambda t: F.split(t, " "))
    return p.select("idx", F.size(joins.in_every(lists)).cast("long").alias("shared"))


@query("SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag || '' WHERE a.l_returnflag = 'A' GROUP BY ALL")
def jn_reversed_dirs(spark, d):
    """Pairs of a name and its reversed run by the stripped name."""
    f = table(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", F.lit("run").alias("name"))
    r = table(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", F.lit("run_reversed").alias("name"))
    return joins.with_reversed(f, r, "name", ["l_orderkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
