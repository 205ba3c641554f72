"""Projections, filters, limits, set operations and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attune.operators import sampling, sets
from attune.operators.ordering import row_index
from attune.plans.base import CORPUS, GENERATIONS, battles, BATTLES, corpus, generations
from attune.plans.registry import query, table


@query("SELECT doc_id AS id, text AS sentence FROM documents")
def prj_rename_drop(spark, d):
    return table(spark, d, "documents").withColumnsRenamed({"doc_id": "id", "text": "sentence"}).drop("lang", "source", "n_chars", "author_id", "posted_at", "loaded_at")


@query("SELECT doc_id, 'documents' AS source, 'train' AS split, 1.0::DOUBLE AS label FROM documents")
def prj_const(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lit("documents").alias("source"), F.lit("train").alias("split"), F.lit(1.0).alias("label"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index FROM documents")
def prj_row_index(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("row_index"))


@query(f"WITH {CORPUS} SELECT idx, CASE WHEN label = 1.0 THEN 'Toxic' WHEN label IS NOT NULL THEN 'Non-toxic' END AS label_name FROM c")
def prj_case_label(spark, d):
    return corpus(spark, d).select("idx", F.when(F.col("label") == 1.0, "Toxic").when(F.col("label").isNotNull(), "Non-toxic").alias("label_name"))


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, (SELECT count(*) FROM orders) AS n FROM orders)
SELECT o_orderkey, CAST(least(rn // greatest(n // 8, 1), 8) AS BIGINT) AS chunk FROM n""")
def prj_chunk(spark, d):
    return sampling.chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10 AND l_discount = 0.05")
def flt_conjunction(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 10 AND l_discount = 0.05D").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND len(string_split(text, ' ')) <= 100")
def flt_max_tokens(spark, d):
    return table(spark, d, "documents").where(F.size(F.split("text", " ")) <= 100).select("doc_id")


@query("""SELECT count(*) FILTER (n > 60) AS over_60, count(*) FILTER (n > 100) AS over_100, count(*) FILTER (n > 150) AS over_150, count(*) FILTER (n > 200) AS over_200
FROM (SELECT len(string_split(text, ' ')) AS n FROM documents)""")
def flt_token_histogram(spark, d):
    n = F.when(F.col("text").isNotNull(), F.size(F.split("text", " ")))
    return table(spark, d, "documents").agg(*[F.count(F.when(n > k, 1)).alias(f"over_{k}") for k in (60, 100, 150, 200)])


@query(f"WITH {CORPUS} SELECT idx FROM c WHERE sentence IS NOT NULL AND label IS NOT NULL AND source IS NOT NULL")
def flt_notnull(spark, d):
    return corpus(spark, d).na.drop(subset=["sentence", "label", "source"]).select("idx")


@query("SELECT doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM combined_corpus)")
def flt_in_set(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "combined_corpus").select("source").distinct(), "source", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM combined_corpus c WHERE c.source = d.source)")
def flt_not_in_set(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "combined_corpus").select("source").distinct(), "source", "left_anti").select("doc_id")


@query(f"WITH {CORPUS} SELECT idx, source FROM c WHERE source <> 'neutralpool'")
def flt_source_ne(spark, d):
    return corpus(spark, d).where(F.col("source") != "neutralpool").select("idx", "source")


@query(f"""WITH {GENERATIONS} SELECT gen_id FROM g WHERE result IS NULL OR coalesce(result.paraphrase, '') IN ('', 'Model hallucinated') OR coalesce(result.reasoning, '') IN ('', 'Model hallucinated')""")
def flt_hallucinated(spark, d):
    bad = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "Model hallucinated")
    return generations(spark, d).where(F.col("result").isNull() | bad("result.paraphrase") | bad("result.reasoning")).select("gen_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def flt_recent(spark, d):
    e = table(spark, d, "events")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("last"))), F.col("ts") > F.col("last") - F.expr("INTERVAL 1 HOUR")).select("event_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND event_type NOT LIKE '%err%'")
def flt_string_contains(spark, d):
    e = table(spark, d, "events")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("last"))), F.col("ts") > F.col("last") - F.expr("INTERVAL 1 DAY")).where(~F.col("event_type").contains("err")).select("event_id")


@query(f"""WITH {BATTLES} SELECT m.idx, m.result FROM (SELECT idx, max(result) AS result FROM b GROUP BY idx) m JOIN (SELECT idx, min(result) AS r FROM b GROUP BY idx) t ON m.idx = t.idx WHERE t.r <> 0""")
def flt_gt_invalid(spark, d):
    b = battles(spark, d)
    return b.groupBy("idx").agg(F.max("result").alias("result")).join(b.groupBy("idx").agg(F.min("result").alias("r")), "idx").where("r <> 0").select("idx", "result")


@query("SELECT event_id, value FROM events WHERE event_type <> 'error'")
def flt_error_rows(spark, d):
    return table(spark, d, "events").where("event_type <> 'error'").select("event_id", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def lim_slice(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events")
def srt_by_ts(spark, d):
    return table(spark, d, "events").select("event_id", "ts", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("pos"))


@query("SELECT lang, count(*) AS n, row_number() OVER (ORDER BY avg(n_chars) DESC NULLS LAST, lang NULLS FIRST) AS place FROM documents GROUP BY lang")
def srt_nulls_last(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    return g.select("lang", "n", F.row_number().over(Window.orderBy(F.desc_nulls_last("m"), F.asc_nulls_first("lang"))).cast("long").alias("place"))


@query("""WITH o AS (SELECT * FROM (VALUES ('purchase', 1), ('click', 2), ('view', 3), ('error', 4)) t(event_type, pos))
SELECT e.event_type, count(*) AS n, coalesce(any_value(o.pos), 99) AS pos FROM events e LEFT JOIN o USING (event_type) GROUP BY e.event_type""")
def srt_custom_order(spark, d):
    order = spark.createDataFrame([("purchase", 1), ("click", 2), ("view", 3), ("error", 4)], "event_type STRING, pos INT")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(order), "event_type", "left").select("event_type", "n", F.coalesce("pos", F.lit(99)).alias("pos"))


@query("SELECT n_name, row_number() OVER (ORDER BY coalesce(CASE n_nationkey WHEN 3 THEN '0first' WHEN 7 THEN '1second' END, n_name)) AS place FROM nation")
def srt_priority(spark, d):
    priority = F.when(F.col("n_nationkey") == 3, "0first").when(F.col("n_nationkey") == 7, "1second")
    named = table(spark, d, "nation").select("n_name", F.coalesce(priority, "n_name").alias("by"))
    return row_index(named, [F.col("by")], "place").select("n_name", (F.col("place") + 1).alias("place"))


@query("SELECT source, sentence AS text FROM combined_corpus UNION ALL SELECT source, text FROM documents")
def set_union_all(spark, d):
    return table(spark, d, "combined_corpus").select("source", F.col("sentence").alias("text")).unionByName(table(spark, d, "documents").select("source", "text"))


@query("SELECT 'users' AS origin, idx, ranking IS NULL AS missing FROM paraphrasing_human_evaluation_users UNION ALL SELECT 'majority', idx, ranking IS NULL FROM paraphrasing_human_evaluation_majority_voting")
def set_union_by_file(spark, d):
    one = lambda t, name: table(spark, d, t).select(F.lit(name).alias("origin"), "idx", F.col("ranking").isNull().alias("missing"))
    return one("paraphrasing_human_evaluation_users", "users").unionByName(one("paraphrasing_human_evaluation_majority_voting", "majority"))


@query("SELECT l_shipmode_month AS month, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS flag_A, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS flag_N, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS flag_R FROM (SELECT *, month(l_shipdate) AS l_shipmode_month FROM lineitem) GROUP BY 1".replace("month(l_shipdate) AS", "CAST(month(l_shipdate) AS INT) AS"))
def set_concat_columns(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("month")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.withColumnsRenamed({f: f"flag_{f}" for f in "ANR"})


@query("SELECT idx, max_by(user_id, user_id) AS user_id FROM paraphrasing_human_evaluation_users GROUP BY idx")
def set_dict_update(spark, d):
    return sets.last_wins(table(spark, d, "paraphrasing_human_evaluation_users").select("idx", "user_id"), ["idx"], [F.col("user_id")])


@query(f"WITH {BATTLES} SELECT a AS model FROM b UNION SELECT b FROM b")
def set_distinct_union(spark, d):
    b = battles(spark, d)
    return b.select(F.explode(F.array("a", "b")).alias("model")).distinct()


@query("SELECT DISTINCT idx FROM paraphrasing_human_evaluation_users INTERSECT SELECT idx FROM reasoningannotation_majority_ratings INTERSECT SELECT idx FROM paraphrase_generation")
def set_intersect_index(spark, d):
    one = lambda t: table(spark, d, t).select("idx")
    return one("paraphrasing_human_evaluation_users").intersect(one("reasoningannotation_majority_ratings")).intersect(one("paraphrase_generation"))


@query("SELECT idx FROM combined_corpus EXCEPT SELECT idx FROM paraphrase_generation")
def set_except(spark, d):
    return sets.minus(table(spark, d, "combined_corpus").select("idx"), table(spark, d, "paraphrase_generation").select("idx"), ["idx"]).distinct()


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def dd_md5(spark, d):
    return sets.first_by_digest(table(spark, d, "documents").select("doc_id", "text"), "text", [F.col("doc_id")]).select("doc_id", "digest")


@query("SELECT gen_id, generated_at FROM paraphrase_generation QUALIFY row_number() OVER (PARTITION BY gen_id ORDER BY generated_at DESC) = 1")
def reorg_dedup(spark, d):
    return sets.last_wins(table(spark, d, "paraphrase_generation").select("gen_id", "generated_at"), ["gen_id"], [F.col("generated_at")])


@query("SELECT doc_id FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 100")
def smp_n(spark, d):
    return sampling.sample_n(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 42)


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat('7:', doc_id)), doc_id) AS pos FROM documents")
def smp_shuffle(spark, d):
    return sampling.shuffled(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 7).select("doc_id", "pos")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(concat('1:', doc_id)), doc_id) <= 5")
def smp_stratified(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 5, 1)


@query("""WITH s AS (SELECT source, count(*)::DOUBLE AS w FROM documents WHERE source IS NOT NULL GROUP BY 1), c AS (SELECT source, w, sum(w) OVER (ORDER BY source) / sum(w) OVER () AS hi FROM s),
u AS (SELECT n_nationkey, ('0x' || left(md5(concat('9:', n_nationkey)), 7))::BIGINT / 268435456.0::DOUBLE AS u FROM nation)
SELECT n_nationkey, min(source) AS source FROM u JOIN c ON u.u < c.hi AND u.u >= c.hi - c.w / (SELECT sum(w) FROM s) GROUP BY n_nationkey""".replace("JOIN c ON u.u < c.hi AND u.u >= c.hi - c.w / (SELECT sum(w) FROM s)", "JOIN c ON u.u < c.hi"))
def smp_weighted_pair(spark, d):
    weights = table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").cast("double").alias("w"))
    return sampling.weighted_draw(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", weights, "source", "w", 9)


@query("SELECT idx, coalesce(CASE WHEN len(paraphrase) > 0 THEN paraphrase[1 + ('0x' || left(md5(concat('3:', idx)), 7))::BIGINT % len(paraphrase)] END, '') AS choice FROM (SELECT DISTINCT idx, paraphrase FROM combined_corpus)")
def smp_choice_from_list(spark, d):
    return table(spark, d, "combined_corpus").select("idx", "paraphrase").distinct().select("idx", sampling.choice(F.col("paraphrase"), F.col("idx"), 3).alias("choice"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) <= (SELECT count(*) FROM documents) * (100 - 30) // 100 THEN 'original' ELSE 'perturbed' END AS version FROM documents")
def smp_percent_restore(spark, d):
    return sampling.restore_percent(table(spark, d, "documents").select("doc_id"), "doc_id", 30, 42)


@query("SELECT d.doc_id, CASE WHEN i.item_id IS NULL THEN 'perturbed' ELSE 'original' END AS version FROM documents d LEFT JOIN (SELECT DISTINCT item_id FROM evaluation_items) i ON d.doc_id = i.item_id")
def smp_ids_restore(spark, d):
    ids = table(spark, d, "evaluation_items").select(F.col("item_id").cast("long").alias("doc_id")).distinct()
    return sampling.restore_ids(table(spark, d, "documents").select("doc_id"), "doc_id", ids)
