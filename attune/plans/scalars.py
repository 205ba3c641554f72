"""Dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attune.functions import scalars as S
from attune.functions.python_text import parse_literal
from attune.plans.base import CORPUS, GENERATIONS, RANKINGS, corpus, generations, rankings
from attune.plans.registry import query, table


@query("SELECT event_id, strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d %H:%M:%S') AS local FROM events")
def dt_epoch_pacific(spark, d):
    return table(spark, d, "events").select("event_id", S.local_time(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).alias("local"))


@query("SELECT i AS hour, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(i), '%Y-%m-%d %H:%M') AS label FROM (SELECT unnest(range(0, 24)) AS i)")
def dt_add_hours_label(spark, d):
    return spark.range(24).select(F.col("id").alias("hour"), F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int")), "yyyy-MM-dd HH:mm").alias("label"))


@query("SELECT event_id, CASE WHEN value >= 70 THEN 1.0 ELSE 0.0 END::DOUBLE AS strict, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS loose FROM events")
def mth_threshold(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v >= 70, 1.0).otherwise(0.0).alias("strict"), F.when(v > 50, 1.0).otherwise(0.0).alias("loose"))


@query("SELECT l_suppkey, CASE WHEN abs(r) < 1 THEN atanh(r) END AS z FROM (SELECT l_suppkey, corr(l_quantity, l_discount) AS r FROM lineitem GROUP BY 1)")
def mth_fisher_z(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_discount").alias("r"))
    return r.select("l_suppkey", S.fisher_z(F.col("r")).alias("z"))


@query("SELECT l_suppkey, tanh(2 * corr(l_quantity, l_discount)) AS r FROM lineitem GROUP BY 1")
def mth_inv_fisher(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(S.inverse_fisher(2 * F.corr("l_quantity", "l_discount")).alias("r"))


@query("SELECT o_orderkey, floor(o_totalprice / 1000 + 0.5)::BIGINT AS half_up, round_even(o_totalprice / 1000, 1) AS even FROM orders")
def mth_round(spark, d):
    x = F.col("o_totalprice") / 1000
    return table(spark, d, "orders").select("o_orderkey", S.half_up(x).alias("half_up"), F.bround(x, 1).alias("even"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INT AS n, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::DOUBLE)), 6) AS s FROM embeddings")
def arr_filter_positive(spark, d):
    p = S.keep_positive(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.size(p).alias("n"), F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("s"))


@query(f"WITH {RANKINGS}, m AS (SELECT idx, user_id, model, (rank <= 2)::INT AS pred FROM r WHERE model IN ('human', 'softpara', 'lumen-o1')), l AS (SELECT idx, user_id, (idx % 2)::INT AS label, count(*) FILTER (pred = idx % 2) AS a FROM m GROUP BY idx, user_id) SELECT m.idx, m.user_id, string_agg(model, '|' ORDER BY model) AS models FROM m JOIN l ON m.idx = l.idx AND m.user_id = l.user_id WHERE a = 0 OR pred = label GROUP BY ALL")
def arr_vote_or_all(spark, d):
    m = rankings(spark, d).where(F.col("model").isin("human", "softpara", "lumen-o1"))
    g = m.groupBy("idx", "user_id").agg(F.array_sort(F.collect_list(F.struct("model", (F.col("rank") <= 2).cast("int").alias("pred")))).alias("m"))
    return g.select("idx", "user_id", F.array_join(F.transform(S.votes_or_all(F.col("m"), (F.col("idx") % 2).cast("int")), lambda x: x["model"]), "|").alias("models"))


@query("SELECT vec_id, list_max(list_transform(embedding[5:8], lambda x: x::DOUBLE)) AS top FROM embeddings")
def arr_word_max(spark, d):
    t = F.transform("embedding", lambda x, i: F.struct((i * 4).alias("s"), (i * 4 + 4).alias("e"), x.cast("double").alias("v")))
    return table(spark, d, "embeddings").select("vec_id", S.word_max(t, F.lit(16), F.lit(32)).alias("top"))


@query("SELECT vec_id, least(len(string_split('a,,b,c,,d', ',')), len(embedding))::INT - 2 AS n FROM embeddings")
def arr_zip_skip_empty(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(S.zip_skip_empty(F.split(F.lit("a,,b,c,,d"), ","), F.col("embedding"))).alias("n"))


@query(f"WITH {CORPUS} SELECT idx, unnest(paraphrase) AS rewrite FROM c")
def arr_explode(spark, d):
    return corpus(spark, d).select("idx", F.explode("paraphrase").alias("rewrite"))


@query(f"WITH {CORPUS} SELECT idx, unnest(range(0, len(paraphrase)))::INT AS pos, unnest(paraphrase) AS rewrite FROM c")
def arr_posexplode(spark, d):
    return corpus(spark, d).select("idx", F.posexplode("paraphrase").alias("pos", "rewrite"))


@query("SELECT vec_id, ((len(embedding) + 4) // 5)::INT AS groups, list_sum(list_transform(embedding[6:10], lambda x: x::DOUBLE)) AS second FROM embeddings")
def arr_regroup_n(spark, d):
    g = S.regroup(F.col("embedding"), 5)
    return table(spark, d, "embeddings").select("vec_id", F.size(g).alias("groups"), F.aggregate(F.get(g, 1), F.lit(0.0), lambda a, x: a + x.cast("double")).alias("second"))


@query(f"WITH {CORPUS} SELECT idx, (len(paraphrase) * (len(paraphrase) - 1) // 2)::BIGINT AS pairs FROM c WHERE paraphrase IS NOT NULL")
def arr_triu(spark, d):
    """Pairs of a list's elements (here: of the rewrites)."""
    c = corpus(spark, d).where("paraphrase IS NOT NULL")
    return c.select("idx", F.size(S.upper_triangle(F.col("paraphrase"))).cast("long").alias("pairs"))


_M = "m AS (SELECT idx, ranking FROM paraphrasing_human_evaluation_majority_voting QUALIFY row_number() OVER (PARTITION BY idx) = 1)"


def _m(spark, d):
    return table(spark, d, "paraphrasing_human_evaluation_majority_voting").dropDuplicates(["idx"])


@query(f"WITH {_M}, e AS (SELECT idx, unnest(map_entries(ranking)) AS e FROM m) SELECT idx, string_agg(e.key, '|' ORDER BY e.value, e.key) AS models FROM e GROUP BY 1")
def map_sort_by_value(spark, d):
    return _m(spark, d).where("ranking IS NOT NULL").select("idx", F.array_join(F.transform(S.entries_by_value(F.col("ranking")), lambda e: e["key"]), "|").alias("models"))


@query(f"WITH {_M}, e AS (SELECT idx, unnest(map_entries(ranking)) AS e FROM m) SELECT idx, string_agg(e.value::VARCHAR, '|' ORDER BY e.key) AS ranks FROM e GROUP BY 1")
def map_sort_by_key(spark, d):
    return _m(spark, d).where("ranking IS NOT NULL").select("idx", F.array_join(F.transform(S.entries_by_key(F.col("ranking")), lambda e: e["value"].cast("string")), "|").alias("ranks"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'softpara' ELSE 'lumen-o1' END AS model FROM nation")
def map_rename_values(spark, d):
    m = F.create_map(*[F.lit(x) for x in ("response-1", "human", "response-2", "softpara", "response-3", "lumen-o1")])
    return table(spark, d, "nation").select("n_nationkey", m[F.concat(F.lit("response-"), (F.col("n_nationkey") % 3 + 1).cast("string"))].alias("model"))


@query(f"WITH {_M}, e AS (SELECT idx, unnest(map_entries(ranking)) AS e FROM m) SELECT idx, sum(CASE WHEN e.key = 'human' THEN 0 ELSE e.value END)::BIGINT AS total FROM e GROUP BY 1")
def map_update(spark, d):
    u = S.updated(F.col("ranking"), F.create_map(F.lit("human"), F.lit(0)))
    return _m(spark, d).where("ranking IS NOT NULL").select("idx", F.aggregate(F.map_values(u), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {GENERATIONS} SELECT gen_id, result.reasoning = '' OR result.paraphrase = '' AS empty FROM g WHERE result.reasoning IS NOT NULL AND result.paraphrase IS NOT NULL")
def map_any_empty(spark, d):
    g = generations(spark, d).where("result.reasoning IS NOT NULL AND result.paraphrase IS NOT NULL")
    return g.select("gen_id", S.any_empty(F.create_map(F.lit("reasoning"), "result.reasoning", F.lit("paraphrase"), "result.paraphrase")).alias("empty"))


@query("SELECT event_id, coalesce((props->>'k')::INT, -1) AS k, coalesce(props->>'model', '') AS model FROM events")
def jsn_get_default(spark, d):
    p = table(spark, d, "events").select("event_id", F.from_json("props", "k INT, model STRING").alias("p"))
    return p.select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"), F.coalesce("p.model", F.lit("")).alias("model"))


@query(f"WITH {CORPUS} SELECT idx, string_agg(CASE (i - 2) % 2 WHEN 0 THEN 'user' ELSE 'assistant' END, '|' ORDER BY i) AS roles FROM (SELECT idx, unnest(range(1, len(paraphrase) + 1)) AS i FROM c) WHERE i > 1 GROUP BY 1")
def jsn_restructure(spark, d):
    c = corpus(spark, d).where(F.size("paraphrase") > 1)
    return c.select("idx", F.array_join(F.transform(S.turns(F.col("paraphrase"), 1), lambda t: t["role"]), "|").alias("roles"))


@query(f"WITH {CORPUS} SELECT idx, pos::INT AS pos, q FROM (SELECT idx, unnest(range(1, len(paraphrase) + 1)) AS pos, unnest(paraphrase) AS q FROM c) WHERE pos <= 3 AND len(string_split(q, ' ')) < 12 ORDER BY idx, pos LIMIT 250")
def jsn_flatten_qa(spark, d):
    """Nested questions as rows: at most three an item, short ones only, at most 250 rows (the caps are the feature)."""
    q = corpus(spark, d).select("idx", F.posexplode("paraphrase").alias("pos", "q")).withColumn("pos", F.col("pos") + 1)
    return q.where((F.col("pos") <= 3) & (F.size(F.split("q", " ")) < 12)).orderBy("idx", "pos").limit(250)


@query()
def src_py_literal(spark, d):
    """Cells written as Python literals, read without evaluating them."""
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("['"), "n_name", F.lit("', 'x']")).alias("cell"))
    return n.select("n_nationkey", parse_literal("cell").alias("values"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey * 1.5::DOUBLE END AS score, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE round(n_nationkey / 100.0::DOUBLE * 100, 1) END AS mmlu FROM nation")
def src_leaderboard_csv(spark, d):
    """Cells of a leaderboard: '-' is null, percentages lose their sign, fractions become percent."""
    from attune.sources.readers import leaderboard_value

    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.when(k % 5 == 0, "-").otherwise(F.concat((k * 1.5).cast("string"), F.lit("%"))).alias("score"), F.when(k % 5 == 0, "-").otherwise((k / 100.0).cast("string")).alias("mmlu"))
    return n.select("n_nationkey", leaderboard_value(F.col("score")).alias("score"), F.round(leaderboard_value(F.col("mmlu")) * 100, 1).alias("mmlu"))


@query("WITH s AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, CASE dense_rank() OVER (PARTITION BY l_returnflag ORDER BY m DESC) WHEN 1 THEN 'bold' WHEN 2 THEN 'underline' END AS mark FROM s")
def snk_latex(spark, d):
    """The best two per column of a table to print."""
    s = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("m"))
    r = F.dense_rank().over(Window.partitionBy("l_returnflag").orderBy(F.desc("m")))
    return s.select("l_returnflag", "l_linestatus", F.when(r == 1, "bold").when(r == 2, "underline").alias("mark"))


@query("SELECT l_suppkey, CASE WHEN c IS NULL THEN '-' WHEN p < 0.05 THEN printf('%.3f', c) || '†' ELSE printf('%.3f', c) END AS cell FROM (SELECT l_suppkey, avg(l_discount) AS c, avg(l_tax) + 0.01 AS p FROM lineitem GROUP BY 1)")
def snk_sig_marker(spark, d):
    from attune.sources.sinks import marked

    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("c"), (F.avg("l_tax") + 0.01).alias("p"))
    return s.select("l_suppkey", marked(F.col("c"), F.col("p")).alias("cell"))


@query("SELECT idx, user_id, 1 AS one FROM paraphrasing_human_evaluation_users")
def snk_ordered_columns(spark, d):
    from attune.sources.sinks import ordered

    return ordered(table(spark, d, "paraphrasing_human_evaluation_users").select(F.lit(1).alias("one"), "user_id", "idx"), ["idx", "user_id", "missing", "one"])


def _round_trip(spark, df, write, read):
    """Write to the shared folder and read again, for the sources and sinks."""
    import uuid

    from attune.storage import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/trip-{uuid.uuid4().hex}"
    write(df, path)
    return read(path)


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(_NATION)
def src_csv(spark, d):
    from attune.sources import readers, sinks

    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return _round_trip(spark, n, sinks.write_csv, lambda p: readers.read_csv(spark, p, n.schema))


@query(_NATION)
def src_tsv(spark, d):
    from attune.sources import readers, sinks

    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return _round_trip(spark, n, lambda x, p: sinks.write_csv(x, p, sep="\t"), lambda p: readers.read_csv(spark, p, n.schema, sep="\t"))


@query("SELECT idx, sentence, paraphrase FROM combined_corpus")
def src_jsonl(spark, d):
    from attune.sources import readers, sinks

    c = table(spark, d, "combined_corpus").select("idx", "sentence", "paraphrase")
    return _round_trip(spark, c, sinks.write_jsonl, lambda p: readers.read_jsonl(spark, p, c.schema))


@query("SELECT n_nationkey, n_name FROM nation")
def src_json_doc(spark, d):
    """One JSON document keyed by id, written and read as rows."""
    from attune.sources import readers, sinks

    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    doc = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))).alias("value"))
    out = _round_trip(spark, doc, sinks.write_text, lambda p: readers.read_json_map(spark, p, "string"))
    return out.select(F.col("key").cast("int").alias("n_nationkey"), F.col("value").alias("n_name"))


@query("SELECT n_nationkey AS ID, (n_nationkey * 0.5)::DOUBLE AS score FROM nation")
def src_ws_table(spark, d):
    """A blank-aligned score table."""
    from attune.sources import readers, sinks

    n = table(spark, d, "nation").select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 6, " "), F.lit("   "), F.lpad((F.col("n_nationkey") * 0.5).cast("string"), 10, " ")).alias("value"))
    return _round_trip(spark, n, sinks.write_text, lambda p: readers.read_aligned(spark, p, [("ID", "int"), ("score", "double")], header=False))


@query("SELECT DISTINCT lower(trim(word)) AS word FROM profanity_wordlist WHERE trim(word) <> ''")
def src_wordlist(spark, d):
    from attune.sources import readers, sinks

    w = table(spark, d, "profanity_wordlist").where("word IS NOT NULL").select(F.concat(F.lit(" "), "word").alias("value"))
    return _round_trip(spark, w, sinks.write_text, lambda p: readers.read_words(spark, p)).select(F.lower("word").alias("word")).distinct()


@query("SELECT n_regionkey, 'model' || n_regionkey AS model, count(*) AS n FROM nation GROUP BY 1")
def src_glob_tagged(spark, d):
    """Files of a folder with the model's name taken from the file path."""
    from attune.sources import readers

    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("model"), "n_regionkey").alias("part"))
    out = _round_trip(spark, n, lambda x, p: x.write.partitionBy("part").json(p), lambda p: readers.read_tagged(spark, p, "n_nationkey INT, n_regionkey INT", r"part=([^/]+)", "model"))
    return out.groupBy("n_regionkey", "model").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def src_positional_csv(spark, d):
    from attune.sources import readers, sinks

    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return _round_trip(spark, n, lambda x, p: sinks.write_csv(x, p, header=False), lambda p: readers.read_positional(spark, p, {"id": ("int", 0), "name": ("string", 1)}))


@query("SELECT n_nationkey, n_name FROM nation")
def src_xml(spark, d):
    from attune.sources import readers, sinks

    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return _round_trip(spark, n, sinks.write_xml, lambda p: readers.read_xml(spark, p, n.schema))


@query("SELECT source, avg(n_chars) AS mean, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def snk_partition_by_source(spark, d):
    """One metrics file per source."""
    m = table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.avg("n_chars").alias("mean"), F.count("*").alias("n"))
    return _round_trip(spark, m, lambda x, p: x.write.partitionBy("source").parquet(p), lambda p: spark.read.schema("mean DOUBLE, n BIGINT, source STRING").parquet(p))


@query("SELECT gen_id, model, generated_at FROM paraphrase_generation QUALIFY row_number() OVER (PARTITION BY gen_id ORDER BY generated_at DESC) = 1")
def snk_append_answer(spark, d):
    """Appended answers, compacted to the last one per key."""
    from attune.operators.sets import last_wins

    g = table(spark, d, "paraphrase_generation").select("gen_id", "model", "generated_at")
    out = _round_trip(spark, g, lambda x, p: (x.where("gen_id % 2 = 0").write.mode("append").parquet(p), x.where("gen_id % 2 = 1").write.mode("append").parquet(p)), lambda p: spark.read.schema(g.schema).parquet(p))
    return last_wins(out, ["gen_id"], [F.col("generated_at")])


@query("SELECT idx, model, label FROM (SELECT DISTINCT gen_id, idx, model, label FROM paraphrase_generation)")
def snk_csv(spark, d):
    from attune.sources import readers, sinks

    g = table(spark, d, "paraphrase_generation").select("gen_id", "idx", "model", "label").distinct().drop("gen_id")
    return _round_trip(spark, g, sinks.write_csv, lambda p: readers.read_csv(spark, p, g.schema))


@query("SELECT gen_id, result.reasoning AS reasoning, shap_values FROM paraphrase_generation")
def snk_jsonl(spark, d):
    from attune.sources import readers, sinks

    g = table(spark, d, "paraphrase_generation").select("gen_id", F.col("result.reasoning").alias("reasoning"), "shap_values")
    return _round_trip(spark, g, sinks.write_jsonl, lambda p: readers.read_jsonl(spark, p, g.schema))


@query("SELECT n_nationkey, n_name FROM nation")
def snk_json_records(spark, d):
    """One document that is an array of records."""
    from attune.sources import readers, sinks

    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    doc = n.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    return _round_trip(spark, doc, sinks.write_text, lambda p: readers.read_json_array(spark, p, n.schema))


@query("""SELECT * FROM (VALUES (0, '| n_nationkey | n_name | n_regionkey |'), (1, '|---|---|---|')) h(line, text)
UNION ALL SELECT 1 + row_number() OVER (ORDER BY n_nationkey), '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' FROM nation""")
def snk_markdown(spark, d):
    """A report as a Markdown table, line by line."""
    from attune.sources.sinks import markdown

    text = markdown(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line BIGINT, text STRING")


@query("SELECT 'rewrite' AS name, 'Rewrite.' || chr(10) || 'Keep the meaning.' AS template")
def src_yaml_prompt(spark, d):
    """Prompt templates of a small configuration file, written line ends resolved."""
    from attune.sources.readers import parse_prompts

    return spark.createDataFrame(sorted(parse_prompts("# prompts\nrewrite: 'Rewrite.\\\\nKeep the meaning.'\n").items()), "name STRING, template STRING")


@query("SELECT * FROM (VALUES ('grammar', 'GRAM'), ('factuality', 'FACT'), ('hallucination', 'HALL'), ('redundancy', 'RED'), ('repetition', 'REP'), ('missing_step', 'MISS'), ('logical_deduction', 'LOGIC'), ('commonsense', 'COMMON'), ('arithmetic', 'MATH'), ('quality', 'QUAL'), ('coherency', 'COH')) t(label, short)")
def st_levels(spark, d):
    """Short names of annotation labels."""
    from attune.operators.chains import SHORT_NAMES

    return spark.createDataFrame(sorted(SHORT_NAMES.items()), "label STRING, short STRING")


@query("""WITH w AS (SELECT s_suppkey AS worker, s_acctbal + 1000 AS speed FROM supplier WHERE s_acctbal > -999), c AS (SELECT worker, sum(speed) OVER (ORDER BY worker) / sum(speed) OVER () AS hi FROM w),
u AS (SELECT n_nationkey, ('0x' || left(md5(concat('23:', n_nationkey)), 7))::BIGINT / 268435456.0::DOUBLE AS u FROM nation) SELECT n_nationkey, min(worker) AS worker FROM u JOIN c ON u < hi GROUP BY 1""")
def smp_lottery(spark, d):
    """A worker drawn in proportion to its speed."""
    from attune.operators.sampling import weighted_draw

    w = table(spark, d, "supplier").where("s_acctbal > -999").select(F.col("s_suppkey").alias("worker"), (F.col("s_acctbal") + 1000).alias("speed"))
    return weighted_draw(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", w, "worker", "speed", 23)
