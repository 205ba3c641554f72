"""Similarity of texts and vectors, retrieval, and chain scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from attune.operators import chains, pairs, similarity
from attune.plans.base import CORPUS, GENERATIONS, corpus, generations
from attune.plans.registry import query, table

_PAIR = f"{GENERATIONS}, t AS (SELECT gen_id, paraphrase AS ref, result.paraphrase AS cand FROM g WHERE paraphrase IS NOT NULL AND result.paraphrase IS NOT NULL)"
_TOK = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


def _texts(spark, d):
    g = generations(spark, d).where("paraphrase IS NOT NULL AND result.paraphrase IS NOT NULL")
    return g.select("gen_id", F.col("paraphrase").alias("ref"), F.col("result.paraphrase").alias("cand"))


def _grams(n):
    tok = lambda c: _TOK.format(c)
    gram = lambda c: f"list_transform(range(1, len({tok(c)}) - {n} + 2), lambda i: array_to_string({tok(c)}[i:i + {n - 1}], ' '))"
    return f"""x{n} AS (SELECT gen_id, g, sum(a) AS x, sum(b) AS y FROM (SELECT gen_id, unnest({gram('ref')}) AS g, 1 AS a, 0 AS b FROM t UNION ALL SELECT gen_id, unnest({gram('cand')}), 0, 1 FROM t) GROUP BY ALL),
o{n} AS (SELECT gen_id, sum(x)::DOUBLE AS na, sum(y)::DOUBLE AS nb, sum(least(x, y))::DOUBLE AS both FROM x{n} GROUP BY 1)"""


@query()
def sim_levenshtein(spark, d):
    """By characters; the SQL side counts bytes, so brute force checks it in the tests."""
    return _texts(spark, d).select("gen_id", F.levenshtein("ref", "cand").alias("distance"))


@query("""WITH p AS (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.vec_id < 200 AND b.vec_id < 200)
SELECT label, avg(c) AS mean, stddev_pop(c) AS std, min(c) AS low, max(c) AS high FROM p GROUP BY 1""".replace(" WHERE a.vec_id < 200 AND b.vec_id < 200", ""))
def sim_cosine_pairs(spark, d):
    """Cosines of all pairs inside a label: mean, deviation and extremes."""
    return similarity.pairwise_summary(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query(f"WITH {_PAIR}, {_grams(1)}, {_grams(2)}, f AS (SELECT o1.gen_id, CASE WHEN o1.both > 0 THEN 2 * (o1.both / o1.na) * (o1.both / o1.nb) / (o1.both / o1.na + o1.both / o1.nb) ELSE 0 END AS rouge1, CASE WHEN o2.both > 0 THEN 2 * (o2.both / o2.na) * (o2.both / o2.nb) / (o2.both / o2.na + o2.both / o2.nb) ELSE 0 END AS rouge2 FROM o1 LEFT JOIN o2 USING (gen_id)) SELECT gen_id, rouge1, rouge2 FROM f")
def sim_rouge(spark, d):
    t = _texts(spark, d)
    return similarity.rouge(t, ["gen_id"], "ref", "cand", (1, 2))


@query()
def sim_rouge_l(spark, d):
    """By the longest common subsequence of words; checked against a loop in the tests."""
    return _texts(spark, d).select("gen_id", F.round(similarity.rouge_l(F.col("ref"), F.col("cand")), 9).alias("rouge_l"))


_LOGS = " + ".join(f"CASE WHEN coalesce(o{n}.nb, 0) > 0 THEN ln(CASE WHEN o{n}.both > 0 THEN o{n}.both ELSE 0.1 END / o{n}.nb) ELSE 0 END" for n in (1, 2, 3, 4))
_USED = " + ".join(f"CASE WHEN coalesce(o{n}.nb, 0) > 0 THEN 1.0 ELSE 0.0 END" for n in (1, 2, 3, 4))


@query(f"""WITH {_PAIR}, {', '.join(_grams(n) for n in (1, 2, 3, 4))}, s AS (SELECT gen_id, len({_TOK.format('ref')})::DOUBLE AS r, len({_TOK.format('cand')})::DOUBLE AS c FROM t)
SELECT s.gen_id, CASE WHEN c > 0 AND coalesce(o1.both, 0) > 0 THEN (CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / c) END) * exp(({_LOGS}) / ({_USED})) ELSE 0.0 END::DOUBLE AS bleu FROM s {' '.join(f'LEFT JOIN o{n} ON s.gen_id = o{n}.gen_id' for n in (1, 2, 3, 4))}""")
def sim_bleu(spark, d):
    return similarity.bleu(_texts(spark, d), ["gen_id"], "ref", "cand")


@query(f"""WITH {GENERATIONS}, t AS (SELECT idx, gen_id, {_TOK.format('result.paraphrase')} AS w FROM g WHERE result.paraphrase IS NOT NULL), {', '.join(f'''g{n} AS (SELECT idx, gen_id, q, count(*) AS c FROM (SELECT idx, gen_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS q FROM t) GROUP BY ALL),
p{n} AS (SELECT a.idx, a.gen_id, CASE WHEN sum(least(a.c, coalesce(m.m, 0))) > 0 THEN sum(least(a.c, coalesce(m.m, 0)))::DOUBLE ELSE 0.1 END / sum(a.c) AS p FROM g{n} a LEFT JOIN (SELECT a.idx, a.gen_id, a.q, max(b.c) AS m FROM g{n} a JOIN g{n} b ON a.idx = b.idx AND a.q = b.q AND a.gen_id <> b.gen_id GROUP BY ALL) m ON a.idx = m.idx AND a.gen_id = m.gen_id AND a.q = m.q GROUP BY ALL)''' for n in (1, 2))}
SELECT p1.idx, p1.gen_id, exp((ln(p1.p) + ln(coalesce(p2.p, 1.0))) / 2) AS self_bleu FROM p1 LEFT JOIN p2 ON p1.idx = p2.idx AND p1.gen_id = p2.gen_id""")
def sim_self_bleu(spark, d):
    g = generations(spark, d).where("result.paraphrase IS NOT NULL").select("idx", "gen_id", F.col("result.paraphrase").alias("text"))
    return similarity.self_bleu(g, ["idx"], "gen_id", "text")


@query("""WITH t AS (SELECT vec_id, list_transform(range(0, 4), lambda i: embedding[i * 16 + 1 : i * 16 + 16]::DOUBLE[]) AS w FROM embeddings), j AS (SELECT a.vec_id, a.w AS c, b.w AS r FROM t a JOIN t b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, list_avg(list_transform(c, lambda x: list_max(list_transform(r, lambda y: list_cosine_similarity(x, y))))) AS p, list_avg(list_transform(r, lambda x: list_max(list_transform(c, lambda y: list_cosine_similarity(x, y))))) AS q FROM j)
SELECT vec_id, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / (p + q), 6) AS f1 FROM s""")
def sim_bertscore(spark, d):
    """Every vector read as four token vectors against those of the next one."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16))).alias("w"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("w").alias("r")), "vec_id")
    s = j.select("vec_id", similarity.bertscore(F.col("w"), F.col("r")).alias("s"))
    return s.select("vec_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS content FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sim_content(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", similarity.cosine(F.col("embedding"), F.col("next")).alias("content"))


_TOPK = """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) AS cosine FROM embeddings, q WHERE {}),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS r FROM s), f AS (SELECT query, vec_id, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM k WHERE r <= 8 AND vec_id <> query) SELECT query, vec_id, cosine, place::INT AS place FROM f WHERE place <= 5"""


def _topk(spark, d, label):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label", F.col("vec_id").cast("string").alias("text"))
    return similarity.topk(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "text", 5, label=label)


@query(_TOPK.format("label = ql"))
def vec_topk(spark, d):
    """Nearest rows of the same label for every row whose id is divisible by 20."""
    return _topk(spark, d, "label")


@query(_TOPK.format("true"))
def vec_topk_nofilter(spark, d):
    """Nearest rows of any label for every row whose id is divisible by 20."""
    return _topk(spark, d, None)


@query("""WITH m AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE + embedding[i + 48]::DOUBLE) / 3) AS v FROM embeddings)
SELECT vec_id, list_transform(v, lambda y: round(y / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6)) AS pooled FROM m""")
def vec_l2_mean_pool(spark, d):
    """Mean of unmasked token vectors at length one: three of the four tokens of every vector."""
    part = lambda i: F.slice("embedding", 16 * i + 1, 16)
    pooled = similarity.mean_pool(F.array(*map(part, range(4))), F.array(*map(F.lit, (1, 0, 1, 1))), 16)
    return table(spark, d, "embeddings").select("vec_id", F.transform(pooled, lambda x: F.round(x, 6)).alias("pooled"))


@query("SELECT (SELECT count(*) FROM paraphrase_vectors) <> (SELECT count(*) FROM combined_corpus) AS rebuild")
def vec_upsert_check(spark, d):
    n = lambda t: table(spark, d, t).agg(F.count("*").alias("n"))
    return n("paraphrase_vectors").crossJoin(n("combined_corpus").withColumnRenamed("n", "m")).select((F.col("n") != F.col("m")).alias("rebuild"))


_STEP = "list_transform(range(0, {n}), lambda i: embedding[{o} + i * 8 + 1:{o} + i * 8 + 8]::DOUBLE[])"
_H, _C, _R = _STEP.format(n=3, o=0), _STEP.format(n=2, o=24), _STEP.format(n=2, o=40)
_AL = lambda a, b: f"list_transform({a}, lambda s: list_max(list_transform({b}, lambda r: (1 + list_cosine_similarity(s, r)) / 2)))"
_CHAIN = f"""WITH e AS (SELECT vec_id, {_H} AS h, {_C} AS c, {_R} AS r, embedding[1:24]::DOUBLE[] AS hv, embedding[25:48]::DOUBLE[] AS cv, embedding[33:56]::DOUBLE[] AS rv FROM embeddings),
a AS (SELECT *, {_AL('h', 'c')} AS hc, {_AL('c', 'h')} AS ch, {_AL('h', 'r')} AS hr, {_AL('r', 'h')} AS rh, {_AL('r', 'c')} AS rc, list_max([list_cosine_similarity(h[2], h[1]), list_cosine_similarity(h[3], h[1]), list_cosine_similarity(h[3], h[2])]) AS rep FROM e)
SELECT vec_id, round({{}}, 9) AS score FROM a"""


def _chain(spark, d, name):
    part = lambda n, o: F.array(*[F.slice("embedding", o + i * 8 + 1, 8) for i in range(n)])
    e = table(spark, d, "embeddings").select("vec_id", part(3, 0).alias("h"), part(2, 24).alias("c"), part(2, 40).alias("r"), F.slice("embedding", 1, 24).alias("hv"), F.slice("embedding", 25, 24).alias("cv"), F.slice("embedding", 33, 24).alias("rv"))
    return chains.scores(e, "vec_id", "h", "c", "r", "hv", "cv", "rv").select("vec_id", F.round(name, 9).alias("score"))


_CHAIN_SQL = {
    "chn_faithfulness": ("faithfulness", "list_avg(hc)"),
    "chn_faithfulness_ww": ("faithfulness_ww", "list_avg(list_concat(hc, hr))"),
    "chn_info_step": ("informativeness_step", "(list_avg(hc) + list_avg(ch)) / 2"),
    "chn_info_chain": ("informativeness_chain", "(1 + (1 + list_cosine_similarity(hv, cv)) / 2) / 2"),
    "chn_repetition_step": ("repetition_step", "(1 - rep) / 2"),
    "chn_repetition_word": ("repetition_word", "1 - (1 + rep) / 2"),
    "chn_alignment_ref": ("alignment_ref", "list_avg(hr)"),
    "chn_ext_hallucination": ("ext_hallucination", "1 - list_max([(1 - hr[1]) * (1 - hc[1]), (1 - hr[2]) * (1 - hc[2]), (1 - hr[3]) * (1 - hc[3])])"),
    "chn_redundancy": ("redundancy", "list_min(hr)"),
    "chn_common_sense": ("common_sense", "1 - list_max([(1 - rh[1]) * (1 - rc[1]), (1 - rh[2]) * (1 - rc[2])])"),
    "chn_missing_step": ("missing_step", "list_min(rh)"),
    "chn_coverage_step": ("coverage_step", "1 - abs(list_avg(rc) - list_avg(hc))"),
    "chn_coverage_chain": ("coverage_chain", "(1 + (1 + list_cosine_similarity(hv, rv)) / 2) / 2"),
}


def _register(key, name, sql):
    def f(spark, d):
        return _chain(spark, d, name)

    f.__name__, f.__doc__ = key, f"Chain score {name}."
    query(_CHAIN.format(sql))(f)


for _key, (_name, _sql) in _CHAIN_SQL.items():
    _register(_key, _name, _sql)


@query("SELECT vec_id, (1 + list_cosine_similarity(embedding[1:8]::DOUBLE[], embedding[9:16]::DOUBLE[])) / 2 AS s FROM embeddings")
def chn_cosine_scaled(spark, d):
    return table(spark, d, "embeddings").select("vec_id", similarity.scaled(similarity.cosine(F.slice("embedding", 1, 8), F.slice("embedding", 9, 8))).alias("s"))


@query(_CHAIN.replace("round({{}}, 9) AS score".replace("{{}}", "{}"), "hc[1] AS first, hc[2] AS second, hc[3] AS third"))
def chn_alignment(spark, d):
    part = lambda n, o: F.array(*[F.slice("embedding", o + i * 8 + 1, 8) for i in range(n)])
    a = table(spark, d, "embeddings").select("vec_id", chains.alignment(part(3, 0), part(2, 24)).alias("a"))
    return a.select("vec_id", *[F.col("a")[i].alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("SELECT vec_id, coalesce(list_avg(list_transform(embedding[1:(vec_id % 3)], lambda x: x::DOUBLE)), 0) AS m FROM embeddings")
def chn_mean(spark, d):
    return table(spark, d, "embeddings").select("vec_id", chains.mean(F.transform(F.slice("embedding", F.lit(1), (F.col("vec_id") % 3).cast("int")), lambda x: x.cast("double"))).alias("m"))


_PROB = "list_transform(range(0, 6), lambda i: ('0x' || md5(concat(i, ':', vec_id))[1:7])::BIGINT / 268435456.0::DOUBLE)"


def _prob(spark, d):
    from attune.operators.sampling import unit  # noqa: F401

    p = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), F.col("vec_id").cast("string"))), 1, 7), 16, 10).cast("long") / F.lit(268435456.0))
    return table(spark, d, "embeddings").select("vec_id", p.alias("p"))


@query(f"SELECT vec_id, 1 - list_max({_PROB}[1:3]) AS s FROM embeddings")
def chn_discourse(spark, d):
    """From supplied contradiction probabilities of (context, step) pairs."""
    return _prob(spark, d).select("vec_id", chains.discourse(F.slice("p", 1, 3)).alias("s"))


@query(f"SELECT vec_id, 1 - list_max({_PROB}) AS s FROM embeddings")
def chn_coherence(spark, d):
    """From supplied contradiction probabilities of all step pairs, a step with itself included."""
    return _prob(spark, d).select("vec_id", chains.discourse(F.col("p")).alias("s"))


@query(f"SELECT vec_id, 6 / list_sum(list_transform([p[1] + 1, 2 * (p[2] + 1), 3 * (p[3] + 1)], lambda x: x)) AS s FROM (SELECT vec_id, {_PROB} AS p FROM embeddings)")
def chn_ppl_step(spark, d):
    """From supplied perplexities and token counts of the steps."""
    return _prob(spark, d).select("vec_id", chains.perplexity(F.transform(F.slice("p", 1, 3), lambda x: x + 1), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("s"))


@query(f"SELECT vec_id, 1 / (1 + list_max(p[1:3])) AS worst, 1 / (1 + p[4]) AS chain FROM (SELECT vec_id, {_PROB} AS p FROM embeddings)")
def chn_ppl_max_chain(spark, d):
    return _prob(spark, d).select("vec_id", (1 / (1 + F.array_max(F.slice("p", 1, 3)))).alias("worst"), (1 / (1 + F.col("p")[3])).alias("chain"))


@query(f"SELECT vec_id, list_avg({_PROB}) AS mean, list_min({_PROB}) AS least FROM embeddings")
def chn_grammar_step(spark, d):
    """From supplied correctness probabilities: mean and least."""
    return _prob(spark, d).select("vec_id", chains.mean(F.col("p")).alias("mean"), F.array_min("p").alias("least"))


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE 0.5 END::DOUBLE AS score FROM embeddings")
def chn_na(spark, d):
    """An empty chain has no score."""
    steps = F.when(F.col("vec_id") % 4 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.5)))
    return table(spark, d, "embeddings").select("vec_id", F.when(F.size(steps) > 0, chains.mean(steps)).alias("score"))


@query("SELECT * FROM (VALUES ('SA', 10::BIGINT), ('SS', 3), ('LI', 2), ('LC', 5)) t(kind, n)")
def chn_group_lists(spark, d):
    rows = [(k, n) for k, names in chains.GROUPS.items() for n in names]
    return spark.createDataFrame(rows, "kind STRING, name STRING").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH f AS ({_CHAIN.format('list_avg(hc)')}), i AS ({_CHAIN.format('(list_avg(hc) + list_avg(ch)) / 2')}), c AS ({_CHAIN.format('(1 + (1 + list_cosine_similarity(hv, cv)) / 2) / 2')}) SELECT f.vec_id, (f.score + i.score) / 2 AS sa, c.score AS ss FROM f JOIN i USING (vec_id) JOIN c USING (vec_id)""")
def chn_summary5(spark, d):
    part = lambda n, o: F.array(*[F.slice("embedding", o + i * 8 + 1, 8) for i in range(n)])
    e = table(spark, d, "embeddings").select("vec_id", part(3, 0).alias("h"), part(2, 24).alias("c"), part(2, 40).alias("r"), F.slice("embedding", 1, 24).alias("hv"), F.slice("embedding", 25, 24).alias("cv"), F.slice("embedding", 33, 24).alias("rv"))
    s = chains.scores(e, "vec_id", "h", "c", "r", "hv", "cv", "rv")
    return s.select("vec_id", ((F.round("faithfulness", 9) + F.round("informativeness_step", 9)) / 2).alias("sa"), F.round("informativeness_chain", 9).alias("ss"))


@query(f"""WITH e AS (SELECT vec_id, label, ('0x' || md5(concat('0:', vec_id))[1:7])::BIGINT / 268435456.0::DOUBLE AS s FROM embeddings), i AS (SELECT vec_id // 5 AS item, label, avg(s) AS s FROM e GROUP BY ALL),
p AS (SELECT a.item, a.label AS a, b.label AS b, CASE WHEN a.s > b.s THEN 1 WHEN a.s < b.s THEN 2 ELSE 0 END AS result FROM i a JOIN i b ON a.item = b.item AND a.label < b.label)
SELECT model, sum(win)::BIGINT AS wins, count(*) AS battles FROM (SELECT a AS model, (result = 1)::INT AS win FROM p UNION ALL SELECT b, (result = 2)::INT FROM p) GROUP BY 1""")
def chn_pairwise(spark, d):
    """Systems compared pairwise on one score per item, and their wins."""
    s = _prob(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    i = s.groupBy(F.floor(F.col("vec_id") / 5).alias("item"), "label").agg(F.avg(F.col("p")[0]).alias("s"))
    p = pairs.self_pairs(i, "item", "label", ["s"]).select("item", "a", "b", pairs.compare3(F.col("s_a"), F.col("s_b")).alias("result"))
    return pairs.wins(p)
