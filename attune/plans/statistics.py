"""Correlations and significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from attune.operators import stats, summaries
from attune.plans.base import RANKINGS, rankings
from attune.plans.registry import query, table

_RK = """rk AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS a,
rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)"""


@query(f"WITH {_RK} SELECT l_suppkey, corr(a, b) AS rho FROM rk GROUP BY 1")
def st_spearman(spark, d):
    return stats.spearman(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")


@query("SELECT l_suppkey, corr(l_quantity, l_tax) AS r FROM lineitem GROUP BY 1")
def st_pearson(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_tax").alias("r"))


@query()
def st_pearson_p(spark, d):
    """Pearson's r with its two-sided p."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_tax").alias("r"), F.count("*").alias("n"))
    return g.select("l_suppkey", "r", stats.student_p(F.col("r"), F.col("n")).alias("p"))


@query()
def st_permutation_p(spark, d):
    """Seeded permutation test per supplier nation."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_acctbal", F.col("s_suppkey").cast("double").alias("k"))
    return stats.permutation_p(s, ["s_nationkey"], "s_acctbal", "k", rounds=5_000)


@query("WITH c AS (SELECT l_suppkey, l_suppkey % 7 AS g, corr(l_quantity, l_tax) AS r FROM lineitem GROUP BY ALL) SELECT g, tanh(coalesce(avg(CASE WHEN abs(r) < 1 THEN atanh(r) END), 0)) AS mean_r FROM c GROUP BY 1")
def st_fisher_z_mean(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_tax").alias("r"))
    return c.groupBy((F.col("l_suppkey") % 7).alias("g")).agg(stats.fisher_mean(F.col("r")).alias("mean_r"))


@query("""WITH p AS (SELECT n_regionkey AS g, (n_nationkey + 1) / 30.0::DOUBLE AS p FROM nation), s AS (SELECT g, sum(-2 * ln(p)) AS chi2, count(*) AS n FROM p GROUP BY 1)
SELECT g, chi2, 2 * n AS dof, exp(-chi2 / 2) * (1 + chi2 / 2 + power(chi2 / 2, 2) / 2 + power(chi2 / 2, 3) / 6 + power(chi2 / 2, 4) / 24) AS p FROM s""")
def st_fisher_combine(spark, d):
    p = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), ((F.col("n_nationkey") + 1) / 30.0).alias("p"))
    return stats.fisher_combine(p, ["g"], "p")


_BLOCK = f"""{RANKINGS}, w AS (SELECT idx, user_id FROM r GROUP BY ALL HAVING count(*) = 9), f AS (SELECT r.* FROM r JOIN w USING (idx, user_id)),
k AS (SELECT idx, user_id, model, rank, rank() OVER (PARTITION BY idx, user_id ORDER BY rank DESC) + (count(*) OVER (PARTITION BY idx, user_id, rank) - 1) / 2.0::DOUBLE AS fr FROM f)"""


def _blocks(spark, d):
    r = rankings(spark, d)
    whole = r.groupBy("idx", "user_id").agg(F.count("*").alias("n")).where("n = 9").drop("n")
    return r.join(whole, ["idx", "user_id"], "left_semi")


@query(f"""WITH {_BLOCK}, s AS (SELECT model, sum(fr) AS s, count(*)::DOUBLE AS n FROM k GROUP BY 1), t AS (SELECT sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT count(*) AS t FROM k GROUP BY idx, user_id, rank))
SELECT (12 / (max(n) * 9 * 10) * sum(s * s) - 3 * max(n) * 10) / (1 - max(ties) / (max(n) * 9 * 80)) AS chi2, max(n)::BIGINT AS blocks, 9::BIGINT AS systems FROM s, t""")
def st_friedman(spark, d):
    return stats.friedman(_blocks(spark, d), ["idx", "user_id"], "model", "rank")


@query(f"WITH {_BLOCK} SELECT model, avg(fr) AS mean_rank, count(*) AS blocks FROM k GROUP BY 1")
def st_nemenyi(spark, d):
    """Mean ranks behind a critical-difference report."""
    return stats.mean_ranks(_blocks(spark, d), ["idx", "user_id"], "model", "rank")


@query()
def st_nemenyi_p(spark, d):
    """Post-hoc p of every pair of systems; the studentised range has no SQL form, tables are checked in the tests."""
    return stats.nemenyi(_blocks(spark, d), ["idx", "user_id"], "model", "rank").select("a", "b", F.round("q", 6).alias("q"), F.round("p", 6).alias("p"))


@query("""SELECT l_returnflag, 'l_quantity' AS a, 'l_discount' AS b, corr(l_quantity, l_discount) AS r FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem GROUP BY 1""")
def st_corr_matrix(spark, d):
    return stats.correlation_table(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])


@query("""WITH c AS (SELECT l_suppkey, l_returnflag AS system, corr(l_quantity, l_discount) AS r FROM lineitem GROUP BY ALL HAVING count(*) > 2)
SELECT system, avg(r) AS mean, list_sort(list(r))[count(*) // 2 + 1] AS upper_median, stddev_pop(r) AS std, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS iqr, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.75) AS p75, max(r) AS high, min(r) AS low FROM c GROUP BY 1""")
def st_commentwise(spark, d):
    """Correlation per item and system, then its distribution per system."""
    c = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("system")).agg(F.corr("l_quantity", "l_discount").alias("r"), F.count("*").alias("n")).where("n > 2")
    return summaries.distribution(c, ["system"], "r")


@query("""WITH k AS (SELECT l_returnflag, l_linenumber AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)
SELECT a.l_returnflag, sum(sign(b.y - a.y) * a.n * b.n) / sum(a.n * b.n) AS d FROM k a JOIN k b ON a.l_returnflag = b.l_returnflag AND a.x < b.x GROUP BY 1""")
def st_somers_d(spark, d):
    return stats.somers_d(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber", "l_discount")


@query("""SELECT score, label, corr(CASE score WHEN 'quantity' THEN l_quantity ELSE l_extendedprice END, CASE label WHEN 'tax' THEN l_tax ELSE l_discount END) AS r FROM lineitem, (VALUES ('quantity'), ('price')) s(score), (VALUES ('tax'), ('discount')) t(label) GROUP BY ALL""")
def st_correl_table(spark, d):
    """Every score against every label in one pass."""
    cells = [(s, sc, t, tc) for s, sc in (("quantity", "l_quantity"), ("price", "l_extendedprice")) for t, tc in (("tax", "l_tax"), ("discount", "l_discount"))]
    one = table(spark, d, "lineitem").agg(*[F.corr(sc, tc).alias(f"{s}_{t}") for s, sc, t, tc in cells])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.lit(t).alias("label"), F.col(f"{s}_{t}").alias("r")) for s, _, t, _ in cells])).alias("c")).select("c.*")


@query("SELECT l_returnflag AS fold, l_linestatus AS model, corr(1 - (l_linenumber % 2), l_extendedprice) AS r FROM lineitem GROUP BY ALL")
def st_perturb_corr(spark, d):
    """Inverted perturbation flag against a score per fold and model."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("fold"), F.col("l_linestatus").alias("model")).agg(F.corr(1 - F.col("l_linenumber") % 2, "l_extendedprice").alias("r"))
