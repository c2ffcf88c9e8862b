"""Normalisation, blends, weight searches and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sigmoid
from tidemark.operators import audit, blend, encode
from tidemark.queries.base import query, r6, scored
from tidemark.queries.rankings import SHOW, metric_sql, shown


@query("minmax_norm", "SELECT row_id, round((s3 - min(s3) OVER ()) / (max(s3) OVER () - min(s3) OVER () + 1e-12), 6) AS s3_mm FROM log")
def minmax_norm(spark, d):
    return blend.minmax(scored(spark, d), ["s3"]).select("row_id", r6("s3_mm"))


@query("zscore_norm", "SELECT row_id, round((s3 - avg(s3) OVER ()) / (stddev_pop(s3) OVER () + 1e-9), 6) AS s3_z FROM log")
def zscore_norm(spark, d):
    return blend.zscore(scored(spark, d), ["s3"]).select("row_id", r6("s3_z"))


@query("weighted_blend", "SELECT row_id, round(0.10e0 * s1 + 0.52e0 * s2 + 0.38e0 * s3, 6) AS score FROM log")
def weighted_blend(spark, d):
    return scored(spark, d).select("row_id", r6(blend.weighted([F.col("s1"), F.col("s2"), F.col("s3")], [0.10, 0.52, 0.38]), "score"))


@query("seed_mean", "SELECT row_id, round((1 / (1 + exp(-(s1 - 6))) + 1 / (1 + exp(-(s2 - 8))) + 1 / (1 + exp(-greatest(-30, least(30, s3 - 50))))) / 3, 6) AS score, round((s1 + s2 + s3) / 3, 6) AS mean_raw FROM log")
def seed_mean(spark, d):
    parts = [sigmoid(F.col("s1") - 6), sigmoid(F.col("s2") - 8), sigmoid(F.col("s3") - 50)]
    return scored(spark, d).select("row_id", r6((parts[0] + parts[1] + parts[2]) / 3, "score"), r6((F.col("s1") + F.col("s2") + F.col("s3")) / 3, "mean_raw"))


@query("corr_components", "SELECT round(corr(s1, s2), 6) AS s1_s2, round(corr(s1, s3), 6) AS s1_s3, round(corr(s2, s3), 6) AS s2_s3 FROM log")
def corr_components(spark, d):
    return scored(spark, d).agg(r6(F.corr("s1", "s2"), "s1_s2"), r6(F.corr("s1", "s3"), "s1_s3"), r6(F.corr("s2", "s3"), "s2_s3"))


# weights in whole tenths keep scores integral, so that ties are the same in both engines
ALPHA = ", lg AS (SELECT log.*, g AS grid, g * s1 + (10 - g) * s2 AS sc FROM log, range(11) r(g))"


def _alpha(spark, d, by=None):
    return blend.alpha_sweep(scored(spark, d), "s1", "s2", 10, by)


@query("alpha_grid", ALPHA + metric_sql("lg", "sc", "grid") + f"SELECT grid, {SHOW} FROM met")
def alpha_grid(spark, d):
    return shown(_alpha(spark, d), "grid")


@query("alpha_best", ALPHA + metric_sql("lg", "sc", "grid") + f"SELECT grid, {SHOW} FROM met ORDER BY round((gauc + ndcg) / 2, 6) DESC, grid LIMIT 1")
def alpha_best(spark, d):
    return blend.best(shown(_alpha(spark, d), "grid"))


@query("segment_alpha", ALPHA + metric_sql("lg", "sc", "ctx, grid") + """SELECT ctx, grid, round((gauc + ndcg) / 2, 6) AS primary_score FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round((gauc + ndcg) / 2, 6) DESC, grid) AS k FROM met) WHERE k = 1""")
def segment_alpha(spark, d):
    return blend.best(shown(_alpha(spark, d, ["ctx"]), "ctx", "grid"), by=["ctx"]).select("ctx", "grid", "primary_score")


@query("segment_alphas", ALPHA + metric_sql("lg", "sc", "hr, grid") + """, ov AS (SELECT row_number() OVER (ORDER BY round((gauc + ndcg) / 2, 9) DESC, grid) AS k, grid FROM ("""
    + "WITH z AS (SELECT 1)" + metric_sql("lg", "sc", "grid") + """SELECT * FROM met)), sz AS (SELECT hr, count(*) AS n_rows FROM log GROUP BY hr),
own AS (SELECT hr, grid, row_number() OVER (PARTITION BY hr ORDER BY round((gauc + ndcg) / 2, 9) DESC, grid) AS k FROM met)
SELECT hr, CASE WHEN n_rows < (SELECT quantile_cont(n_rows, 0.5) FROM sz) THEN (SELECT grid FROM ov WHERE k = 1) ELSE grid END / 10e0 AS alpha, n_rows FROM own JOIN sz USING (hr) WHERE k = 1""")
def segment_alphas(spark, d):
    """Hours with fewer rows than the median hour take the weight of all."""
    rows = scored(spark, d)
    middle = rows.groupBy("hr").count().agg(F.ceil(F.percentile("count", F.lit(0.5)))).first()[0]
    return blend.segment_alphas(rows, "s1", "s2", "hr", 10, int(middle or 0))


@query("segment_blend", "SELECT row_id, round(CASE ctx WHEN 'click' THEN 0.2e0 WHEN 'view' THEN 0.7e0 ELSE 0.5e0 END * s1 + (1 - CASE ctx WHEN 'click' THEN 0.2e0 WHEN 'view' THEN 0.7e0 ELSE 0.5e0 END) * s2, 6) AS score FROM log")
def segment_blend(spark, d):
    alphas = spark.sql("SELECT * FROM VALUES ('click', 0.2D), ('view', 0.7D) AS t(ctx, alpha)")
    return blend.apply_segment_alphas(scored(spark, d), alphas, "s1", "s2", "ctx", 0.5).select("row_id", r6("score"))


SIMPLEX = ", sg AS (SELECT a, b, 5 - a - b AS c FROM range(6) x(a), range(6) y(b) WHERE a + b <= 5), lg AS (SELECT log.*, a, b, c, a * s1 + b * s2 + c * s3 AS sc FROM log, sg)"


@query("simplex_grid", SIMPLEX + metric_sql("lg", "sc", "a, b, c") + f"SELECT a, b, c, {SHOW} FROM met")
def simplex_grid(spark, d):
    g = _whole(spark, 5)
    return shown(blend.weight_search(scored(spark, d), ["s1", "s2", "s3"], g).withColumnsRenamed({"w0": "a", "w1": "b", "w2": "c"}), "a", "b", "c")


COARSE = ", sg AS (SELECT a AS w0, b AS w1, 10 - a - b AS w2 FROM range(11) x(a), range(11) y(b) WHERE a + b <= 10), lg AS (SELECT log.*, w0, w1, w2, w0 * s1 + w1 * s2 + w2 * s3 AS sc FROM log, sg)"
CENTRE = COARSE + metric_sql("lg", "sc", "w0, w1, w2") + ", ce AS (SELECT w0 / 10e0 AS c0, w1 / 10e0 AS c1, w2 / 10e0 AS c2 FROM met ORDER BY round((gauc + ndcg) / 2, 9) DESC, w0 DESC, w1 DESC, w2 DESC LIMIT 1)"
AROUND = "SELECT round(c0 + a * 0.02e0, 10) AS w0, round(c1 + b * 0.02e0, 10) AS w1, round(c2 - (a + b) * 0.02e0, 10) AS w2 FROM ce, range(-{r}, {r} + 1) x(a), range(-{r}, {r} + 1) y(b) WHERE abs(a + b) <= {r} AND least(round(c0 + a * 0.02e0, 10), round(c1 + b * 0.02e0, 10), round(c2 - (a + b) * 0.02e0, 10)) >= {least}"


def _whole(spark, steps):
    """The simplex in whole steps: whole scores tie alike in both engines."""
    return blend.simplex_grid(spark, steps).select(*[F.round(F.col(f"w{k}") * steps).cast("bigint").alias(f"w{k}") for k in range(3)])


@query("coarse_weight_search", COARSE + metric_sql("lg", "sc", "w0, w1, w2") + f"SELECT w0, w1, w2, {SHOW} FROM met")
def coarse_weight_search(spark, d):
    """All 66 points of the 0.1 simplex, in whole tenths."""
    return shown(blend.weight_search(scored(spark, d), ["s1", "s2", "s3"], _whole(spark, 10)), "w0", "w1", "w2")


def _centre(spark, d):
    """The log's best point of the 0.1 simplex."""
    found = blend.weight_search(scored(spark, d), ["s1", "s2", "s3"], _whole(spark, 10))
    top = found.orderBy(F.round("primary_score", 9).desc(), F.desc("w0"), F.desc("w1"), F.desc("w2")).first()
    return [top[f"w{k}"] / 10 for k in range(3)] if top else [0.1, 0.5, 0.4]


@query("local_grid", CENTRE + AROUND.format(r=3, least=0))
def local_grid(spark, d):
    """The finer points around the log's best coarse point."""
    return blend.local_grid(spark, _centre(spark, d), 3, 0.02).select(*[F.round(f"w{k}", 10).alias(f"w{k}") for k in range(3)])


@query("refined_grid", CENTRE + ", co AS (SELECT w0 / 10e0 AS w0, w1 / 10e0 AS w1, w2 / 10e0 AS w2 FROM sg) SELECT * FROM co UNION " + AROUND.format(r=5, least=0))
def refined_grid(spark, d):
    """The coarse simplex and the finer points around the log's best, each once."""
    return blend.refined_grid(spark, _centre(spark, d))


FINE = "fi AS (SELECT * FROM (SELECT w0 / 10e0 AS w0, w1 / 10e0 AS w1, w2 / 10e0 AS w2 FROM sg) UNION " + AROUND.format(r=2, least=0) + ")"


@query("refined_search", CENTRE + f", {FINE}, l2 AS (SELECT log.*, w0, w1, w2, round(w0 * 50) * s1 + round(w1 * 50) * s2 + round(w2 * 50) * s3 AS sc FROM log, fi) SELECT w0, w1, w2, {SHOW} FROM (WITH z AS (SELECT 1)" + metric_sql("l2", "sc", "w0, w1, w2") + "SELECT * FROM met)")
def refined_search(spark, d):
    """The whole search, coarse and fine; scores are scaled so that whole fiftieths keep ties."""
    return shown(blend.refined_search(scored(spark, d), ["s1", "s2", "s3"], radius=2, scale=50), "w0", "w1", "w2")


@query("normaliser_switch", "SELECT row_id, round((s3 - min(s3) OVER ()) / (max(s3) OVER () - min(s3) OVER () + 1e-12), 6) AS g, round((s3 - avg(s3) OVER ()) / (stddev_pop(s3) OVER () + 1e-9), 6) AS z FROM log")
def normaliser_switch(spark, d):
    rows = blend.normalised(scored(spark, d), ["s3"], "global").withColumnRenamed("s3_n", "g")
    return blend.normalised(rows, ["s3"], "zscore").select("row_id", r6("g"), r6("s3_n", "z"))


@query("category_frame", "SELECT coalesce(CAST(nullif(ctx, 'view') AS VARCHAR), 'UNK') AS ctx, CAST(item AS VARCHAR) AS item, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y FROM log")
def category_frame(spark, d):
    log = scored(spark, d).withColumn("ctx", F.nullif(F.col("ctx"), F.lit("view")))
    return encode.category_frame(log, ["ctx", "item"], ["y"]).withColumn("y", F.col("y").cast("double"))


@query("top_weight_records", SIMPLEX + metric_sql("lg", "sc", "a, b, c") + "SELECT a, b, c, round((gauc + ndcg) / 2, 6) AS primary_score FROM met ORDER BY primary_score DESC, a, b, c LIMIT 12")
def top_weight_records(spark, d):
    return simplex_grid(spark, d).select("a", "b", "c", "primary_score").orderBy(F.desc("primary_score"), "a", "b", "c").limit(12)


REGIME = """, hist AS (SELECT usr, count(*) FILTER (split = 'train' AND usr % 10 <> 0 AND y = 1) AS c FROM log GROUP BY usr), th AS (SELECT floor(quantile_cont(c, 0.5)) AS mid FROM hist WHERE c > 0),
rg AS (SELECT usr, c, CASE WHEN c = 0 THEN 'no_prior' WHEN c <= mid THEN 'low' ELSE 'high' END AS regime FROM hist, th)
"""


def _regimes(spark, d):
    log = scored(spark, d)
    hist = log.groupBy("usr").agg(F.count_if((F.col("split") == "train") & (F.col("usr") % 10 != 0) & (F.col("y") == 1)).alias("c"))
    th = audit.lower_median(hist.filter("c > 0"), "c")
    return log, hist.join(F.broadcast(th)).select("usr", "c", blend.regime(F.col("c"), F.col("threshold")).alias("regime"))


@query("regime_assign", REGIME + "SELECT regime, count(*) AS users, min(c) AS least, max(c) AS most, round(quantile_cont(c, 0.5), 6) AS median FROM rg GROUP BY regime")
def regime_assign(spark, d):
    _, r = _regimes(spark, d)
    return r.groupBy("regime").agg(F.count(F.lit(1)).alias("users"), F.min("c").alias("least"), F.max("c").alias("most"), r6(F.percentile("c", F.lit(0.5)), "median"))


@query("regime_blend", REGIME + ", lg AS (SELECT log.*, regime, CASE regime WHEN 'no_prior' THEN s1 * 2 + s2 WHEN 'low' THEN s1 + s2 ELSE s1 + s3 END AS sc FROM log JOIN rg ON rg.usr = log.usr)" + metric_sql("lg", "sc", "regime") + f"SELECT regime, {SHOW} FROM met")
def regime_blend(spark, d):
    from tidemark.operators.metrics import evaluate

    log, r = _regimes(spark, d)
    weights = spark.sql("SELECT * FROM VALUES ('no_prior', 2D, 1D, 0D), ('low', 1D, 1D, 0D), ('high', 1D, 0D, 1D) AS t(regime, w1, w2, w3)")
    rows = log.join(r, "usr").join(F.broadcast(weights), "regime").withColumn("score", blend.weighted([F.col("s1"), F.col("s2"), F.col("s3")], [F.col("w1"), F.col("w2"), F.col("w3")]))
    return shown(evaluate(rows, by=["regime"]), "regime")


@query("segment_sizes", REGIME + "SELECT regime, count(*) AS n_rows, count(DISTINCT log.usr) AS users FROM log JOIN rg ON rg.usr = log.usr GROUP BY regime")
def segment_sizes(spark, d):
    log, r = _regimes(spark, d)
    return log.join(r, "usr").groupBy("regime").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("usr").alias("users"))
