"""Metrics, ranks and fusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit, metrics, ranks
from tidemark.operators.models import item_popularity
from tidemark.queries.base import query, r6, scored
from tidemark.sources import event_log


def metric_sql(src: str, score: str, by: str = "", user: str = "usr") -> str:
    """CTEs that end in ``met`` (by, gauc, ndcg, primary_score, users, n_rows) for rows of ``src``."""
    b, g = (f"{by}, ", f"{by}, {user}") if by else ("", user)
    group = f"GROUP BY {by}" if by else ""
    return f""", mr AS (SELECT {g}, CAST(y AS DOUBLE) AS y, rank() OVER (PARTITION BY {g} ORDER BY {score}) + (count(*) OVER (PARTITION BY {g}, {score}) - 1) / 2e0 AS r,
  row_number() OVER (PARTITION BY {g} ORDER BY {score} DESC, row_id) AS p, row_number() OVER (PARTITION BY {g} ORDER BY y DESC, row_id) AS i FROM {src}),
mu AS (SELECT {g}, count(*) AS n, sum(y) AS pos, sum(r * y) AS rs, sum(CASE WHEN p <= 5 THEN y / log2(p + 1e0) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 5 THEN y / log2(i + 1e0) ELSE 0 END) AS idcg FROM mr GROUP BY {g}),
ma AS (SELECT *, CASE WHEN pos > 0 AND pos < n THEN (rs - pos * (pos + 1) / 2) / (pos * (n - pos)) END AS auc, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS nd FROM mu),
met AS (SELECT {b}coalesce(sum(auc * pos) FILTER (auc IS NOT NULL) / sum(pos) FILTER (auc IS NOT NULL), 0.5e0) AS gauc, avg(nd) AS ndcg, count(*) AS users, CAST(sum(n) AS BIGINT) AS n_rows FROM ma {group})
"""


SHOW = "round(gauc, 6) AS gauc, round(ndcg, 6) AS ndcg, round((gauc + ndcg) / 2, 6) AS primary_score, users, n_rows"


def shown(df, *by):
    return df.select(*by, r6("gauc"), r6("ndcg"), r6("primary_score"), "users", "n_rows")


POP = """, tr AS (SELECT * FROM log WHERE split = 'train'), g AS (SELECT avg(y) AS g FROM tr), pop AS (SELECT item, (sum(y) + 20 * max(g)) / (count(*) + 20) AS r FROM tr, g GROUP BY item),
ps AS (SELECT log.*, coalesce(pop.r, g.g) AS score FROM log CROSS JOIN g LEFT JOIN pop ON pop.item = log.item)
"""


@query("item_popularity", POP + "SELECT row_id, round(score, 6) AS score FROM ps WHERE split <> 'train'")
def item_popularity_q(spark, d):
    log = event_log(spark, d)
    return item_popularity(log.filter("split <> 'train'"), log.filter("split = 'train'")).select("row_id", r6("score"))


@query("popularity_eval", POP.replace("coalesce(pop.r, g.g) AS score", "round(coalesce(pop.r, g.g), 9) AS score") + ", pe AS (SELECT * FROM ps WHERE split <> 'train')" + metric_sql("pe", "score", "split") + f"SELECT split, {SHOW} FROM met")
def popularity_eval(spark, d):
    """Popularity fitted on train, held against the metric on valid and test."""
    log = event_log(spark, d)
    rows = item_popularity(log.filter("split <> 'train'"), log.filter("split = 'train'")).withColumn("score", F.round("score", 9))
    return shown(metrics.evaluate(rows, by=["split"]), "split")


@query("gauc_ndcg", metric_sql("log", "s1") + f"SELECT {SHOW} FROM met")
def gauc_ndcg(spark, d):
    return shown(metrics.evaluate(scored(spark, d), score="s1"))


@query("user_metrics", metric_sql("log", "s2") + "SELECT usr, n, CAST(pos AS BIGINT) AS pos, round(auc, 6) AS auc, round(nd, 6) AS ndcg FROM ma")
def user_metrics(spark, d):
    return metrics.user_metrics(scored(spark, d), score="s2").select("usr", "n", F.col("pos").cast("bigint").alias("pos"), r6("auc"), r6("ndcg"))


@query("segment_metrics", metric_sql("log", "s1", "ctx") + f"SELECT ctx, {SHOW} FROM met")
def segment_metrics(spark, d):
    return shown(metrics.evaluate(scored(spark, d), score="s1", by=["ctx"]), "ctx")


@query("fold_metrics", ", lf AS (SELECT *, usr % 5 AS fold FROM log)" + metric_sql("lf", "s3", "fold") + "SELECT count(*) AS folds, round(avg((gauc + ndcg) / 2), 6) AS mean_primary FROM met")
def fold_metrics(spark, d):
    got = metrics.evaluate(scored(spark, d).withColumn("fold", F.pmod("usr", F.lit(5))), score="s3", by=["fold"])
    return got.agg(F.count(F.lit(1)).alias("folds"), r6(F.avg("primary_score"), "mean_primary"))


@query("oracle_ceiling", metric_sql("log", "y", "split") + f"SELECT split, {SHOW} FROM met")
def oracle_ceiling(spark, d):
    return shown(metrics.evaluate(event_log(spark, d).withColumn("score", F.col("y").cast("double")), by=["split"]), "split")


@query("constant_score", ", lc AS (SELECT *, 0e0 AS c FROM log)" + metric_sql("lc", "c", "split") + f"SELECT split, {SHOW} FROM met")
def constant_score(spark, d):
    return shown(metrics.evaluate(event_log(spark, d).withColumn("score", F.lit(0.0)), by=["split"]), "split")


@query("random_score", ", lc AS (SELECT *, row_id * 1299709 % 104729 AS c FROM log)" + metric_sql("lc", "c", "split") + f"SELECT split, {SHOW} FROM met")
def random_score(spark, d):
    return shown(metrics.evaluate(event_log(spark, d).withColumn("score", F.pmod(F.col("row_id") * 1299709, F.lit(104729))), by=["split"]), "split")


@query("metric_delta", metric_sql("log", "s1", "split") + ", a AS (SELECT split, (gauc + ndcg) / 2 AS p FROM met)" + metric_sql("log", "s2", "split").replace("mr AS", "mr2 AS").replace("FROM mr ", "FROM mr2 ").replace("mu AS", "mu2 AS").replace("FROM mu)", "FROM mu2)").replace("ma AS", "ma2 AS").replace("FROM ma ", "FROM ma2 ").replace("met AS", "met2 AS") + "SELECT a.split, round((met2.gauc + met2.ndcg) / 2 - a.p, 6) AS delta FROM a JOIN met2 ON met2.split = a.split")
def metric_delta(spark, d):
    rows = scored(spark, d)
    a = metrics.evaluate(rows, score="s1", by=["split"]).select("split", F.col("primary_score").alias("a"))
    b = metrics.evaluate(rows, score="s2", by=["split"]).select("split", F.col("primary_score").alias("b"))
    return a.join(b, "split").select("split", r6(F.col("b") - F.col("a"), "delta"))


@query("user_composition", """, u AS (SELECT split, usr, ctx, sum(CAST(play >= 100 AS INT)) AS p, count(*) AS n FROM log GROUP BY split, usr, ctx)
SELECT split, round(avg(CAST(p = 0 AS INT)), 6) AS all_negative, round(avg(CAST(p = n AS INT)), 6) AS all_positive, round(avg(CAST(p > 0 AND p < n AS INT)), 6) AS discriminative FROM u GROUP BY split""")
def user_composition(spark, d):
    rows = event_log(spark, d).withColumn("y", (F.col("play") >= 100).cast("int")).withColumn("g", F.concat_ws("|", F.col("usr").cast("string"), "ctx"))
    return metrics.user_composition(rows, "g", by=["split"]).select("split", r6("all_negative"), r6("all_positive"), r6("discriminative"))


@query("tie_stats", ", u AS (SELECT usr, count(DISTINCT s2) / count(*) AS share FROM log GROUP BY usr) SELECT (SELECT count(DISTINCT s2) FROM log) AS n_unique, round(avg(share), 6) AS mean_unique_share FROM u")
def tie_stats(spark, d):
    return audit.tie_stats(scored(spark, d), "s2").select("n_unique", r6("mean_unique_share"))


RANKS = """, rk AS (SELECT *, (rank() OVER (PARTITION BY usr ORDER BY s1) + (count(*) OVER (PARTITION BY usr, s1) - 1) / 2e0) / count(*) OVER (PARTITION BY usr) AS pct,
  rank() OVER (PARTITION BY usr ORDER BY s1 DESC) + (count(*) OVER (PARTITION BY usr, s1) - 1) / 2e0 AS d1, rank() OVER (PARTITION BY usr ORDER BY s2 DESC) + (count(*) OVER (PARTITION BY usr, s2) - 1) / 2e0 AS d2,
  count(*) OVER (PARTITION BY usr) AS n FROM log)
"""


@query("percentile_within_user", RANKS + "SELECT row_id, round(pct, 6) AS pct FROM rk")
def percentile_within_user(spark, d):
    return scored(spark, d).select("row_id", r6(ranks.percentile(["usr"], "s1"), "pct"))


@query("desc_rank", RANKS + "SELECT row_id, round(d1, 6) AS desc_rank, n AS size FROM rk")
def desc_rank(spark, d):
    return ranks.rank_state(scored(spark, d), ["usr"], "s1").select("row_id", r6("desc_rank"), "size")


def _both(spark, d):
    rows = scored(spark, d)
    return rows.select("*", ranks.average_rank(["usr"], "s1", True).alias("d1"), ranks.average_rank(["usr"], "s2", True).alias("d2"))


@query("borda_fusion", RANKS + "SELECT row_id, round(-(d1 + d2), 6) AS score FROM rk")
def borda_fusion(spark, d):
    return _both(spark, d).select("row_id", r6(ranks.borda([F.col("d1"), F.col("d2")]), "score"))


@query("rrf_fusion", RANKS + "SELECT row_id, round(1 / (60 + d1) + 1 / (60 + d2), 6) AS score FROM rk")
def rrf_fusion(spark, d):
    return _both(spark, d).select("row_id", r6(ranks.reciprocal_rank_fusion([F.col("d1"), F.col("d2")]), "score"))


@query("rank_transforms", RANKS + """SELECT row_id, round(pct, 6) AS percentile, round(pow(pct, 0.5e0), 6) AS "power_0.5", round(pow(pct, 1.5e0), 6) AS "power_1.5", round(pow(pct, 2e0), 6) AS power_2, round(pow(pct, 3e0), 6) AS power_3,
  round((ln(greatest(0.01e0, least(0.99e0, pct)) / (1 - greatest(0.01e0, least(0.99e0, pct)))) - ln(0.01e0 / 0.99e0)) / (ln(0.99e0 / 0.01e0) - ln(0.01e0 / 0.99e0)), 6) AS logit,
  round(CASE WHEN n <= 1 THEN 1 ELSE (1 / d1 - 1e0 / n) / (1 - 1e0 / n) END, 6) AS reciprocal, round(CASE WHEN n <= 1 THEN 1 ELSE (1 / log2(d1 + 1) - 1 / log2(n + 1e0)) / (1 - 1 / log2(n + 1e0)) END, 6) AS ndcg FROM rk""")
def rank_transforms(spark, d):
    s = ranks.rank_state(scored(spark, d), ["usr"], "s1")
    return s.select("row_id", *[r6(ranks.transform(t, F.col("pct"), F.col("desc_rank"), F.col("size")), t) for t in ranks.TRANSFORMS])


@query("regime_model_orders", """, hist AS (SELECT usr, count(*) FILTER (split = 'train') AS c FROM log GROUP BY usr), th AS (SELECT floor(quantile_cont(c, 0.5)) AS mid FROM hist),
lg AS (SELECT log.*, CASE WHEN c <= mid THEN 'low' ELSE 'high' END AS regime FROM log JOIN hist ON hist.usr = log.usr CROSS JOIN th WHERE split <> 'train'),
lm AS (SELECT row_id, usr, y, regime, 'm1' AS model, s1 AS s FROM lg UNION ALL SELECT row_id, usr, y, regime, 'm2', s2 FROM lg UNION ALL SELECT row_id, usr, y, regime, 'm3', s3 FROM lg)""" + metric_sql("lm", "s", "regime, model") + """, pr AS (SELECT regime, model, (gauc + ndcg) / 2 AS p FROM met),
pd AS (SELECT a.regime, a.model AS model_a, b.model AS model_b, a.p - b.p AS d FROM pr a JOIN pr b ON a.regime = b.regime AND a.model < b.model)
SELECT x.model_a, x.model_b, x.regime AS regime_1, y.regime AS regime_2 FROM pd x JOIN pd y ON x.model_a = y.model_a AND x.model_b = y.model_b AND x.regime < y.regime WHERE x.d * y.d < 0 AND least(abs(x.d), abs(y.d)) > 0.0001e0""")
def regime_model_orders(spark, d):
    log = scored(spark, d)
    hist = log.groupBy("usr").agg(F.count_if(F.col("split") == "train").alias("c"))
    th = audit.lower_median(hist, "c")
    rows = log.filter("split <> 'train'").join(hist, "usr").join(F.broadcast(th)).withColumn("regime", F.when(F.col("c") <= F.col("threshold"), "low").otherwise("high"))
    long = rows.select("row_id", "usr", "y", "regime", F.explode(F.create_map(F.lit("m1"), "s1", F.lit("m2"), "s2", F.lit("m3"), "s3")).alias("model", "score"))
    return audit.order_reversals(metrics.evaluate(long, by=["regime", "model"]).select("regime", "model", "primary_score"), 0.0001)
