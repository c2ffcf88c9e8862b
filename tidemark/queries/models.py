"""Samplers and scorers. DuckDB has no crc32, so draws are tested by invariants."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut, shared_root
from tidemark.operators import audit, blend, models, sampling
from tidemark.plans import features
from tidemark.queries.base import query, r6, scored
from tidemark.sources import event_log, results, table


@query("pair_sample")
def pair_sample(spark, d):
    tr = event_log(spark, d).filter("split = 'train'")
    return sampling.pairs(tr, tr.filter("y = 1").count())


@query("multi_negative_sample")
def multi_negative_sample(spark, d):
    tr = event_log(spark, d).filter("split = 'train'")
    return sampling.pairs(tr, tr.filter("y = 1").count(), negatives=4)


@query("weighted_user_pick")
def weighted_user_pick(spark, d):
    tr = event_log(spark, d).filter("split = 'train'")
    return sampling.weighted_picks(tr.groupBy("usr").agg(F.pow(F.sum("y") + F.lit(0.5), 0.75).alias("w")), tr.filter("y = 1").count())


@query("hard_negative_pool", ", neg AS (SELECT ctx, count(*) AS n FROM log WHERE split = 'train' AND y = 0 GROUP BY ctx) SELECT ctx, n AS pool_rows FROM neg WHERE n >= 300 UNION ALL SELECT '*', CAST(sum(n) AS BIGINT) FROM neg")
def hard_negative_pool(spark, d):
    return sampling.negative_pools(event_log(spark, d).filter("split = 'train'"), 300).groupBy("ctx").agg(F.count(F.lit(1)).alias("pool_rows"))


@query("hard_negatives")
def hard_negatives(spark, d):
    return sampling.hard_negatives(event_log(spark, d).filter("split = 'train'"), 300)


POOLS = """, tr AS (SELECT * FROM log WHERE split = 'train'), ci AS (SELECT DISTINCT ctx, item FROM tr),
p AS (SELECT 'pop_weighted' AS mode, '*' AS ctx, count(*) AS pool_rows FROM tr
  UNION ALL SELECT 'same_ctx', ctx, count(*) FROM ci GROUP BY ctx UNION ALL SELECT 'same_ctx', '*', count(DISTINCT item) FROM tr
  UNION ALL SELECT 'same_ctx_pop_weighted', ctx, count(*) FROM tr GROUP BY ctx UNION ALL SELECT 'same_ctx_pop_weighted', '*', count(DISTINCT item) FROM tr)
SELECT mode, ctx, pool_rows FROM p WHERE ctx = '*' OR pool_rows >= 40"""


@query("item_pools", POOLS)
def item_pools(spark, d):
    tr = event_log(spark, d).filter("split = 'train'")
    return reduce(DataFrame.unionByName, [sampling.item_pools(tr, m, 40).groupBy("ctx").agg(F.count_distinct("k").alias("pool_rows")).withColumn("mode", F.lit(m)) for m in sampling.MODES])


@query("mode_negatives")
def mode_negatives(spark, d):
    tr = event_log(spark, d).filter("split = 'train'")
    return reduce(DataFrame.unionByName, [sampling.mode_negatives(tr, m, 40).withColumn("mode", F.lit(m)) for m in sampling.MODES])


@query("frozen_scores", "SELECT row_id, s1 FROM log")
def frozen_scores(spark, d):
    path = f"{shared_root(spark)}/frozen-{uuid.uuid4().hex}"
    results.freeze(scored(spark, d).select("row_id", "s1"), path)
    return results.load_frozen(spark, path)


@query("coverage_report", """, v AS (SELECT 'y' AS feature, CAST(y AS DOUBLE) AS value FROM log UNION ALL SELECT 's3', s3 FROM log UNION ALL SELECT 'hr', CAST(hr AS DOUBLE) FROM log),
st AS (SELECT feature, round(avg(CAST(value <> 0 AS DOUBLE)), 6) AS nonzero_share, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.99), 6) AS q99 FROM v GROUP BY feature),
c AS (SELECT feature, value, count(*) AS n_rows FROM v GROUP BY feature, value),
k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n_rows DESC, value) AS place FROM c)
SELECT feature, value, n_rows, place, nonzero_share, q50, q99 FROM k JOIN st USING (feature) WHERE place <= 20""")
def coverage_report(spark, d):
    got = audit.coverage_report(scored(spark, d), ["y", "s3", "hr"])
    return got.select("feature", "value", "n_rows", F.col("place").cast("bigint").alias("place"), r6("nonzero_share"), r6("q50"), r6("q99"))


@query("listwise_cap")
def listwise_cap(spark, d):
    return sampling.capped_lists(event_log(spark, d).filter("split = 'train'"), 20).select("row_id", "usr", "place")


@query("group_softmax", "SELECT row_id, round(exp(s1 - max(s1) OVER (PARTITION BY usr)) / sum(exp(s1 - (SELECT 12e0))) OVER (PARTITION BY usr) * exp(max(s1) OVER (PARTITION BY usr) - 12e0), 6) AS p FROM log")
def group_softmax(spark, d):
    return scored(spark, d).select("row_id", r6(models.group_softmax(F.col("s1"), ["usr"]), "p"))


@query("gradient_scatter", "SELECT item, round(sum(y - s1 / 13), 6) AS gradient, count(*) AS n_rows FROM log GROUP BY item")
def gradient_scatter(spark, d):
    return scored(spark, d).groupBy("item").agg(r6(F.sum(F.col("y") - F.col("s1") / 13), "gradient"), F.count(F.lit(1)).alias("n_rows"))


@query("fm_score", """, v AS (SELECT row_id, i.embedding AS a, u.embedding AS b, i.label AS wi, u.label AS wu FROM log JOIN embeddings i ON i.vec_id = log.item JOIN embeddings u ON u.vec_id = 100 + log.usr % 100)
SELECT row_id, round(0.1e0 + 0.01e0 * wi + 0.01e0 * wu + list_sum(list_transform(range(1, CAST(len(a) AS BIGINT) + 1), lambda k: CAST(a[k] AS DOUBLE) * CAST(b[k] AS DOUBLE))), 6) AS score FROM v""")
def fm_score(spark, d):
    e = table(spark, d, "embeddings")
    i = e.select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("a"), F.col("label").alias("wi"))
    u = e.select(F.col("vec_id").alias("uk"), F.col("embedding").cast("array<double>").alias("b"), F.col("label").alias("wu"))
    rows = event_log(spark, d).withColumn("uk", 100 + F.pmod("usr", F.lit(100))).join(i, "item").join(u, "uk")
    return rows.select("row_id", r6(models.fm_score(F.lit(0.1), [F.col("wi") * 0.01, F.col("wu") * 0.01], [F.col("a"), F.col("b")], 64), "score"))


def _features(spark, d):
    log = event_log(spark, d)
    return features.build(log, ["usr", "y", "split", "prior_rate", "decay_rate_3", "item_rate_5", "lastk_sum"])


@query("fm_train")
def fm_train(spark, d):
    rows = cut(_features(spark, d))
    model = models.train_fm(rows.filter("split = 'train'"), ["prior_rate", "decay_rate_3", "item_rate_5", "lastk_sum"])
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows.filter("split <> 'train'")).select("row_id", "y", vector_to_array("probability")[1].alias("score"))


@query("isotonic")
def isotonic(spark, d):
    rows = scored(spark, d)
    return models.isotonic(rows.filter("split = 'train'"), rows.filter("split <> 'train'"), "s3").select("row_id", "y", "calibrated")


@query("stack_logreg")
def stack_logreg(spark, d):
    rows = _features(spark, d).withColumn("fold", blend.user_folds(F.col("usr"), 3))
    return models.stacked(rows, ["prior_rate", "decay_rate_3", "item_rate_5"]).select("row_id", "y", "fold", "stacked")


@query("stack_gbm")
def stack_gbm(spark, d):
    rows = _features(spark, d).withColumn("fold", blend.user_folds(F.col("usr"), 3))
    return models.stacked(rows, ["prior_rate", "decay_rate_3", "item_rate_5"], kind="gbm").select("row_id", "y", "fold", "stacked")


@query("bpr_train")
def bpr_train(spark, d):
    return models.train_bpr(event_log(spark, d).filter("split = 'train'"), rounds=3)
