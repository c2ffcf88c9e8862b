"""Trained rankers: lambda-rank stumps, out-of-fold label models and factorization machines, with their gradients in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.lineage import cut
from tidemark.operators import blend, boosting, sampling, sequence
from tidemark.operators import factorization as fm
from tidemark.plans import features
from tidemark.queries.base import query, r6, scored
from tidemark.sources import event_log

PLAIN = ["hr", "dur", "s2", "s3"]
LAMBDAS = """, tr AS (SELECT row_id, usr, y, s1 / 13 AS s, hr, dur, s2, s3 FROM log WHERE split = 'train'),
rk AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY s DESC, row_id) AS p, sum(y) OVER (PARTITION BY usr) AS np FROM tr),
id AS (SELECT *, list_sum(list_transform(range(1, CAST(greatest(1, least(np, 20)) AS BIGINT) + 1), lambda k: 1 / log2(k + 1e0))) AS ideal FROM rk),
pr AS (SELECT a.row_id AS i, b.row_id AS j, 1 / (1 + exp(2 * (a.s - b.s))) AS rho, abs(1 / log2(a.p + 1e0) - 1 / log2(b.p + 1e0)) / a.ideal AS w
  FROM id a JOIN id b ON a.usr = b.usr AND a.y = 1 AND b.y = 0 AND least(a.p, b.p) <= 20),
gr AS (SELECT i AS row_id, -2 * rho * w AS g, 4 * rho * (1 - rho) * w AS h FROM pr UNION ALL SELECT j, 2 * rho * w, 4 * rho * (1 - rho) * w FROM pr),
lm AS (SELECT tr.row_id, coalesce(sum(g), 0) AS g, coalesce(sum(h), 0) AS h FROM tr LEFT JOIN gr USING (row_id) GROUP BY tr.row_id)
"""


def _train(spark, d):
    return scored(spark, d).filter("split = 'train'")


@query("lambda_gradients", LAMBDAS + "SELECT row_id, round(g, 6) AS g, round(h, 6) AS h FROM lm")
def lambda_gradients(spark, d):
    return boosting.lambdas(_train(spark, d), F.col("s1") / 13).select("row_id", r6("g"), r6("h"))


@query("stump_first_split", LAMBDAS + """, u AS (UNPIVOT (SELECT row_id, CAST(hr AS DOUBLE) AS hr, dur, s2, s3 FROM tr) ON hr, dur, s2, s3 INTO NAME f VALUE v),
o AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY f) AS n FROM u),
ed AS (SELECT DISTINCT o.f, o.v FROM o, range(1, 16) q(i) WHERE o.k = floor(i / 16e0 * (n - 1))),
b AS (SELECT u.row_id, u.f, 1 + (SELECT count(*) FROM ed WHERE ed.f = u.f AND ed.v < u.v) AS b FROM u),
c AS (SELECT f, b, sum(g) AS g, sum(h) AS h FROM b JOIN lm USING (row_id) GROUP BY f, b),
x AS (SELECT f, b, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(g) OVER (PARTITION BY f) AS tg, sum(h) OVER (PARTITION BY f) AS th, row_number() OVER (PARTITION BY f ORDER BY b DESC) AS z FROM c WINDOW w AS (PARTITION BY f ORDER BY b)),
y AS (SELECT *, lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1) AS gain FROM x WHERE z > 1)
SELECT f AS feature, CAST(b AS BIGINT) AS bin, round(gain, 6) AS gain, round(-lg / (lh + 1), 6) AS left_value, round(-(tg - lg) / (th - lh + 1), 6) AS right_value
FROM y ORDER BY round(gain, 9) DESC, list_position(['hr', 'dur', 's2', 's3'], f), b LIMIT 1""")
def stump_first_split(spark, d):
    s = boosting.first_split(_train(spark, d), PLAIN, F.col("s1") / 13)
    got = spark.createDataFrame([(s["feature"], s["bin"], s["gain"], s["left"], s["right"])] if s else [], "feature string, bin bigint, gain double, left_value double, right_value double")
    return got.select("feature", "bin", r6("gain"), r6("left_value"), r6("right_value"))


HISTORY = ["prior_rate", "decay_rate_3", "item_rate_5", "lastk_sum"]


def _ranker(spark, d):
    rows = cut(features.build(scored(spark, d), ["usr", "y", "split", "hr", "dur", *HISTORY]))
    return rows, boosting.fit_ranker(rows.filter("split = 'train'"), rows.filter("split = 'valid'"), [*HISTORY, "hr", "dur"], rounds=8, patience=4)


@query("lambda_stumps")
def lambda_stumps(spark, d):
    rows, model = _ranker(spark, d)
    return boosting.predict(rows.filter("split <> 'train'"), model).select("row_id", "y", "split", "score")


@query("stump_gain_shares")
def stump_gain_shares(spark, d):
    model = _ranker(spark, d)[1]
    return spark.createDataFrame(sorted(model.shares().items()), "feature string, share double")


#: Second labels of a row, as conditions.
AUX = {"alt": "alt = 1", "clicked": "ctx = 'click'", "long_play": "play >= 75", "short_play": "play < 10", "late": "hr >= 18"}


@query("aux_fold_scores")
def aux_fold_scores(spark, d):
    rows = features.build(scored(spark, d), ["usr", "y", "split", "alt", "ctx", "play", "hr", "s3", *HISTORY]).withColumns({f"l_{k}": F.expr(v).cast("bigint") for k, v in AUX.items()})
    rows = cut(rows.withColumn("fold", F.when(F.col("split") == "train", blend.user_folds(F.col("row_id"), 5))))
    models = boosting.fit_folds(rows.filter("split = 'train'"), [f"l_{k}" for k in AUX], [*HISTORY, "s3"], rounds=5)
    return boosting.fold_scores(rows, models).select("row_id", "split", "fold", *[f"aux_l_{k}" for k in AUX])


FIELDS, DIM = ["usr", "item", "hr"], 4
_VECTOR = "list_transform(range(0, 4), lambda k: (({key} * 7919 + k * 104729 + {size} * 1299709) % 2001 - 1000) / 1000e0)"
FORWARD = (
    ", tr AS (SELECT row_id, usr, item, hr, y, alt, CAST(hr >= 18 AS BIGINT) AS late, "
    + ", ".join(f"{_VECTOR.format(key=f, size=len(f))} AS v_{f}" for f in FIELDS)
    + """ FROM log WHERE split = 'train'),
sm AS (SELECT *, list_transform(range(1, 5), lambda k: v_usr[k] + v_item[k] + v_hr[k]) AS s FROM tr),
fw AS (SELECT *, list_sum(list_transform(range(1, 5), lambda k: s[k] * s[k] - v_usr[k] * v_usr[k] - v_item[k] * v_item[k] - v_hr[k] * v_hr[k])) / 2 AS z FROM sm),
pw AS (SELECT row_id, (1 / (1 + exp(-z)) - y) / (SELECT count(*) FROM fw) AS g FROM fw),
ng AS (SELECT usr, row_id, z, row_number() OVER (PARTITION BY usr ORDER BY row_id) - 1 AS k, count(*) OVER (PARTITION BY usr) AS n FROM fw WHERE y = 0),
"""
)
#: Pairs that both engines can draw: the j-th negative of a positive by its row number.
PAIRED = """pp AS (SELECT p.row_id AS i, ng.row_id AS j, 1 / (1 + exp(p.z - ng.z)) AS c FROM fw p, range(0, {negatives}) q(j), ng WHERE p.y = 1 AND ng.usr = p.usr AND ng.k = (p.row_id * 7919 + q.j * 31) % ng.n),
pg AS (SELECT i AS row_id, -c / (SELECT count(*) FROM pp) AS g FROM pp UNION ALL SELECT j, c / (SELECT count(*) FROM pp) FROM pp),
"""
SCATTER = (
    """gg AS ({g}),
gr AS (SELECT row_id, sum(g) AS g FROM gg GROUP BY row_id),
fl AS ("""
    + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS key, g, s, v_{f} AS v FROM fw JOIN gr USING (row_id)" for f in FIELDS)
    + """)
SELECT field, key, round(sum(g), 6) AS gw, """
    + ", ".join(f"round(sum(g * (s[{k + 1}] - v[{k + 1}])), 6) AS g{k}" for k in range(DIM))
    + " FROM fl GROUP BY field, key"
)


def _fixed_pairs(negatives: int):
    def pairs(rows, k):
        neg = sampling.addressed(rows, ["usr"], "neg_row", 0)
        pos = rows.filter("y = 1").select("usr", F.col("row_id").alias("pos_row")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))))
        return pos.join(neg, "usr").filter(F.col("k") == (F.col("pos_row") * 7919 + F.col("j") * 31) % F.col("n"))

    return pairs


def _gradient(spark, d, loss):
    rows = _train(spark, d).withColumn("late", (F.col("hr") >= 18).cast("bigint")).select("row_id", *FIELDS, "y", "alt", "late")
    start = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda k: ((F.col("key").cast("bigint") * 7919 + k * 104729 + F.length("field") * 1299709) % 2001 - 1000) / 1000.0)
    got = fm.gradient_of(rows, fm.machine(rows, FIELDS, DIM, start=start), loss)
    return got.select("field", "key", r6("gw"), *[r6(F.col("gv")[k], f"g{k}") for k in range(DIM)])


@query("fm_gradient", FORWARD + SCATTER.format(g="SELECT * FROM pw"))
def fm_gradient(spark, d):
    return _gradient(spark, d, fm.pointwise())


@query("bpr_gradient", FORWARD + PAIRED.format(negatives=1) + SCATTER.format(g="SELECT * FROM pg"))
def bpr_gradient(spark, d):
    return _gradient(spark, d, fm.pairwise(_fixed_pairs(1)))


@query("multi_negative_gradient", FORWARD + PAIRED.format(negatives=3) + SCATTER.format(g="SELECT * FROM pg"))
def multi_negative_gradient(spark, d):
    return _gradient(spark, d, fm.pairwise(_fixed_pairs(3)))


@query("hybrid_gradient", FORWARD + PAIRED.format(negatives=1) + SCATTER.format(g="SELECT * FROM pw UNION ALL SELECT row_id, 0.5e0 * g FROM pg"))
def hybrid_gradient(spark, d):
    return _gradient(spark, d, fm.mixed(fm.pointwise(), fm.pairwise(_fixed_pairs(1), 0.5)))


LISTS = """SELECT row_id, (exp(z - m) / e - y / np) / (SELECT count(DISTINCT usr) FROM fw WHERE y = 1) AS g
  FROM (SELECT *, sum(exp(z - m)) OVER (PARTITION BY usr) AS e FROM (SELECT *, max(z) OVER (PARTITION BY usr) AS m, sum(y) OVER (PARTITION BY usr) AS np FROM fw)) WHERE np > 0"""


@query("listwise_gradient", FORWARD + SCATTER.format(g=LISTS))
def listwise_gradient(spark, d):
    return _gradient(spark, d, fm.listwise())


TASKS = """SELECT * FROM pg UNION ALL SELECT row_id, 0.1e0 * (1 / (1 + exp(-z)) - (alt + late) / 2e0) * t / (SELECT count(*) FROM pp)
  FROM fw JOIN (SELECT row_id, count(*) AS t FROM (SELECT i AS row_id FROM pp UNION ALL SELECT j FROM pp) GROUP BY row_id) USING (row_id)"""


@query("multitask_gradient", FORWARD + PAIRED.format(negatives=1) + SCATTER.format(g=TASKS))
def multitask_gradient(spark, d):
    return _gradient(spark, d, fm.multitask(_fixed_pairs(1), ["alt", "late"], 0.1))


def _scores(spark, d, loss, epochs=40):
    """Scores of later rows by a machine on user, item, context and last label, stopped early on the validation split."""
    rows = cut(features.build(event_log(spark, d), ["usr", "item", "ctx", "day", "y", "alt", "split", "last1"]))
    train = rows.filter("split = 'train'")
    m = fm.fit(train, rows.filter("split = 'valid'"), ["usr", "item", "ctx", "last1"], loss(train), epochs, patience=4)
    return fm.predict(rows.filter("split <> 'train'"), m).select("row_id", "y", "split", "score")


@query("fm_pairs_train")
def fm_pairs_train(spark, d):
    return _scores(spark, d, lambda train: fm.pairwise(fm.drawn_pairs("fm", weights=fm.decayed_weights(train))))


@query("fm_pointwise_train")
def fm_pointwise_train(spark, d):
    return _scores(spark, d, lambda train: fm.pointwise())


@query("listwise_train")
def listwise_train(spark, d):
    return _scores(spark, d, lambda train: fm.listwise())


@query("hybrid_train")
def hybrid_train(spark, d):
    return _scores(spark, d, lambda train: fm.mixed(fm.pointwise(), fm.pairwise(fm.drawn_pairs("hybrid", 2))), 3)


@query("multitask_train")
def multitask_train(spark, d):
    return _scores(spark, d, lambda train: fm.multitask(fm.drawn_pairs("tasks"), ["alt"]))


@query("attention_pretrained")
def attention_pretrained(spark, d):
    log = event_log(spark, d)
    vectors = fm.item_vectors(log.filter("split = 'train'"), 8, epochs=2)
    return sequence.attention_pool(log, vectors, 10, 8).select("row_id", "pooled")
