"""Buckets, vocabularies and other encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import bucket_right, cyclic_hour, duration_bucket, hour_bucket, smoothed_rate
from tidemark.operators import encode, history
from tidemark.queries.base import query, r6
from tidemark.sources import event_log

ROUNDED = ", lr AS (SELECT * REPLACE (round(play, 2) AS play) FROM log), ed AS (SELECT list_transform(quantile_cont(play, [{q}]), lambda x: round(x, 4)) AS e FROM lr WHERE split = 'train')\n"


def _q(n: int) -> str:
    return ", ".join(f"{i / n}" for i in range(1, n))


def _rounded(spark, d, n):
    """Values with two digits and edges with four, so that both engines bucket alike."""
    log = event_log(spark, d).withColumn("play", F.round("play", 2))
    e = encode.edges(log.filter("split = 'train'"), F.col("play"), n).select(F.transform("edges", lambda x: F.round(x, 4)).alias("edges"))
    return log.join(F.broadcast(e))


@query("quantile_edges", f"SELECT list_transform(quantile_cont(play, [{_q(8)}]), lambda x: round(x, 4)) AS edges FROM log WHERE split = 'train'")
def quantile_edges(spark, d):
    return encode.edges(event_log(spark, d).filter("split = 'train'"), F.col("play"), 8).select(F.transform("edges", lambda x: F.round(x, 4)).alias("edges"))


@query("bucket_quantile_left", ROUNDED.format(q=_q(8)) + "SELECT row_id, CAST(len(list_filter(e, lambda x: x < play)) AS BIGINT) AS bucket FROM lr, ed")
def bucket_quantile_left(spark, d):
    from tidemark.functions import bucket_left

    return _rounded(spark, d, 8).select("row_id", bucket_left(F.col("edges"), F.col("play")).alias("bucket"))


@query("bucket_quantile_right", ROUNDED.format(q=_q(3)) + "SELECT row_id, CAST(len(list_filter(e, lambda x: x <= play)) AS BIGINT) AS bucket FROM lr, ed")
def bucket_quantile_right(spark, d):
    return _rounded(spark, d, 3).select("row_id", bucket_right(F.col("edges"), F.col("play")).alias("bucket"))


@query("bucket_fixed", "SELECT row_id, CAST(CASE WHEN dur < 15 THEN 0 WHEN dur < 30 THEN 1 WHEN dur < 60 THEN 2 WHEN dur < 120 THEN 3 WHEN dur < 300 THEN 4 ELSE 5 END AS BIGINT) AS bucket FROM log")
def bucket_fixed(spark, d):
    return event_log(spark, d).select("row_id", duration_bucket(F.col("dur")).alias("bucket"))


@query("hour_bucket", "SELECT row_id, hr // 4 AS bucket FROM log")
def hour_bucket_q(spark, d):
    return event_log(spark, d).select("row_id", hour_bucket(F.col("hr") * 100).alias("bucket"))


@query("hour_cyclic", "SELECT row_id, round(sin(hr * 2 * pi() / 24), 6) AS hour_sin, round(cos(hr * 2 * pi() / 24), 6) AS hour_cos FROM log")
def hour_cyclic(spark, d):
    s, c = cyclic_hour(F.col("hr"))
    return event_log(spark, d).select("row_id", r6(s, "hour_sin"), r6(c, "hour_cos"))


@query("vocab_encode", """, tr AS (SELECT * FROM log WHERE split = 'train' AND usr % 10 <> 0), vi AS (SELECT item, row_number() OVER (ORDER BY min(row_id)) - 1 AS id FROM tr GROUP BY item), vc AS (SELECT usr, row_number() OVER (ORDER BY min(row_id)) - 1 AS id FROM tr GROUP BY usr)
SELECT row_id, coalesce(vi.id, (SELECT count(*) FROM vi)) AS item_id, (SELECT count(*) FROM vi) + 1 + coalesce(vc.id, (SELECT count(*) FROM vc)) AS usr_id FROM log LEFT JOIN vi ON vi.item = log.item LEFT JOIN vc ON vc.usr = log.usr""")
def vocab_encode(spark, d):
    log = event_log(spark, d)
    return encode.encoded(log, log.filter("split = 'train' AND usr % 10 <> 0"), ["item", "usr"]).select("row_id", "item_id", "usr_id")


@query("sorted_vocabulary", "SELECT item AS value, row_number() OVER (ORDER BY item) + 1 AS id FROM (SELECT DISTINCT item FROM log WHERE split = 'train')")
def sorted_vocabulary(spark, d):
    return encode.sorted_vocabulary(event_log(spark, d).filter("split = 'train'"), "item")


@query("oov_to_null", "SELECT row_id, CASE WHEN item IN (SELECT item FROM log WHERE split = 'train' AND item % 9 <> 0) THEN CAST(item AS VARCHAR) END AS known FROM log")
def oov_to_null(spark, d):
    log = event_log(spark, d)
    return encode.known_only(log, log.filter("split = 'train' AND item % 9 <> 0"), "item", "known").select("row_id", F.col("known").cast("string").alias("known"))


@query("onehot_dummies", "SELECT row_id, CAST(ctx = 'click' AS DOUBLE) AS ctx_click, CAST(ctx = 'error' AS DOUBLE) AS ctx_error, CAST(ctx = 'view' AS DOUBLE) AS ctx_view FROM log")
def onehot_dummies(spark, d):
    return encode.one_hot(event_log(spark, d), "ctx", ["click", "error", "view"]).select("row_id", "ctx_click", "ctx_error", "ctx_view")


@query("tier_cross", ROUNDED.format(q=_q(3)) + """, vc AS (SELECT ctx, row_number() OVER (ORDER BY min(row_id)) - 1 AS id FROM log WHERE split = 'train' AND ctx <> 'signup' GROUP BY ctx)
SELECT row_id, CAST(len(list_filter(e, lambda x: x <= play)) * ((SELECT count(*) FROM vc) + 1) + coalesce(vc.id, (SELECT count(*) FROM vc)) AS BIGINT) AS code FROM lr CROSS JOIN ed LEFT JOIN vc ON vc.ctx = lr.ctx""")
def tier_cross(spark, d):
    rows = _rounded(spark, d, 3)
    v = encode.vocabulary(event_log(spark, d).filter("split = 'train' AND ctx <> 'signup'"), "ctx").withColumnRenamed("value", "ctx")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    got = rows.join(F.broadcast(n)).join(v, "ctx", "left")
    return got.select("row_id", (bucket_right(F.col("edges"), F.col("play")) * (F.col("n") + 1) + F.coalesce("id", "n")).alias("code"))


@query("undefined_gap_bucket", """, n AS (SELECT row_id, split, t - lag(t) OVER (PARTITION BY usr ORDER BY t, row_id) AS gap FROM log), ge AS (SELECT list_transform(quantile_cont(gap, [0.25, 0.5, 0.75]), lambda x: floor(x) + 0.5e0) AS e FROM n WHERE split = 'train' AND gap >= 0)
SELECT row_id, CASE WHEN gap IS NULL THEN 'UNK' ELSE CAST(len(list_filter(e, lambda x: x < gap)) AS VARCHAR) END AS bucket FROM n, ge""")
def undefined_gap_bucket(spark, d):
    from tidemark.functions import bucket_left

    m = history.momentum(event_log(spark, d))
    e = encode.edges(m.filter("split = 'train' AND gap_ms >= 0"), F.col("gap_ms"), 4).select(F.transform("edges", lambda x: F.floor(x) + 0.5).alias("edges"))
    return m.join(F.broadcast(e)).select("row_id", F.when(F.col("gap_ms") < 0, "UNK").otherwise(bucket_left(F.col("edges").cast("array<double>"), F.col("gap_ms")).cast("string")).alias("bucket"))


@query("rate_interactions", """, h AS (SELECT r.row_id, r.dur, count(p.row_id) AS n, (coalesce(sum(p.y), 0) + 0.5e0) / (count(p.row_id) + 1) AS r, (coalesce(sum(p.alt), 0) + 0.5e0) / (count(p.row_id) + 1) AS q FROM log r LEFT JOIN log p ON p.usr = r.usr AND p.day < r.day GROUP BY r.row_id, r.dur)
SELECT row_id, round(r * q, 6) AS product, round(r / (q + 0.01e0), 6) AS ratio, round(r - q, 6) AS difference, round(r / (dur + 1), 6) AS per_duration, round(r * ln(1 + n), 6) AS by_activity FROM h""")
def rate_interactions(spark, d):
    h = history.day_history(event_log(spark, d), ["usr"], {"p": F.col("y"), "a": F.col("alt"), "n": F.lit(1)})
    r, q = smoothed_rate(F.col("p"), F.col("n")), smoothed_rate(F.col("a"), F.col("n"))
    return h.select("row_id", r6(r * q, "product"), r6(r / (q + 0.01), "ratio"), r6(r - q, "difference"), r6(r / (F.col("dur") + 1), "per_duration"), r6(r * F.log1p("n"), "by_activity"))


_COLS = [("usr", "CAST(usr AS VARCHAR)"), ("ctx", "ctx"), ("last1", "CAST(last1 AS VARCHAR)")]
_NUMBERS = ["dur", "activity", "gap_ms"]
_EDGES = ", ".join(f"list_transform(quantile_cont({v}, [{', '.join(f'{i / 5}e0' for i in range(1, 5))}]), lambda e: round(e, 6)) AS e_{n}" for n, v in (("dur", "dur"), ("activity", "activity"), ("gap_ms", "CASE WHEN gap_ms >= 0 THEN gap_ms END")))
_CODES = ", ".join(f"CASE WHEN {n} IS NULL OR {n} < 0 THEN 'UNK' ELSE CAST(len(list_filter(e_{n}, lambda e: e < {n})) AS VARCHAR) END AS {n}" for n in _NUMBERS)
_ALL = [n for n, _ in _COLS] + _NUMBERS
ENCODED = (
    """, h AS (SELECT a.row_id, count(b.row_id) AS activity FROM log a LEFT JOIN log b ON a.usr = b.usr AND b.day < a.day GROUP BY a.row_id),
f AS (SELECT row_id, split, usr, ctx, dur, activity, coalesce(lag(y) OVER w, -1) AS last1, coalesce(t - lag(t) OVER w, -1) AS gap_ms FROM log JOIN h USING (row_id) WINDOW w AS (PARTITION BY usr ORDER BY t, row_id)),
"""
    + f"ed AS (SELECT {_EDGES} FROM f WHERE split = 'train'),\n"
    + f"c AS (SELECT row_id, split, {', '.join(f'{v} AS {n}' for n, v in _COLS)}, {_CODES} FROM f, ed),\n"
    + "u AS (" + " UNION ALL ".join(f"SELECT {i} AS k, row_id, {n} AS value FROM c WHERE split = 'train'" for i, n in enumerate(_ALL)) + "),\n"
    + "v AS (SELECT k, value, row_number() OVER (ORDER BY k, min(row_id), value) - 1 + k AS id FROM u GROUP BY k, value),\n"
    + "z AS (SELECT k, max(id) + 1 AS id FROM v GROUP BY k)\nSELECT c.row_id, c.split, "
    + ", ".join(f"CAST(coalesce((SELECT id FROM v WHERE k = {i} AND v.value = c.{n}), (SELECT id FROM z WHERE k = {i})) AS BIGINT) AS {n}_id" for i, n in enumerate(_ALL))
    + " FROM c"
)


@query("encoded_features", ENCODED)
def encoded_features(spark, d):
    from tidemark.plans import features

    return features.encoded(event_log(spark, d), [n for n, _ in _COLS], _NUMBERS, 5)
