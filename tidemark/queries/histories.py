"""Causal history features; the SQL counterparts are self-joins, independent of the plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import history_bucket, smoothed_rate, watch_fraction
from tidemark.operators import history, sequence
from tidemark.plans import features
from tidemark.queries.base import query, r6
from tidemark.sources import event_log, table


def _prior_sql(keys: list[str], cols: str, src: str = "log") -> str:
    on = " AND ".join(f"p.{k} = r.{k}" for k in keys)
    return f"SELECT r.row_id, {cols} FROM {src} r LEFT JOIN {src} p ON {on} AND p.day < r.day GROUP BY r.row_id"


def _sum(v: str, name: str) -> str:
    return f"CAST(coalesce(sum(p.{v}), 0) AS BIGINT) AS {name}"


def _decay(v: str, h: float, name: str) -> str:
    return f"round(coalesce(sum({v} * pow(0.5e0, (r.day - p.day) / {h}e0)), 0), 6) AS {name}"


def _raw(v: str, h: float) -> str:
    return f"coalesce(sum({v} * pow(0.5e0, (r.day - p.day) / {h}e0)), 0)"


def _rate(h: float, name: str, v: str = "p.y") -> str:
    return f"round(({_raw(v, h)} + 0.5e0) / (coalesce(sum(CASE WHEN p.row_id IS NOT NULL THEN pow(0.5e0, (r.day - p.day) / {h}e0) END), 0) + 1), 6) AS {name}"


@query("prior_activity", _prior_sql(["usr"], f"count(p.row_id) AS activity, {_sum('y', 'prior_pos')}"))
def prior_activity(spark, d):
    return history.day_history(event_log(spark, d), ["usr"], {"activity": F.lit(1), "prior_pos": F.col("y")}).select("row_id", F.col("activity").cast("bigint").alias("activity"), "prior_pos")


@query("prior_tab_pos", _prior_sql(["usr", "ctx"], _sum("y", "tab_pos")))
def prior_tab_pos(spark, d):
    return history.day_history(event_log(spark, d), ["usr", "ctx"], {"tab_pos": F.col("y")}).select("row_id", "tab_pos")


@query("prior_user_item_pos", _prior_sql(["usr", "item"], _sum("y", "pair_pos")))
def prior_user_item_pos(spark, d):
    return history.day_history(event_log(spark, d), ["usr", "item"], {"pair_pos": F.col("y")}).select("row_id", "pair_pos")


@query("prior_item_pop", _prior_sql(["item"], f"count(p.row_id) AS item_total, {_sum('y', 'item_pos')}"))
def prior_item_pop(spark, d):
    return history.day_history(event_log(spark, d), ["item"], {"item_total": F.lit(1), "item_pos": F.col("y")}).select("row_id", F.col("item_total").cast("bigint").alias("item_total"), "item_pos")


AUTHOR = ", la AS (SELECT log.*, p.p_brand AS author FROM log JOIN part p ON p.p_partkey = CASE WHEN log.item = 0 THEN 1 ELSE log.item END)\n"


def _with_author(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("_k"), F.col("p_brand").alias("author"), F.split("p_type", " ")[0].alias("tag"))
    log = event_log(spark, d)
    return log.join(part, F.when(F.col("item") == 0, 1).otherwise(F.col("item")) == F.col("_k")).drop("_k")


AUTHOR_SUMS = ", k AS (SELECT author, day, sum(y) AS y, count(*) AS n FROM la GROUP BY author, day), h AS (SELECT a.author, a.day, coalesce(sum(b.y), 0) AS p, coalesce(sum(b.n), 0) AS n FROM k a LEFT JOIN k b ON a.author = b.author AND b.day < a.day GROUP BY a.author, a.day)\n"


@query("prior_author_rate", AUTHOR + AUTHOR_SUMS + "SELECT row_id, CAST(h.p AS BIGINT) AS author_pos, round((h.p + 1e0) / (h.n + 2e0), 6) AS author_rate FROM la JOIN h ON h.author = la.author AND h.day = la.day")
def prior_author_rate(spark, d):
    h = history.day_history(_with_author(spark, d), ["author"], {"author_pos": F.col("y"), "author_n": F.lit(1)})
    return h.select("row_id", "author_pos", r6(smoothed_rate(F.col("author_pos"), F.col("author_n"), 1.0), "author_rate"))


@query("decay_user_2_5", _prior_sql(["usr"], _decay("p.y", 2.5, "decayed_pos") + ", " + _rate(2.5, "decayed_rate")))
def decay_user(spark, d):
    h = history.day_history(event_log(spark, d), ["usr"], {}, {"p": (F.col("y"), 2.5), "n": (F.lit(1), 2.5)})
    return h.select("row_id", r6("p", "decayed_pos"), r6(smoothed_rate(F.col("p"), F.col("n")), "decayed_rate"))


@query("decay_user_multi_h", _prior_sql(["usr"], ", ".join(_decay("p.y", h, f"pos_{n}") for h, n in ((1.0, "1"), (3.0, "3"), (7.0, "7"), (14.0, "14")))))
def decay_user_multi_h(spark, d):
    hs = {"pos_1": 1.0, "pos_3": 3.0, "pos_7": 7.0, "pos_14": 14.0}
    return history.day_history(event_log(spark, d), ["usr"], {}, {n: (F.col("y"), h) for n, h in hs.items()}).select("row_id", *[r6(n) for n in hs])


def _keyed_rate(name: str, keys: list[str], h: float, src: str = "log", head: str = "", rows=event_log, extra: dict | None = None):
    @query(name, head + _prior_sql(keys, _rate(h, "rate"), src))
    def f(spark, d):
        log = rows(spark, d)
        for c, e in (extra or {}).items():
            log = log.withColumn(c, e())
        g = history.day_history(log, keys, {}, {"p": (F.col("y"), h), "n": (F.lit(1), h)})
        return g.select("row_id", r6(smoothed_rate(F.col("p"), F.col("n")), "rate"))

    return f


@query("decay_tab_count", _prior_sql(["usr", "ctx"], _decay("p.y", 3.0, "tab_pos")))
def decay_tab_count(spark, d):
    return history.day_history(event_log(spark, d), ["usr", "ctx"], {}, {"tab_pos": (F.col("y"), 3.0)}).select("row_id", r6("tab_pos"))


TAGS = ", lt AS (SELECT log.*, p.p_brand AS author, split_part(p.p_type, ' ', 1) AS tag FROM log JOIN part p ON p.p_partkey = CASE WHEN log.item = 0 THEN 1 ELSE log.item END)\n"
DURS = ", ld AS (SELECT *, CASE WHEN dur < 15 THEN 0 WHEN dur < 30 THEN 1 WHEN dur < 60 THEN 2 WHEN dur < 120 THEN 3 WHEN dur < 300 THEN 4 ELSE 5 END AS db, hr // 4 AS hb FROM log)\n"


def _durs():
    from tidemark.functions import duration_bucket

    return duration_bucket(F.col("dur"))


_keyed_rate("decay_tab_rate", ["usr", "ctx"], 3.0)
_keyed_rate("decay_tag_rate", ["usr", "tag"], 3.0, "lt", TAGS, _with_author)
_keyed_rate("decay_author_rate", ["usr", "author"], 3.0, "lt", TAGS, _with_author)
_keyed_rate("decay_bucket_rate", ["usr", "db"], 3.0, "ld", DURS, extra={"db": _durs})
_keyed_rate("decay_hour_rate", ["usr", "hb"], 3.0, "ld", DURS, extra={"hb": lambda: F.floor(F.col("hr") / 4)})
_keyed_rate("decay_cross_rate", ["usr", "ctx", "db"], 3.0, "ld", DURS, extra={"db": _durs})
_keyed_rate("decay_item_rate", ["item"], 5.0)


@query("decay_engagement_rate", _prior_sql(["usr"], _rate(5.0, "rate", "p.alt")))
def decay_engagement_rate(spark, d):
    h = history.day_history(event_log(spark, d), ["usr"], {}, {"p": (F.col("alt"), 5.0), "n": (F.lit(1), 5.0)})
    return h.select("row_id", r6(smoothed_rate(F.col("p"), F.col("n")), "rate"))


@query("final_decayed_pos", ", tr AS (SELECT * FROM log WHERE split = 'train') SELECT usr, round(sum(y * pow(0.5e0, ((SELECT max(day) FROM tr) - day) / 3e0)), 6) AS decayed_pos FROM tr GROUP BY usr")
def final_decayed_pos(spark, d):
    tr = event_log(spark, d).filter("split = 'train'")
    last = tr.agg(F.max("day").alias("ref"))
    return tr.join(F.broadcast(last)).groupBy("usr").agg(r6(F.sum(F.col("y") * F.pow(F.lit(0.5), (F.col("ref") - F.col("day")) / 3.0)), "decayed_pos"))


@query("sampling_weight_cum", """, tr AS (SELECT * FROM log WHERE split = 'train'), w AS (SELECT usr, pow(sum(y * pow(0.5e0, ((SELECT max(day) FROM tr) - day) / 3e0)), 0.75e0) AS w FROM tr GROUP BY usr)
SELECT usr, round(w, 6) AS w, round(sum(w) OVER (ORDER BY usr), 6) AS hi FROM w""")
def sampling_weight_cum(spark, d):
    from tidemark.operators.sampling import cumulative_weights

    tr = event_log(spark, d).filter("split = 'train'")
    last = tr.agg(F.max("day").alias("ref"))
    w = tr.join(F.broadcast(last)).groupBy("usr").agg(F.pow(F.sum(F.col("y") * F.pow(F.lit(0.5), (F.col("ref") - F.col("day")) / 3.0)), 0.75).alias("w"))
    return cumulative_weights(w).select("usr", r6("w"), r6("hi"))


MOMENTUM = """, hourly AS (SELECT * REPLACE (t // 3600000 * 3600000 AS t) FROM log), n AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY t, row_id) AS k FROM hourly)\n"""


def _hourly(spark, d):
    """Times cut to the hour, so that ties occur."""
    return event_log(spark, d).withColumn("t", F.floor(F.col("t") / 3600000) * 3600000)


@query("last1", MOMENTUM + "SELECT a.row_id, coalesce(b.y, -1) AS last1 FROM n a LEFT JOIN n b ON a.usr = b.usr AND b.k = a.k - 1")
def last1(spark, d):
    return history.momentum(_hourly(spark, d)).select("row_id", "last1")


@query("lastk_rate", MOMENTUM + "SELECT a.row_id, CAST(coalesce(sum(b.y), 0) AS BIGINT) AS lastk_sum, count(b.y) AS lastk_cnt FROM n a LEFT JOIN n b ON a.usr = b.usr AND b.k BETWEEN a.k - 5 AND a.k - 1 GROUP BY a.row_id")
def lastk_rate(spark, d):
    return history.momentum(_hourly(spark, d)).select("row_id", "lastk_sum", "lastk_cnt")


@query("gap_ms", MOMENTUM + "SELECT a.row_id, coalesce(a.t - b.t, -1) AS gap_ms FROM n a LEFT JOIN n b ON a.usr = b.usr AND b.k = a.k - 1")
def gap_ms(spark, d):
    return history.momentum(_hourly(spark, d)).select("row_id", "gap_ms")


@query("uniform_rate_20", MOMENTUM + "SELECT a.row_id, round(coalesce(avg(b.y), -1e0), 6) AS rate FROM n a LEFT JOIN n b ON a.usr = b.usr AND b.k BETWEEN a.k - 20 AND a.k - 1 GROUP BY a.row_id")
def uniform_rate_20(spark, d):
    return history.uniform_rate(_hourly(spark, d), 20).select("row_id", r6("rate"))


WF = ", hw AS (SELECT * REPLACE (t // 3600000 * 3600000 AS t), CASE WHEN dur > 0 THEN greatest(0e0, least(1e0, play / dur)) END AS v FROM log)\n"


@query("watch_fraction", WF + "SELECT row_id, round(v, 6) AS fraction FROM hw")
def watch_fraction_q(spark, d):
    return event_log(spark, d).select("row_id", r6(watch_fraction(F.col("play"), F.col("dur")), "fraction"))


def _mean_sql(keys: list[str], h: float) -> str:
    on = " AND ".join(f"p.{k} = r.{k}" for k in keys)
    wt = f"pow(0.5e0, (r.t - p.t) / (86400000e0 * {h}))"
    return WF + f"SELECT r.row_id, round(sum(p.v * {wt}) / sum(CASE WHEN p.v IS NOT NULL THEN {wt} END), 6) AS mean FROM hw r LEFT JOIN hw p ON {on} AND p.t < r.t GROUP BY r.row_id"


@query("watch_decay_mean", _mean_sql(["usr"], 2.5))
def watch_decay_mean(spark, d):
    v = watch_fraction(F.col("play"), F.col("dur"))
    return history.exclusive_decayed_mean(_hourly(spark, d), ["usr"], v, 2.5, "mean").select("row_id", r6("mean"))


@query("watch_tab_decay_mean", _mean_sql(["usr", "ctx"], 3.0))
def watch_tab_decay_mean(spark, d):
    v = watch_fraction(F.col("play"), F.col("dur"))
    return history.exclusive_decayed_mean(_hourly(spark, d), ["usr", "ctx"], v, 3.0, "mean").select("row_id", r6("mean"))


@query("watch_last5_mean", WF + """, r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY t, row_id) AS k, min(row_id) OVER (PARTITION BY usr, t) AS f FROM hw), s AS (SELECT *, min(k) OVER (PARTITION BY usr, t) AS k0 FROM r)
SELECT a.row_id, round(avg(b.v), 6) AS mean FROM s a LEFT JOIN s b ON a.usr = b.usr AND b.k BETWEEN a.k0 - 5 AND a.k0 - 1 GROUP BY a.row_id""")
def watch_last5_mean(spark, d):
    v = watch_fraction(F.col("play"), F.col("dur"))
    return history.exclusive_last_mean(_hourly(spark, d), "usr", v, 5, "mean").select("row_id", r6("mean"))


@query("tie_flags", ", hourly AS (SELECT * REPLACE (t // 3600000 * 3600000 AS t) FROM log) SELECT row_id, count(*) OVER (PARTITION BY usr, t) > 1 AS tied, min(t) OVER (PARTITION BY usr, day) < t AS same_day_earlier FROM hourly")
def tie_flags(spark, d):
    return history.tie_flags(_hourly(spark, d)).select("row_id", "tied", "same_day_earlier")


def _emb(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))


def _attention_sql(width: int, decay: str) -> str:
    return f""", n AS (SELECT log.*, e.embedding AS vec, len(e.embedding) AS dim, row_number() OVER (PARTITION BY usr ORDER BY t, row_id) AS k FROM log LEFT JOIN embeddings e ON e.vec_id = log.item),
z AS (SELECT a.row_id, b.y, list_sum(list_transform(range(1, CAST(a.dim AS BIGINT) + 1), lambda i: CAST(a.vec[i] AS DOUBLE) * CAST(b.vec[i] AS DOUBLE))) / 8e0 {decay} AS z
  FROM n a JOIN n b ON a.usr = b.usr AND b.k BETWEEN a.k - {width} AND a.k - 1 WHERE a.vec IS NOT NULL AND b.vec IS NOT NULL),
m AS (SELECT row_id, max(z) AS m FROM z GROUP BY row_id),
p AS (SELECT z.row_id, sum(exp(z - m) * y) / sum(exp(z - m)) AS v FROM z JOIN m ON m.row_id = z.row_id GROUP BY z.row_id)
SELECT log.row_id, round(coalesce(v, -1e0), 6) AS pooled FROM log LEFT JOIN p ON p.row_id = log.row_id"""


@query("attention_pool", _attention_sql(10, ""))
def attention_pool(spark, d):
    return sequence.attention_pool(event_log(spark, d), _emb(spark, d), 10, 64).select("row_id", r6("pooled"))


@query("attention_decay_pool", _attention_sql(20, "- (a.t - b.t) / 86400000e0 * (ln(2e0) / 3e0)"))
def attention_decay_pool(spark, d):
    return sequence.attention_pool(event_log(spark, d), _emb(spark, d), 20, 64, half_life_days=3.0).select("row_id", r6("pooled"))


@query("history_sequence", """, v AS (SELECT item, row_number() OVER (ORDER BY item) + 1 AS id FROM (SELECT DISTINCT item FROM log WHERE split = 'train' AND item % 9 <> 0)),
n AS (SELECT log.row_id, usr, coalesce(v.id, 1) AS id, row_number() OVER (PARTITION BY usr ORDER BY t, row_id) AS k FROM log LEFT JOIN v ON v.item = log.item)
SELECT a.row_id, coalesce(string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.k), '') AS ids, count(b.id) AS n_items FROM n a LEFT JOIN n b ON a.usr = b.usr AND b.k BETWEEN a.k - 20 AND a.k - 1 GROUP BY a.row_id""")
def history_sequence(spark, d):
    from tidemark.operators.encode import sorted_vocabulary

    log = event_log(spark, d)
    v = sorted_vocabulary(log.filter("split = 'train' AND item % 9 <> 0"), "item").withColumnRenamed("value", "item")
    got = sequence.item_sequence(log, v, 20)
    return got.select("row_id", F.array_join(F.filter("seq", lambda x: x > 0).cast("array<string>"), ",").alias("ids"), F.col("seq_len").alias("n_items"))


@query("history_pointers", """, n AS (SELECT row_id, usr, item, y, row_number() OVER (PARTITION BY usr ORDER BY t, row_id) AS k FROM log)
SELECT a.row_id, count(b.row_id) AS n_hist, CAST(coalesce(sum(b.row_id), 0) AS BIGINT) AS row_sum, CAST(coalesce(sum(b.item * b.y), 0) AS BIGINT) AS item_sum FROM n a LEFT JOIN n b ON a.usr = b.usr AND b.k BETWEEN a.k - 40 AND a.k - 1 GROUP BY a.row_id""")
def history_pointers(spark, d):
    h = sequence.history_pointers(event_log(spark, d), 40)
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return h.select("row_id", F.size("hist_rows").cast("bigint").alias("n_hist"), add(F.col("hist_rows")).alias("row_sum"), add(F.zip_with("hist_items", "hist_labels", lambda a, b: a * b)).alias("item_sum"))


@query("history_bucket", ", h AS (" + _prior_sql(["usr"], _sum("y", "c")) + ") SELECT row_id, CAST(CASE WHEN c <= 2 THEN c WHEN c <= 5 THEN 3 ELSE 4 END AS BIGINT) AS bucket FROM h")
def history_bucket_q(spark, d):
    return history.day_history(event_log(spark, d), ["usr"], {"c": F.col("y")}).select("row_id", history_bucket(F.col("c")).alias("bucket"))


@query("feature_set", _prior_sql(["usr"], f"count(p.row_id) AS activity, {_rate(2.5, 'decay_rate')}, {_decay('p.y', 5.0, 'decay_pos')}"))
def feature_set(spark, d):
    got = features.build(event_log(spark, d), ["activity", "decay_rate_2.5", "decay_pos_5"])
    return got.select("row_id", F.col("activity").cast("bigint").alias("activity"), r6(F.col("`decay_rate_2.5`"), "decay_rate"), r6("decay_pos_5", "decay_pos"))


@query("undated_history", """, n AS (SELECT row_id, usr, y, CASE WHEN row_id % 7 <> 0 THEN day * CASE WHEN usr % 2 = 0 THEN 400 ELSE 1 END END AS day FROM log),
k AS (SELECT usr, day, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM n WHERE day IS NOT NULL GROUP BY usr, day),
h AS (SELECT a.usr, a.day, CAST(sum(b.n) AS BIGINT) AS activity, sum(b.pos * pow(0.5e0, (a.day - b.day) / 2.5e0)) AS decayed FROM k a JOIN k b ON a.usr = b.usr AND b.day < a.day GROUP BY a.usr, a.day)
SELECT row_id, coalesce(activity, 0) AS activity, round(coalesce(decayed, 0e0), 6) AS decayed FROM n LEFT JOIN h ON n.usr = h.usr AND n.day = h.day""")
def undated_history(spark, d):
    """Some rows have no day; half of the users span thousands of half-lives."""
    day = F.when(F.col("row_id") % 7 != 0, F.col("day") * F.when(F.col("usr") % 2 == 0, 400).otherwise(1))
    h = history.day_history(event_log(spark, d).withColumn("day", day), ["usr"], {"activity": F.lit(1)}, {"decayed": (F.col("y"), 2.5)})
    return h.select("row_id", F.col("activity").cast("bigint").alias("activity"), r6("decayed"))


@query("long_span_mean", """, n AS (SELECT row_id, usr, t * 300 AS t, CASE WHEN row_id % 3 = 0 THEN NULL ELSE play END AS v FROM log),
p AS (SELECT a.row_id, b.v, b.t, max(b.t) OVER (PARTITION BY a.row_id) AS m FROM n a JOIN n b ON a.usr = b.usr AND b.t < a.t AND b.v IS NOT NULL),
g AS (SELECT row_id, sum(v * pow(0.5e0, (m - t) / 216e6)) / sum(pow(0.5e0, (m - t) / 216e6)) AS mean FROM p GROUP BY row_id)
SELECT row_id, round(mean, 6) AS mean FROM n LEFT JOIN g USING (row_id)""")
def long_span_mean(spark, d):
    """Instants drawn apart, so that a key spans thousands of half-lives."""
    log = event_log(spark, d).withColumn("t", F.col("t") * 300)
    v = F.when(F.col("row_id") % 3 != 0, F.col("play"))
    return history.exclusive_decayed_mean(log, ["usr"], v, 2.5, "mean").select("row_id", r6("mean"))
