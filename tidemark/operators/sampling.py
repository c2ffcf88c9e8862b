"""Deterministic samplers: draws are keyed hashes, addressed by row numbers and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.lineage import Ranges, numbered, place, spread_numbers


def draw(i: Column, stream: str) -> Column:
    """A number from 0 to 2**32 - 1 for draw ``i`` of a stream (crc32, so other engines can follow)."""
    return F.crc32(F.concat(F.lit(f"{stream}:"), i.cast("string")).cast("binary"))


def addressed(log: DataFrame, keys: list[str], name: str, label: int | None = None) -> DataFrame:
    """Rows with their number (from 0) within the key, and the key's count as ``n``."""
    rows = log if label is None else log.filter(F.col("y") == label)
    w = Window.partitionBy(*keys)
    return rows.select(*keys, F.col("row_id").alias(name), (F.row_number().over(w.orderBy("row_id")) - 1).cast("bigint").alias("k"), F.count(F.lit(1)).over(w).alias("n"))


def eligible(log: DataFrame) -> DataFrame:
    """Users with a positive and a negative, numbered from 0 by id, with both counts."""
    users = log.groupBy("usr").agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg")).filter("n_pos > 0 AND n_neg > 0")
    return numbered(users, ["usr"], "u")


def pairs(log: DataFrame, n: int, negatives: int = 1, stream: str = "pair") -> DataFrame:
    """``n`` draws of an eligible user with a positive and ``negatives`` negatives of theirs, with replacement."""
    users = eligible(log)
    many = users.agg(F.count(F.lit(1)).alias("m"))
    draws = log.sparkSession.range(n).withColumnRenamed("id", "i").join(F.broadcast(many)).withColumn("u", F.pmod(draw(F.col("i"), f"{stream}-user"), F.col("m"))).drop("m")
    draws = draws.join(users, "u").withColumn("kp", F.pmod(draw(F.col("i"), f"{stream}-pos"), F.col("n_pos")))
    draws = draws.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(negatives - 1).cast("bigint"))))
    draws = draws.withColumn("kn", F.pmod(draw(F.col("i") * negatives + F.col("j"), f"{stream}-neg"), F.col("n_neg")))
    pos = addressed(log, ["usr"], "pos_row", 1).select("usr", F.col("k").alias("kp"), "pos_row")
    neg = addressed(log, ["usr"], "neg_row", 0).select("usr", F.col("k").alias("kn"), "neg_row")
    return draws.join(pos, ["usr", "kp"]).join(neg, ["usr", "kn"]).select("i", "j", "usr", "pos_row", "neg_row")


def positive_pairs(log: DataFrame, stream: str = "bpr") -> DataFrame:
    """Every positive of a user with negatives, each with a drawn negative of theirs: usr, pos_row, pos_item, neg_row, neg_item."""
    w = Window.partitionBy("usr")
    neg = log.filter("y = 0").select("usr", F.col("row_id").alias("neg_row"), F.col("item").alias("neg_item"), (F.row_number().over(w.orderBy("row_id")) - 1).cast("bigint").alias("kn"))
    sizes = log.filter("y = 0").groupBy("usr").agg(F.count(F.lit(1)).alias("n_neg"))
    pos = log.filter("y = 1").select("usr", F.col("row_id").alias("pos_row"), F.col("item").alias("pos_item"))
    drawn = pos.join(sizes, "usr").withColumn("kn", F.pmod(draw(F.col("pos_row"), f"{stream}-neg"), F.col("n_neg")))
    return drawn.join(neg, ["usr", "kn"]).select("usr", "pos_row", "pos_item", "neg_row", "neg_item")


def _line(weights: DataFrame, key: str, weight: str) -> tuple[DataFrame, list[float], float]:
    """The intervals [lo, hi) of keys in key order, where each part of the keys starts, and the end of the line."""
    rows = weights.select(key, F.col(weight).cast("double").alias(weight))
    ranges = Ranges(rows, [key])
    rows = rows.withColumn("_part", ranges.part())
    ends = {r["_part"]: r["s"] for r in rows.groupBy("_part").agg(F.sum(weight).alias("s")).collect()}  # one row a part
    starts, total = [], 0.0
    for p in range(ranges.parts):
        starts.append(total)
        total += ends.get(p) or 0.0
    w = Window.partitionBy("_part").orderBy(key)
    before = F.array(*[F.lit(x) for x in starts])[F.col("_part")]
    hi = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    rows = rows.withColumn("_hi", hi).withColumn("lo", before + F.coalesce(F.lag("_hi").over(w), F.lit(0.0))).withColumn("hi", before + F.col("_hi"))
    return rows.select(key, weight, "lo", "hi"), starts, total


def cumulative_weights(weights: DataFrame, key: str = "usr", weight: str = "w") -> DataFrame:
    """The interval [lo, hi) of each key on one line, in key order; a key is as long as its weight.

    Keys are cut into ranges; sums run within a range and start from the sums of the
    ranges before it. A null weight counts as none.
    """
    return _line(weights, key, weight)[0]


def weighted_picks(weights: DataFrame, n: int, key: str = "usr", weight: str = "w", stream: str = "pick") -> DataFrame:
    """``n`` draws (i, key) of a key in proportion to its weight, with replacement.

    Intervals and draws are swept together: the line is cut where ranges of keys
    start and at even steps, so a piece holds a bounded share of both, even where one
    key is as long as all others. An interval enters each piece that it touches; within a
    piece, sorted by place, a draw takes the key of the last interval that began.
    """
    c, starts, total = _line(weights, key, weight)
    spark = weights.sparkSession
    draws = spark.range(n).withColumnRenamed("id", "i")
    if total <= 0:
        return draws.filter("false").join(c.select(key).limit(0)).select("i", key)
    steps = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 10_000))
    cuts = sorted({x for x in [*starts, *[total * k / steps for k in range(1, steps)]] if 0 < x < total})
    bounds = [F.lit(x) for x in cuts]
    edges = F.array(F.lit(0.0), *bounds)
    points = draws.select("i", (draw(F.col("i"), stream) / 4294967296.0 * total).alias("x")).withColumn("piece", place(bounds, F.col("x")))
    spans = c.filter("lo < hi").withColumn("piece", F.explode(F.sequence(place(bounds, F.col("lo")), place(bounds, F.col("hi"))))).withColumn("x", F.greatest("lo", edges[F.col("piece")]))
    both = spans.filter("x < hi").select("piece", "x", F.lit(None).cast("bigint").alias("i"), key, F.lit(True).alias("_begins")).unionByName(points.select("piece", "x", "i", F.lit(None).cast(c.schema[key].dataType).alias(key), F.lit(False).alias("_begins")))
    swept = Window.partitionBy("piece").orderBy("x", F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_k", F.last(F.when(F.col("_begins"), F.struct(F.col(key).alias("k"))), ignorenulls=True).over(swept)).filter("i IS NOT NULL")
    return found.select("i", F.col("_k.k").alias(key))


def negative_pools(log: DataFrame, min_pool: int = 20) -> DataFrame:
    """Negatives of each context, numbered; a context with fewer than ``min_pool`` uses all negatives."""
    neg = log.filter("y = 0").select("ctx", F.col("row_id").alias("neg_row"))
    own = spread_numbers(neg, ["ctx"], F.col("neg_row"), "k").filter(F.col("n") >= min_pool)
    every = spread_numbers(neg.withColumn("ctx", F.lit("*")), ["ctx"], F.col("neg_row"), "k")
    return own.unionByName(every)


#: How a positive's negative is chosen: among all rows, among the items of its context, or among the rows of its context.
MODES = ("pop_weighted", "same_ctx", "same_ctx_pop_weighted")


def item_pools(log: DataFrame, mode: str, min_pool: int = 20) -> DataFrame:
    """(ctx, row, k, n): the numbered pool of each context, and of all under ``*``.

    Rows stand for items: the first row of each item where items are drawn alike,
    every row where they are drawn by how often they were shown. Contexts with
    fewer than ``min_pool`` rows are left out; ``*`` holds each item once, but all
    rows where the context plays no part.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    shown = log.select("ctx", "item", F.col("row_id").alias("row"))
    each = shown.groupBy("item").agg(F.min("row").alias("row"))
    every = (shown if mode == "pop_weighted" else each).select(F.lit("*").alias("ctx"), "row")
    pools = spread_numbers(every, ["ctx"], F.col("row"), "k")
    if mode == "pop_weighted":
        return pools
    own = shown if mode == "same_ctx_pop_weighted" else shown.groupBy("ctx", "item").agg(F.min("row").alias("row"))
    return spread_numbers(own.select("ctx", "row"), ["ctx"], F.col("row"), "k").filter(F.col("n") >= min_pool).unionByName(pools)


def mode_negatives(log: DataFrame, mode: str, min_pool: int = 20, stream: str = "mode") -> DataFrame:
    """For each positive an item as its negative: pos_row, usr and ctx of the positive, the pool, and neg_row and neg_item."""
    pools = item_pools(log, mode, min_pool)
    sizes = pools.groupBy("ctx").agg(F.max("n").alias("size")).withColumnRenamed("ctx", "pool")
    pos = log.filter("y = 1").select(F.col("row_id").alias("pos_row"), "usr", "ctx")
    # one row a context
    own = F.broadcast(sizes.select(F.col("pool").alias("ctx"), F.lit(True).alias("_own")))
    pos = pos.join(own, "ctx", "left").withColumn("pool", F.when(F.col("_own"), F.col("ctx")).otherwise("*")).drop("_own")
    drawn = pos.join(F.broadcast(sizes), "pool").withColumn("k", F.pmod(draw(F.col("pos_row"), f"{stream}-{mode}"), F.col("size")))
    found = drawn.join(pools.select(F.col("ctx").alias("pool"), "k", F.col("row").alias("neg_row")), ["pool", "k"])
    return found.join(log.select(F.col("row_id").alias("neg_row"), F.col("item").alias("neg_item")), "neg_row").select("pos_row", "usr", "ctx", "pool", "neg_row", "neg_item")


def hard_negatives(log: DataFrame, min_pool: int = 20, stream: str = "hard") -> DataFrame:
    """For each positive one negative of the same context (or of all, where the pool is small)."""
    pools = negative_pools(log, min_pool)
    sizes = pools.groupBy("ctx").agg(F.max("n").alias("size"))
    pos = log.filter("y = 1").select(F.col("row_id").alias("pos_row"), "ctx")
    # one row a context
    found = pos.join(F.broadcast(sizes), "ctx", "left").withColumn("pool", F.when(F.col("size").isNotNull(), F.col("ctx")).otherwise("*"))
    found = found.drop("size").join(F.broadcast(sizes.withColumnRenamed("ctx", "pool")), "pool").withColumn("k", F.pmod(draw(F.col("pos_row"), stream), F.col("size")))
    return found.join(pools.select(F.col("ctx").alias("pool"), "k", "neg_row"), ["pool", "k"]).select("pos_row", "ctx", "pool", "neg_row")


def capped_lists(log: DataFrame, cap: int, stream: str = "cap") -> DataFrame:
    """At most ``cap`` rows of each user, chosen by hash."""
    place = F.row_number().over(Window.partitionBy("usr").orderBy(draw(F.col("row_id"), stream), "row_id"))
    return log.withColumn("place", place.cast("bigint")).filter(F.col("place") <= cap)
