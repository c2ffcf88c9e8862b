"""Summaries and checks of features, scores and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_summary(df: DataFrame, col: Column) -> DataFrame:
    """rows, finite and nonzero shares, mean, population deviation, min, quantiles, max and distinct values."""
    finite = col.isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(finite.cast("double")).alias("finite_share"),
        F.avg((col != 0).cast("double")).alias("nonzero_share"),
        F.avg(col).alias("mean"),
        F.stddev_pop(col).alias("std"),
        F.min(col).alias("least"),
        F.percentile(col, F.lit(0.01)).alias("q01"),
        F.percentile(col, F.lit(0.5)).alias("q50"),
        F.percentile(col, F.lit(0.99)).alias("q99"),
        F.max(col).alias("most"),
        F.count_distinct(col).alias("n_unique"),
    )


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), col).limit(n)


def coverage_report(df: DataFrame, cols: list[str], n: int = 20) -> DataFrame:
    """For each column its nonzero share, median and 99th percentile beside each of its ``n`` most common values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("v")).select("v.*")
    stats = long.groupBy("feature").agg(F.avg((F.col("value") != 0).cast("double")).alias("nonzero_share"), F.percentile("value", F.lit(0.5)).alias("q50"), F.percentile("value", F.lit(0.99)).alias("q99"))
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n_rows"), "value"))
    # one row a column
    return counts.withColumn("place", place).filter(F.col("place") <= n).join(F.broadcast(stats), "feature")


def category_rates(df: DataFrame, col: str, label: str = "y") -> DataFrame:
    """Rows and mean label of each category, the null one included."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(label).alias("rate"))


def tie_stats(df: DataFrame, score: str, user: str = "usr") -> DataFrame:
    """Distinct scores overall, and the mean share of distinct scores within a user."""
    per = df.groupBy(user).agg((F.count_distinct(score) / F.count(F.lit(1))).alias("share")).agg(F.avg("share").alias("mean_unique_share"))
    return df.agg(F.count_distinct(score).alias("n_unique")).join(F.broadcast(per))


def vocabulary_audit(df: DataFrame, train: DataFrame, col: str) -> DataFrame:
    """Rows and share of each split whose value train does not have."""
    seen = train.select(F.col(col).alias("_v")).distinct().withColumn("_seen", F.lit(True))
    rows = df.join(seen, F.col(col) == F.col("_v"), "left")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_seen").isNull().cast("bigint")).alias("unseen_rows"), F.avg(F.col("_seen").isNull().cast("double")).alias("unseen_rate"))


def lower_median(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.floor(F.percentile(F.col(col), F.lit(0.5))).cast("bigint").alias("threshold"))


def seed_summary(results: DataFrame, delta: str, need: float) -> DataFrame:
    """Mean, deviation and least delta over seeds, and whether every seed gains enough."""
    return results.agg(F.avg(delta).alias("mean_delta"), F.stddev_pop(delta).alias("std_delta"), F.min(delta).alias("min_delta"), F.bool_and(F.col(delta) >= need).alias("confirmed"))


def strict_lookup(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """An inner lookup that fails where a row has no match."""
    if rows.join(dim.select(key), key, "left_anti").limit(1).count():
        raise ValueError(f"rows without a {key} in the dimension")
    return rows.join(dim, key)


def alignment(a: DataFrame, b: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Rows of either side only, and rows that differ in the columns that must agree."""
    x = a.select(F.col(key).alias("ka"), *[F.col(c).alias(f"a_{c}") for c in same])
    y = b.select(F.col(key).alias("kb"), *[F.col(c).alias(f"b_{c}") for c in same])
    differ = F.lit(False)
    for c in same:
        differ = differ | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    j = x.join(y, F.col("ka") == F.col("kb"), "full")
    both = F.col("ka").isNotNull() & F.col("kb").isNotNull()
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return j.agg(n(F.col("kb").isNull()).alias("only_left"), n(F.col("ka").isNull()).alias("only_right"), n(both & differ).alias("differ"))


def order_reversals(per_regime: DataFrame, margin: float) -> DataFrame:
    """Model pairs whose order turns between two regimes, both margins above ``margin``.

    ``per_regime`` has regime, model and primary_score: a row a regime and model.
    """
    a, b = per_regime.alias("a"), per_regime.alias("b")
    pair = a.join(b, (F.col("a.regime") == F.col("b.regime")) & (F.col("a.model") < F.col("b.model"))).select(F.col("a.regime").alias("regime"), F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), (F.col("a.primary_score") - F.col("b.primary_score")).alias("d"))
    x, y = pair.alias("x"), pair.alias("y")
    on = (F.col("x.model_a") == F.col("y.model_a")) & (F.col("x.model_b") == F.col("y.model_b")) & (F.col("x.regime") < F.col("y.regime"))
    turned = (F.col("x.d") * F.col("y.d") < 0) & (F.least(F.abs("x.d"), F.abs("y.d")) > margin)
    return x.join(y, on).filter(turned).select(F.col("x.model_a").alias("model_a"), F.col("x.model_b").alias("model_b"), F.col("x.regime").alias("regime_1"), F.col("y.regime").alias("regime_2"))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_k = 1").drop("_k")
