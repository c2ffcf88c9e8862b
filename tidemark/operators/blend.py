"""Score normalisation, weighted blends and weight searches.

Searches shuffle the log once, by user; each task evaluates its users at every grid
point. A grid is fixed by its step, so its size is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.lineage import cut
from tidemark.operators.metrics import evaluate_grid
from tidemark.operators.ranks import percentile

METRICS = ["gauc", "ndcg", "users", "n_rows", "primary_score"]


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """Global min-max of each column, by one one-row aggregate."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(stats))
    return out.withColumns({f"{c}_mm": (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-12) for c in cols}).drop(*stats.columns)


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Global z-scores with the population deviation."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stats))
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9) for c in cols}).drop(*stats.columns)


def weighted(cols: list[Column], weights: list) -> Column:
    parts = [c * w for c, w in zip(cols, weights, strict=True)]
    return sum(parts[1:], parts[0])


def alpha_grid(spark: SparkSession, steps: int) -> DataFrame:
    return spark.range(steps + 1).select(F.col("id").alias("grid"), (F.col("id") / steps).alias("alpha"))


def alpha_sweep(df: DataFrame, a: str, b: str, steps: int = 10, by: list[str] | None = None) -> DataFrame:
    """The metric at each alpha of alpha * a + (1 - alpha) * b.

    Scores are formed with weights in whole steps, as ranks do not depend on their
    scale; so ties of whole scores stay ties.
    """
    got = evaluate_grid(df, [a, b], [[float(g), float(steps - g)] for g in range(steps + 1)], by=by)
    return got.select(*(by or []), F.col("point").alias("grid"), (F.col("point") / steps).alias("alpha"), *METRICS)


def best(results: DataFrame, metric: str = "primary_score", key: str = "grid", by: list[str] | None = None) -> DataFrame:
    """The best row; among equals (to nine digits) the least key."""
    top = F.max_by(F.struct(*[c for c in results.columns if c not in (by or [])]), F.struct(F.round(metric, 9), -F.col(key)))
    return results.groupBy(*(by or [])).agg(top.alias("_b")).select(*(by or []), "_b.*")


def simplex_grid(spark: SparkSession, steps: int, n: int = 3) -> DataFrame:
    """Weights in multiples of 1 / steps that add up to 1."""
    g = spark.range(steps + 1).select(F.col("id").alias("i0"))
    for k in range(1, n - 1):
        g = g.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps) - sum((F.col(f"i{j}") for j in range(1, k)), F.col("i0")))))
    last = F.lit(steps) - sum((F.col(f"i{j}") for j in range(1, n - 1)), F.col("i0"))
    return g.withColumn(f"i{n - 1}", last).select(*[(F.col(f"i{k}") / steps).alias(f"w{k}") for k in range(n)])


def local_grid(spark: SparkSession, centre: list[float], radius: int, step: float, least: float = 0.0) -> DataFrame:
    """Simplex points within ``radius`` steps of the centre in every weight, none under ``least``."""
    n = len(centre)
    g = spark.range(1)
    for k in range(n - 1):
        g = g.withColumn(f"d{k}", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    moved = g.withColumn(f"d{n - 1}", -sum((F.col(f"d{k}") for k in range(1, n - 1)), F.col("d0")))
    moved = moved.filter(F.abs(f"d{n - 1}") <= radius).select(*[F.round(F.lit(c) + F.col(f"d{k}") * step, 10).alias(f"w{k}") for k, c in enumerate(centre)])
    for k in range(n):
        moved = moved.filter(F.col(f"w{k}") >= least)
    return moved


def weight_search(df: DataFrame, cols: list[str], grid: DataFrame, by: list[str] | None = None, scale: int | None = None) -> DataFrame:
    """The metric at each grid point; the grid, bounded by its step, is read by the driver.

    With ``scale`` the weights are multiplied by it and rounded to whole numbers before
    scores are formed: ranks stay, and ties of whole scores stay ties.
    """
    ws = [f"w{k}" for k in range(len(cols))]
    points = [list(r) for r in grid.select(*ws).collect()]
    got = evaluate_grid(df, cols, [[float(x) if scale is None else float(round(x * scale)) for x in p] for p in points], by=by)
    named = df.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(points)], "point bigint, " + ", ".join(f"{w} {grid.schema[w].dataType.simpleString()}" for w in ws))
    return got.join(F.broadcast(named), "point").select(*(by or []), *ws, *METRICS)


def refined_grid(spark: SparkSession, centre: list[float], coarse: int = 10, radius: int = 5, step: float = 0.02, least: float = 0.0) -> DataFrame:
    """The coarse simplex and the finer points around ``centre``, each point once."""
    points = simplex_grid(spark, coarse, len(centre)).unionByName(local_grid(spark, centre, radius, step, least))
    names = [f"w{k}" for k in range(len(centre))]
    return points.select(*[F.round(c, 10).alias(c) for c in names]).dropDuplicates(names)


def refined_search(df: DataFrame, cols: list[str], coarse: int = 10, radius: int = 5, step: float = 0.02, least: float = 0.0, scale: int | None = None) -> DataFrame:
    """The metric at each point of the coarse simplex and of the finer grid around its best point, for any number of scores.

    The coarse results are computed once; of equal points the one with the
    greatest first weights leads. Only that point reaches the driver.
    """
    spark, names = df.sparkSession, [f"w{k}" for k in range(len(cols))]
    first = cut(weight_search(df, cols, simplex_grid(spark, coarse, len(cols)), scale=scale))
    top = first.orderBy(F.round("primary_score", 9).desc(), *[F.desc(c) for c in names]).first()
    if top is None:
        return first
    finer = local_grid(spark, [top[c] for c in names], radius, step, least)
    same = [F.round(finer[c], 10) == F.round(first[c], 10) for c in names]
    for c in same[1:]:
        same[0] = same[0] & c
    return first.unionByName(weight_search(df, cols, finer.join(F.broadcast(first.select(*names)), same[0], "left_anti"), scale=scale))


def normalised(df: DataFrame, cols: list[str], how: str, group: list[str] | None = None) -> DataFrame:
    """Adds ``{col}_n`` of each score: ``global`` min-max, ``zscore``, or ``percentile`` within ``group``."""
    if how == "global":
        return minmax(df, cols).withColumnsRenamed({f"{c}_mm": f"{c}_n" for c in cols})
    if how == "zscore":
        return zscore(df, cols).withColumnsRenamed({f"{c}_z": f"{c}_n" for c in cols})
    if how == "percentile":
        return df.withColumns({f"{c}_n": percentile(group or [], c) for c in cols})
    raise ValueError(f"no such normaliser: {how}")


def segment_alphas(df: DataFrame, a: str, b: str, segment: str, steps: int = 10, min_rows: int = 5) -> DataFrame:
    """The best alpha of each segment; the global one where the segment has fewer rows."""
    overall = best(alpha_sweep(df, a, b, steps)).select(F.col("alpha").alias("_all"))
    own = best(alpha_sweep(df, a, b, steps, [segment]), by=[segment]).select(segment, "alpha", F.col("n_rows"))
    return own.join(F.broadcast(overall)).select(segment, F.when(F.col("n_rows") < min_rows, F.col("_all")).otherwise(F.col("alpha")).alias("alpha"), "n_rows")


def apply_segment_alphas(df: DataFrame, alphas: DataFrame, a: str, b: str, segment: str, default: float) -> DataFrame:
    out = df.join(F.broadcast(alphas.select(segment, F.col("alpha").alias("_w"))), segment, "left").withColumn("_w", F.coalesce("_w", F.lit(default)))
    return out.withColumn("score", F.col("_w") * F.col(a) + (1 - F.col("_w")) * F.col(b)).drop("_w")


def user_folds(user: Column, n: int) -> Column:
    """A fold number that keeps a user's rows together."""
    return F.pmod(F.crc32(user.cast("string").cast("binary")), F.lit(n))


def regime(count: Column, threshold: Column) -> Column:
    return F.when(count == 0, "no_prior").when(count <= threshold, "low").otherwise("high")
