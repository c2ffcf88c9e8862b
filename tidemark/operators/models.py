"""Scorers and trainers that have a Spark form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dot
from tidemark.lineage import cut
from tidemark.operators import sampling


def item_popularity(rows: DataFrame, train: DataFrame, prior: float = 20.0, item: str = "item", label: str = "y") -> DataFrame:
    """``rows`` with the smoothed train rate of their item; the global mean where train has none."""
    g = train.agg(F.avg(label).alias("_g"))
    # the global mean is one row
    pop = train.groupBy(item).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n")).join(F.broadcast(g)).select(item, ((F.col("_p") + prior * F.col("_g")) / (F.col("_n") + prior)).alias("_r"))
    return rows.join(pop, item, "left").join(F.broadcast(g)).withColumn("score", F.coalesce("_r", "_g")).drop("_r", "_g")


def fm_score(bias: Column, linear: list[Column], vectors: list[Column], dim: int) -> Column:
    """bias + sum of weights + half of (squared norm of the sum - sum of squared norms)."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda a, b: a.cast("double") + b)
    squares = sum((dot(v, v) for v in vectors[1:]), dot(vectors[0], vectors[0]))
    return sum(linear, bias) + (dot(total, total) - squares) / 2


def group_softmax(score: Column, group: list[str]) -> Column:
    """Softmax over a group, shifted by its maximum."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def train_fm(train: DataFrame, features: list[str], label: str = "y", factors: int = 4, seed: int = 0):
    """A factorization machine on numeric features; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), FMClassifier(labelCol=label, factorSize=factors, maxIter=20, stepSize=0.05, seed=seed)]).fit(train)


def isotonic(train: DataFrame, rows: DataFrame, score: str, label: str = "y", name: str = "calibrated") -> DataFrame:
    """Scores calibrated by an isotonic fit on train."""
    from pyspark.ml.regression import IsotonicRegression

    put = lambda df: df.withColumn(label, F.col(label).cast("double")).withColumn(score, F.col(score).cast("double"))
    return IsotonicRegression(featuresCol=score, labelCol=label, predictionCol=name).fit(put(train)).transform(put(rows))


def stacked(rows: DataFrame, cols: list[str], fold: str = "fold", label: str = "y", name: str = "stacked", kind: str = "logistic") -> DataFrame:
    """Out-of-fold scores: each fold is scored by a model fitted on the others."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = cut(rows)  # every fit and every fold's scores read it
    x = VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    out = None
    for f in folds:
        model = (LogisticRegression(labelCol=label, regParam=0.01) if kind == "logistic" else GBTClassifier(labelCol=label, maxIter=5, maxDepth=3, seed=0)).fit(x.filter(F.col(fold) != f))
        part = model.transform(x.filter(F.col(fold) == f)).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def train_bpr(log: DataFrame, rounds: int = 5, dim: int = 8, rate: float = 0.5, seed: int = 0) -> DataFrame:
    """Pairwise ranking with a factor a user and item: (b, v, side), b the id, trained by full-gradient rounds.

    Each round pairs every positive of a user that has negatives with a newly
    drawn one of these. Factors are two tables by id; each round joins them to
    the pairs and sums gradients by id, so nothing but Spark joins and aggregates
    is needed. Users and items that no pair can reach keep their start.
    """
    start = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.pmod(F.xxhash64(F.lit(s), "b", k), F.lit(2001)) - 1000) / 10_000.0)
    users = cut(log.select(F.col("usr").alias("b")).distinct().withColumn("v", start(seed)))
    items = cut(log.select(F.col("item").alias("b")).distinct().withColumn("v", start(seed + 1)))
    n_users, n_items = users.count(), items.count()
    scale = lambda v, c: F.transform(v, lambda x: x * c)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)

    def stepped(params: DataFrame, grads: DataFrame, step: float) -> DataFrame:
        summed = grads.select("b", F.posexplode("g").alias("k", "x")).groupBy("b", "k").agg(F.sum("x").alias("x")).groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("g"))
        return params.join(summed, "b", "left").select("b", F.when(F.col("g").isNull(), F.col("v")).otherwise(add(F.col("v"), scale(F.col("g"), F.lit(step)))).alias("v"))

    for k in range(rounds):
        j = sampling.positive_pairs(log, f"bpr-{seed}-{k}").select(F.col("usr").alias("u"), F.col("pos_item").alias("p"), F.col("neg_item").alias("n"))
        for params, c in ((users, "u"), (items, "p"), (items, "n")):
            j = j.join(params.select(F.col("b").alias(c), F.col("v").alias(f"v{c}")), c)
        j = cut(j.withColumn("c", 1 / (1 + F.exp(dot(F.col("vu"), F.col("vp")) - dot(F.col("vu"), F.col("vn"))))))
        total = j.count() or 1
        gu = j.select(F.col("u").alias("b"), scale(minus(F.col("vp"), F.col("vn")), F.col("c")).alias("g"))
        gi = j.select(F.col("p").alias("b"), scale(F.col("vu"), F.col("c")).alias("g")).unionByName(j.select(F.col("n").alias("b"), scale(F.col("vu"), -F.col("c")).alias("g")))
        users, items = cut(stepped(users, gu, rate * n_users / total)), cut(stepped(items, gi, rate * n_items / total))
    return users.withColumn("side", F.lit("user")).unionByName(items.withColumn("side", F.lit("item")))
