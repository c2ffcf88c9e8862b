"""History sequences and attention pooling over bounded row frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dot, softmax


def attention_pool(log: DataFrame, emb: DataFrame, width: int, dim: int, name: str = "pooled", half_life_days: float | None = None) -> DataFrame:
    """Label of the last ``width`` rows pooled by attention of their items to the row's item.

    Logits are scaled dot products, less the gap's half-lives (times ln 2) where
    a half-life is given; -1 without history. ``emb`` has item and vec.
    """
    # an item without a vector has no history weight
    rows = log.join(emb, "item", "left")
    w = Window.partitionBy("usr").orderBy("t", "row_id").rowsBetween(-width, -1)
    rows = rows.withColumn("_h", F.filter(F.collect_list(F.struct("vec", "y", "t")).over(w), lambda h: h["vec"].isNotNull()))

    def logit(h: Column) -> Column:
        x = dot(h["vec"], F.col("vec")) / math.sqrt(dim)
        return x if half_life_days is None else x - (F.col("t") - h["t"]) / 86_400_000.0 * (math.log(2) / half_life_days)

    rows = rows.withColumn("_z", F.transform("_h", logit)).withColumn("_a", softmax(F.col("_z")))
    pooled = F.aggregate(F.zip_with("_a", "_h", lambda a, h: a * h["y"]), F.lit(0.0), lambda acc, x: acc + x)
    return rows.withColumn(name, F.when((F.size("_h") > 0) & F.col("vec").isNotNull(), pooled).otherwise(F.lit(-1.0))).drop("_h", "_z", "_a", "vec")


def item_sequence(log: DataFrame, vocab: DataFrame, width: int, name: str = "seq") -> DataFrame:
    """Ids of the last ``width`` items, right-aligned; 0 pads, 1 is an item outside ``vocab`` (item, id)."""
    rows = log.join(vocab, "item", "left").withColumn("_id", F.coalesce("id", F.lit(1)).cast("bigint"))
    w = Window.partitionBy("usr").orderBy("t", "row_id").rowsBetween(-width, -1)
    rows = rows.withColumn("_l", F.collect_list("_id").over(w))
    return rows.withColumn(name, F.concat(F.array_repeat(F.lit(0).cast("bigint"), width - F.size("_l")), "_l")).withColumn(f"{name}_len", F.size("_l").cast("bigint")).drop("_l", "_id", "id")


def history_pointers(log: DataFrame, width: int) -> DataFrame:
    """Row ids, items and labels of the last ``width`` rows as arrays, oldest first."""
    w = Window.partitionBy("usr").orderBy("t", "row_id").rowsBetween(-width, -1)
    return log.withColumn("_l", F.collect_list(F.struct("row_id", "item", "y")).over(w)).select("*", F.col("_l.row_id").alias("hist_rows"), F.col("_l.item").alias("hist_items"), F.col("_l.y").alias("hist_labels")).drop("_l")
