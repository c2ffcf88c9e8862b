"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(e: DataFrame) -> DataFrame:
    # dealt once by u: the minimum and the join need no further shuffle
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).repartition("u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (u, v); the label is the component's least node.

    Each round keeps one edge a node at most in the end; the number of rounds
    grows with the logarithm of the largest component. Only two figures of each
    round reach the driver.
    """
    e = links.filter("u <> v").select("u", "v")
    before = None
    while True:
        e = cut(_small(_large(e)))
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now
