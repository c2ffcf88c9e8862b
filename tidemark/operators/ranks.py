"""Ranks within groups, with average ties, and rank transforms and fusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(group: list[str], score: str, descending: bool = False) -> Column:
    """Average rank of equal scores: the least rank plus half the other peers."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    peers = F.count(F.lit(1)).over(Window.partitionBy(*group, score))
    return F.rank().over(Window.partitionBy(*group).orderBy(order)) + (peers - 1) / 2.0


def percentile(group: list[str], score: str) -> Column:
    return average_rank(group, score) / F.count(F.lit(1)).over(Window.partitionBy(*group))


def rank_state(df: DataFrame, group: list[str], score: str, prefix: str = "") -> DataFrame:
    """Percentile, descending average rank and group size."""
    return df.select("*", percentile(group, score).alias(f"{prefix}pct"), average_rank(group, score, True).alias(f"{prefix}desc_rank"), F.count(F.lit(1)).over(Window.partitionBy(*group)).alias(f"{prefix}size"))


def borda(ranks: list[Column]) -> Column:
    return -sum(ranks[1:], ranks[0])


def reciprocal_rank_fusion(ranks: list[Column], k: float = 60.0) -> Column:
    parts = [1 / (k + r) for r in ranks]
    return sum(parts[1:], parts[0])


TRANSFORMS = ("percentile", "power_0.5", "power_1.5", "power_2", "power_3", "logit", "reciprocal", "ndcg")


def transform(name: str, pct: Column, desc_rank: Column, size: Column) -> Column:
    """A rank transform in [0, 1]; the bounded curves run from the worst rank (size) to the best (1)."""
    if name == "percentile":
        return pct
    if name.startswith("power_"):
        return F.pow(pct, float(name.removeprefix("power_")))
    if name == "logit":
        p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), pct))
        lo, hi = F.log(F.lit(0.01 / 0.99)), F.log(F.lit(0.99 / 0.01))
        return (F.log(p / (1 - p)) - lo) / (hi - lo)
    if name in ("reciprocal", "ndcg"):
        curve = (lambda r: 1 / r) if name == "reciprocal" else (lambda r: 1 / F.log2(r + 1))
        worst = curve(size.cast("double"))
        return F.when(size <= 1, F.lit(1.0)).otherwise((curve(desc_rank) - worst) / (1 - worst))
    raise ValueError(f"no such transform: {name}")
