"""BPR uses every positive of eligible users and holds a factor a user and item."""

from pyspark.sql import functions as F

from tidemark.operators import sampling
from tidemark.queries import QUERIES
from tidemark.sources import event_log

SF = "/root/testdata/sf0.001"


def test_bpr_uses_the_whole_log(spark):
    train = event_log(spark, SF).filter("split = 'train'").cache()
    users = train.groupBy("usr").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).filter("p > 0 AND n > 0")
    got = sampling.positive_pairs(train).collect()
    assert len(got) == users.agg(F.sum("p")).first()[0] == len({r["pos_row"] for r in got})
    rows = {r["row_id"]: r for r in train.collect()}
    for r in got:
        pos, neg = rows[r["pos_row"]], rows[r["neg_row"]]
        assert (pos["y"], neg["y"], pos["usr"], neg["usr"], pos["item"], neg["item"]) == (1, 0, r["usr"], r["usr"], r["pos_item"], r["neg_item"])
    model = {(r["side"], r["b"]): r["v"] for r in QUERIES["bpr_train"](spark, SF).collect()}
    assert set(model) == {("user", r["usr"]) for r in rows.values()} | {("item", r["item"]) for r in rows.values()}
    score = lambda u, i: sum(x * y for x, y in zip(model["user", u], model["item", i], strict=True))
    assert sum(score(r["usr"], r["pos_item"]) - score(r["usr"], r["neg_item"]) for r in got) > 0
