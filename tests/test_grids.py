"""Grids in one shuffle against the metric by windows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blend, metrics


def rows(spark, n=900):
    rng = random.Random(9)
    made = [(i, rng.choice([None, *range(25)]) if i % 3 else 7, rng.choice(["a", "b", None]), rng.choice([0, 0, 1, None]), rng.choice([0.0, 1.0, 2.0, rng.random()]), rng.choice([0.0, 1.0, -1.0]), float(rng.randrange(4))) for i in range(n)]
    return spark.createDataFrame(made, "row_id long, usr long, ctx string, y long, s1 double, s2 double, s3 double").repartition(5)


WEIGHTS = [[1.0, 0.0, 0.0], [0.2, 0.5, 0.3], [1.0, 2.0, 1.0]]


@pytest.mark.parametrize("by", [None, ["ctx"]])
@pytest.mark.parametrize("most", [60, 10**6])
def test_grid_equals_windows(spark, monkeypatch, by, most):
    """Small batches cut users apart and send the user of a third of all rows the way of windows."""
    monkeypatch.setattr(metrics, "GRID_ROWS", most)
    df = rows(spark)
    got = {(r["point"], r["ctx"] if by else 0): r for r in metrics.evaluate_grid(df, ["s1", "s2", "s3"], WEIGHTS, by=by).collect()}
    for p, w in enumerate(WEIGHTS):
        want = metrics.evaluate(df.withColumn("y", F.coalesce("y", F.lit(0))).withColumn("score", F.col("s1") * w[0] + F.col("s2") * w[1] + F.col("s3") * w[2]), by=by).collect()
        assert len(want) == (3 if by else 1)
        for r in want:
            g = got[p, r["ctx"] if by else 0]
            assert (g["users"], g["n_rows"]) == (r["users"], r["n_rows"])
            assert [g[c] for c in ("gauc", "ndcg", "primary_score")] == pytest.approx([r[c] for c in ("gauc", "ndcg", "primary_score")], abs=1e-12)
    assert metrics.evaluate_grid(df.limit(0), ["s1"], [[1.0]]).count() == 0


def test_the_log_is_shuffled_once(spark):
    plan = metrics.evaluate_grid(rows(spark), ["s1", "s2"], [[1.0, 0.0]] * 66)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan


def test_small_segments_take_the_weight_of_all(spark):
    df = rows(spark).withColumn("y", F.coalesce("y", F.lit(0)))
    overall = blend.best(blend.alpha_sweep(df, "s1", "s2", 4)).first()["alpha"]
    sizes = {r["ctx"]: r["count"] for r in df.groupBy("ctx").count().collect()}
    least = sorted(sizes.values())[1]
    own = {r["ctx"]: r for r in blend.best(blend.alpha_sweep(df, "s1", "s2", 4, ["ctx"]), by=["ctx"]).collect()}
    for r in blend.segment_alphas(df, "s1", "s2", "ctx", 4, least).collect():
        assert r["n_rows"] == sizes[r["ctx"]]
        assert r["alpha"] == (overall if sizes[r["ctx"]] < least else own[r["ctx"]]["alpha"])


def test_four_scores_are_searched(spark):
    df = rows(spark, 300).withColumn("s4", F.col("s3") * 2)
    got = blend.refined_search(df, ["s1", "s2", "s3", "s4"], coarse=2, radius=1, step=0.1).collect()
    points = [tuple(r[f"w{k}"] for k in range(4)) for r in got]
    assert len(set(points)) == len(points) > 10 and all(abs(sum(p) - 1) < 1e-9 for p in points)
