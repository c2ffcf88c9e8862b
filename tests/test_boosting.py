"""Lambda-rank stumps, fold models and exact quantiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.lineage import Ranges
from tidemark.operators import boosting, encode, models
from tidemark.operators.metrics import evaluate


def planted(spark, n=6000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, z = rng.random(), rng.random()
        p = 0.8 if 0.3 < x < 0.6 else 0.15
        rows.append((i, rng.randrange(n // 20), rng.randrange(50), int(rng.random() < p), None if i % 17 == 0 else x, z, ("train", "train", "valid", "test")[i % 4], i % 3))
    return spark.createDataFrame(rows, "row_id long, usr long, item long, y long, x double, z double, split string, fold int")


@pytest.mark.parametrize("top", [2, 50])
def test_lambdas_equal_all_pairs(spark, top):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(6)]), rng.randrange(2), rng.choice([0.0, 0.5, 1.0, rng.random()])) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, usr long, y long, s double")
    got = {r["row_id"]: (r["g"], r["h"]) for r in boosting.lambdas(df, F.col("s"), sigma=1.5, top=top).collect()}
    want = {i: [0.0, 0.0] for i, *_ in rows}
    for u in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == u), key=lambda r: (-r[3], r[0]))
        ideal = sum(1 / math.log2(k + 2) for k in range(min(top, sum(r[2] for r in mine)))) or 1
        for p, a in enumerate(mine):
            for q, b in enumerate(mine):
                if a[2] == 1 and b[2] == 0 and min(p, q) < top:
                    rho = 1 / (1 + math.exp(1.5 * (a[3] - b[3])))
                    w = abs(1 / math.log2(p + 2) - 1 / math.log2(q + 2)) / ideal
                    for i, sign in ((a[0], -1), (b[0], 1)):
                        want[i][0] += sign * 1.5 * rho * w
                        want[i][1] += 1.5**2 * rho * (1 - rho) * w
    assert len(got) == 150 and all(got[i] == pytest.approx(tuple(want[i]), abs=1e-9) for i in want)


def test_ranker_finds_what_popularity_cannot(spark):
    df = planted(spark)
    part = {s: df.filter(F.col("split") == s) for s in ("train", "valid", "test")}
    model = boosting.fit_ranker(part["train"], part["valid"], ["x", "z"], rounds=12, rate=0.4, bins=16, patience=4)
    primary = lambda rows: evaluate(rows).first()["primary_score"]
    assert primary(boosting.predict(part["test"], model)) > primary(models.item_popularity(part["test"], part["train"])) + 0.1
    assert max(model.history) == pytest.approx(model.history[len(model.splits) - 1], abs=1e-5)
    assert sum(model.shares().values()) == pytest.approx(1) and model.shares()["x"] > 0.9
    assert boosting.predict(part["test"], model).filter("score IS NULL").count() == 0


def test_ranker_without_signal(spark):
    df = planted(spark, 200).withColumn("y", F.lit(0))
    model = boosting.fit_ranker(df, df, ["x"], rounds=3)
    assert not model.splits and model.shares() == {"x": 0.0}


def test_no_row_is_scored_by_its_own_fold(spark):
    df = planted(spark, 1500).withColumn("other", (F.col("z") > 0.5).cast("long"))
    plain = boosting.fit_folds(df, ["y", "other"], ["x", "z"], folds=3, rounds=3)
    flipped = boosting.fit_folds(df.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y"))), ["y", "other"], ["x", "z"], folds=3, rounds=3)
    assert plain["y", 1].tables == flipped["y", 1].tables and plain["y", 0].tables != flipped["y", 0].tables
    assert plain["y", -1].shares()["x"] > 0.8 and plain["other", -1].shares()["z"] > 0.95
    got = boosting.fold_scores(df, plain).collect()
    assert {len([r for r in got if r["fold"] == k]) for k in range(3)} == {500}
    mean = lambda c, one: np.mean([r[c] for r in got if (r["y" if c == "aux_y" else "other"] == 1) == one])
    assert mean("aux_y", True) > mean("aux_y", False) + 0.05 and mean("aux_other", True) > mean("aux_other", False) + 0.3


def test_one_fold_model_equals_plain_boosting():
    rng = np.random.default_rng(0)
    cells = {"f": [{"bin": b, "g": float(g), "h": 5.0, "n": 30} for b, g in enumerate(rng.normal(size=6))]}
    s = boosting.best_split(cells, least=1)
    best = max(range(5), key=lambda b: sum(x["g"] for x in cells["f"][: b + 1]) ** 2 / (5.0 * (b + 1) + 1) + sum(x["g"] for x in cells["f"][b + 1 :]) ** 2 / (5.0 * (5 - b) + 1))
    assert s["bin"] == best
    assert boosting.best_split(cells, least=100) is None


@pytest.mark.parametrize("one_part", [5, 10**6])
def test_quantiles_are_exact(spark, monkeypatch, one_part):
    monkeypatch.setattr(Ranges, "ONE_PART", one_part)
    rng = random.Random(2)
    rows = [(7.0 if i % 3 == 0 else rng.gauss(0, 5), None if i % 4 == 0 else float(i * 37 % 101), None) for i in range(1200)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(6)
    got = encode.quantiles(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, 20)
    for k, name in enumerate("ab"):
        values = [r[k] for r in rows if r[k] is not None]
        assert got[name] == pytest.approx(np.quantile(values, np.arange(1, 20) / 20).tolist(), abs=1e-12)
    assert got["c"] == []
    low = encode.quantiles(df, {"b": F.col("b")}, 7, interpolate=False)["b"]
    values = sorted(r[1] for r in rows if r[1] is not None)
    assert low == [values[math.floor(i / 7 * (len(values) - 1))] for i in range(1, 7)]
    want = df.agg(F.percentile("a", F.array(*[F.lit(i / 9) for i in range(1, 9)])).alias("e")).first()["e"]
    assert encode.edges(df, F.col("a"), 9).first()["edges"] == pytest.approx(want, abs=1e-12)
    assert encode.edges(df, F.col("c"), 9).first()["edges"] is None
