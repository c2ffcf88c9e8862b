"""Pools, picks, numbering, frozen scores, variants and axis search."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.lineage import Ranges, numbered, place, shared_root, spread_numbers
from tidemark.operators import sampling
from tidemark.plans.search import ablations, axis_search, variants
from tidemark.sources import results


def log(spark):
    rows = [(i, i % 7, i % 11, "big" if i % 10 else "small", int(i % 3 == 0)) for i in range(300)]
    return spark.createDataFrame(rows, "row_id long, usr long, item long, ctx string, y long")


def test_numbers(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 37 % 1009).repartition(7)
    assert all(r["k"] == k for k, r in enumerate(numbered(df, ["v"], "k").orderBy("v").collect()))
    assert numbered(df.limit(0), ["v"], "k").count() == 0
    got = spread_numbers(df.withColumn("g", F.col("id") % 2), ["g"], F.col("id"), "k", 5).collect()
    assert Counter((r["g"], r["k"]) for r in got) == Counter((g, k) for g in (0, 1) for k in range(500)) and {r["n"] for r in got} == {500}


def test_numbers_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(Ranges, "ONE_PART", 10)
    rows = [(None if i % 50 == 0 else i * 37 % 211, f"t{i % 3}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "v long, s string, i long").repartition(7)
    ranges = Ranges(df, ["v", "s"], 20)
    assert 10 < ranges.parts <= 20
    got = numbered(df, ["v", "s", "i"], "k").orderBy("k").collect()
    assert [r["k"] for r in got] == list(range(2000))
    assert [(r["v"] is not None, r["v"] or 0, r["s"], r["i"]) for r in got] == sorted((v is not None, v or 0, s, i) for v, s, i in rows)


def test_places_between_bounds(spark):
    for n in (0, 1, 2, 3, 4, 10, 50):
        got = spark.range(-2, 2 * n + 2).select("id", place([F.lit(2 * k).cast("bigint") for k in range(n)], F.col("id")).alias("p")).collect()
        assert all(r["p"] == sum(2 * k <= r["id"] for k in range(n)) for r in got)


def test_sums_run_in_key_order(spark, monkeypatch):
    weights = spark.createDataFrame([(k, float(k % 5)) for k in range(500)], "usr long, w double").repartition(5)
    for one_part in (10, 10_000):
        monkeypatch.setattr(Ranges, "ONE_PART", one_part)
        at = 0.0
        for r in sampling.cumulative_weights(weights).orderBy("usr").collect():
            assert (r["lo"], r["hi"]) == (at, at + r["w"])
            at += r["w"]


def test_picks_of_one_heavy_key(spark, monkeypatch):
    """A key that holds most of the line enters every piece; draws equal a search in the plain sums."""
    import zlib

    monkeypatch.setattr(Ranges, "ONE_PART", 10)
    weights = spark.createDataFrame([(k, 1000.0 if k == 77 else 0.5 * (k % 3)) for k in range(300)], "usr long, w double")
    c = [(r["lo"], r["hi"], r["usr"]) for r in sampling.cumulative_weights(weights).collect() if r["lo"] < r["hi"]]
    total = max(h for _, h, _ in c)
    found = {r["i"]: r["usr"] for r in sampling.weighted_picks(weights, 30_000).collect()}
    assert len(found) == 30_000
    for i in range(0, 30_000, 97):
        x = zlib.crc32(f"pick:{i}".encode()) / 4294967296.0 * total
        assert [found[i]] == [k for lo, hi, k in c if lo <= x < hi]
    assert sampling.weighted_picks(weights.withColumn("w", F.lit(0.0)), 5).count() == 0


@pytest.mark.parametrize("mode", sampling.MODES)
def test_negatives_by_mode(spark, mode):
    df = log(spark)
    rows = {r["row_id"]: r for r in df.collect()}
    got = sampling.mode_negatives(df, mode, 40).collect()
    assert sorted(r["pos_row"] for r in got) == [i for i, r in rows.items() if r["y"] == 1]
    for r in got:
        assert r["usr"] == rows[r["pos_row"]]["usr"] and r["neg_item"] == rows[r["neg_row"]]["item"]
        big = mode == "same_ctx_pop_weighted" and r["ctx"] == "big"  # 270 rows, but only 11 items
        assert r["pool"] == ("big" if big else "*") and (not big or rows[r["neg_row"]]["ctx"] == "big")
    with pytest.raises(ValueError):
        sampling.item_pools(df, "other")


def test_picks_follow_weights(spark):
    weights = spark.createDataFrame([(k, w) for k, w in enumerate([0.0, 1.0, 2.0, 5.0] + [0.01] * 200)], "usr long, w double")
    c = sorted((r["lo"], r["hi"]) for r in sampling.cumulative_weights(weights).collect() if r["lo"] < r["hi"])
    assert c[0][0] == 0 and all(a[1] == b[0] for a, b in zip(c, c[1:]))
    picks = Counter(r["usr"] for r in sampling.weighted_picks(weights, 5000).collect())
    assert sum(picks.values()) == 5000 and picks[0] == 0
    assert all(abs(picks[k] - 500 * w) < 150 for k, w in ((1, 1), (2, 2), (3, 5)))


def test_frozen_scores_and_cache(spark):
    root = f"{shared_root(spark)}/test-{uuid.uuid4().hex}"
    df = spark.range(20).withColumn("score", F.col("id") / 3)
    results.freeze(df, root)
    assert results.load_frozen(spark, root).count() == 20
    with pytest.raises(Exception):
        results.freeze(df, root)
    df.withColumn("score", F.col("score") + 1).write.mode("overwrite").parquet(f"{root}/rows")
    with pytest.raises(ValueError):
        results.load_frozen(spark, root)
    built = []
    make = lambda a: built.append(a) or df
    for source in (df, df, df.limit(3)):
        results.config_cache(spark, make, f"{root}/cache", [source], a=1)
    assert len(built) == 2


def test_variants_and_axes():
    assert variants(["a", "b"], {"x": (["c", "a"], ["b"])}) == {"x": ["a", "c"]} and ablations(["a", "b"]) == {"a": ["b"], "b": ["a"]}
    with pytest.raises(ValueError):
        variants(["a"], {"x": ([], ["z"])})
    score = lambda c: -abs(c["u"] - 3) - (0.0001 if c["v"] == 0 else 0)
    best, record = axis_search({"u": 1, "v": 0}, {"u": [1, 2, 3], "v": [0, 1]}, score)
    assert best == {"u": 3, "v": 0} and len(record) == 4 and sum(r["carried"] for r in record) == 2
