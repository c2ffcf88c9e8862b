"""Hand-checked micro-fixtures and brute-force checks of the causal features."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bucket_left, bucket_right, history_bucket, six_digits, smoothed_rate, watch_fraction
from tidemark.operators import history, ranks, sequence
from tidemark.operators.metrics import evaluate


def _map(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_same_day_rows_do_not_see_each_other(spark):
    df = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 1, 0), (2, 1, 2, 1), (3, 1, 4, 0)], "row_id long, usr long, day long, y long")
    got = history.day_history(df, ["usr"], {"activity": F.lit(1), "pos": F.col("y")}, {"total": (F.lit(1), 1.0)})
    assert _map(got, "row_id", "activity", "pos") == {0: (0, 0), 1: (0, 0), 2: (2, 1), 3: (3, 2)}
    assert _map(got, "row_id", "total") == {0: 0.0, 1: 0.0, 2: 1.0, 3: 0.5}


def test_folded_form_equals_closed_form(spark, monkeypatch):
    rng = random.Random(0)
    rows = [(i, rng.randint(0, 4), rng.randint(0, 40), rng.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, usr long, day long, y long")
    closed = _map(history.day_history(df, ["usr"], {}, {"d": (F.col("y"), 1.5)}), "row_id", "d")
    monkeypatch.setattr(history, "MAX_EXPONENT", 5)
    folded = _map(history.day_history(df, ["usr"], {}, {"d": (F.col("y"), 1.5)}), "row_id", "d")
    for i, u, day, _ in rows:
        want = sum(y * 0.5 ** ((day - e) / 1.5) for _, v, e, y in rows if v == u and e < day)
        assert closed[i] == pytest.approx(want, abs=1e-9) and folded[i] == pytest.approx(want, abs=1e-9)


def test_days_far_from_zero_and_far_apart(spark):
    rows = [(0, 1, 19800, 1), (1, 1, 19801, 1), (2, 1, 19802, 0), (3, 2, 5, 1), (4, 2, 19000, 1), (5, 2, 19001, 0), (6, None, 19800, 1), (7, None, 19801, 1)]
    df = spark.createDataFrame(rows, "row_id long, usr long, day long, y long")
    got = _map(history.day_history(df, ["usr"], {"n": F.lit(1)}, {"d": (F.col("y"), 2.5), "e": (F.lit(1), 1.0)}), "row_id", "n", "d", "e")
    for i, u, day, _ in rows:
        before = [(e, y) for _, v, e, y in rows if v == u and e < day]
        want = len(before), sum(y * 0.5 ** ((day - e) / 2.5) for e, y in before), sum(0.5 ** (day - e) for e, _ in before)
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_rows_without_a_day_have_no_history(spark):
    rows = [(0, 1, None, 1), (1, 1, 3, 1), (2, 1, 4, 1), (3, 2, 3, 1), (4, 2, 4, 1), (5, 1, None, 1), (6, 3, None, 1)]
    df = spark.createDataFrame(rows, "row_id long, usr long, day long, y long")
    got = _map(history.day_history(df, ["usr"], {"n": F.lit(1)}, {"d": (F.col("y"), 2.5)}), "row_id", "n", "d")
    late = (1, pytest.approx(0.5**0.4))
    assert got == {0: (0, 0.0), 1: (0, 0.0), 2: late, 3: (0, 0.0), 4: late, 5: (0, 0.0), 6: (0, 0.0)}


@pytest.mark.parametrize("exponent", [900, 6])
def test_spans_of_thousands_of_half_lives(spark, monkeypatch, exponent):
    monkeypatch.setattr(history, "MAX_EXPONENT", exponent)
    rng = random.Random(6)
    instants = [0, 1, 10_000, 10_000, 10_001, 10_003, 40_000, 40_001, *[rng.randrange(50_000) for _ in range(60)]]
    rows = [(i, i % 2, d, None if d == 40_000 else rng.random()) for i, d in enumerate(instants)] + [(900, 0, None, 1.0)]
    df = spark.createDataFrame([(i, u, d, None if d is None else d * history.DAY_MS, v) for i, u, d, v in rows], "row_id long, usr long, day long, t long, v double")
    mean = _map(history.exclusive_decayed_mean(df, ["usr"], F.col("v"), 2.5, "m"), "row_id", "m")
    total = _map(history.day_history(df, ["usr"], {}, {"d": (F.coalesce("v", F.lit(0.0)), 2.5), "e": (F.lit(1), 40.0)}), "row_id", "d", "e")
    near = 0.1 if exponent == 6 else 1e-12  # means over blocks of three half-lives leave out more
    for i, u, d, _ in rows:
        if d is None:
            assert mean[i] is None and total[i] == (0.0, 0.0)
            continue
        before = [(e, v) for _, w, e, v in rows if w == u and e is not None and e < d]
        known = [(e, v) for e, v in before if v is not None]
        latest = max((e for e, _ in known), default=0)
        weights = [0.5 ** ((latest - e) / 2.5) for e, _ in known]
        want = sum(w * v for w, (_, v) in zip(weights, known, strict=True)) / sum(weights) if known else None
        assert mean[i] == (want if want is None else pytest.approx(want, abs=near * 2))
        assert total[i][0] == pytest.approx(sum((v or 0) * 0.5 ** ((d - e) / 2.5) for e, v in before), abs=1e-9)
        assert total[i][1] == pytest.approx(sum(0.5 ** ((d - e) / 40.0) for e, v in before), abs=1e-9)


def test_six_digits_like_c(spark):
    values = [1e-5, 1.5e-5, 1e6, 2e7, 0.0, -0.0, 0.1, 123456.0, 1234567.0, -2.5e-7, 100.0, 1e-4, 0.5, 7.0, 1e300, 10 / 1024, 30 / 1024, 1234565.0, 1234575.0, 0.1234565, 0.1234575, 1.0000005, -2.5000005, 12345650.0, 3.0000015e-9]
    got = spark.createDataFrame([(i, v) for i, v in enumerate([*values, float("nan"), float("inf"), float("-inf")])], "i int, v double").select("i", six_digits(F.col("v")).alias("s"))
    assert [r["s"] for r in got.orderBy("i").collect()] == [f"{v:.6g}" for v in values] + ["nan", "inf", "-inf"]


def test_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(0, None, 1, 1), (1, None, 2, 1)], "row_id long, usr long, day long, y long")
    assert _map(history.day_history(df, ["usr"], {"p": F.col("y")}), "row_id", "p") == {0: 0, 1: 1}


def test_total_order_ties(spark):
    df = spark.createDataFrame([(1, 5000, 100, 1), (1, 5000, 101, 0), (1, 5500, 99, 1)], "usr long, t long, row_id long, y long")
    got = _map(history.momentum(df), "row_id", "last1", "gap_ms")
    assert got == {100: (-1, -1), 101: (1, 0), 99: (0, 500)}


def test_exclusive_ties(spark):
    df = spark.createDataFrame([(0, 1, 20.0, 100.0, 1000), (1, 1, 80.0, 100.0, 1000), (2, 1, 50.0, 100.0, 2000)], "row_id long, usr long, play double, dur double, t long")
    v = watch_fraction(F.col("play"), F.col("dur"))
    for got in (history.exclusive_decayed_mean(df, ["usr"], v, 2.5, "m"), history.exclusive_last_mean(df, "usr", v, 5, "m")):
        m = _map(got, "row_id", "m")
        assert m[0] is None and m[1] is None and m[2] == pytest.approx(0.5)


def test_undefined_values_take_up_places(spark):
    df = spark.createDataFrame([(i, 1, i, v) for i, v in enumerate([1.0, None, 5.0, 7.0])], "row_id long, usr long, t long, v double")
    m = _map(history.exclusive_last_mean(df, "usr", F.col("v"), 2, "m"), "row_id", "m")
    assert m == {0: None, 1: 1.0, 2: 1.0, 3: 5.0}


def test_percentile_ranks(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.5), (1, 0.5), (1, 0.9), (2, 3.0)], "usr long, s double")
    got = sorted(tuple(r) for r in df.select("usr", "s", ranks.percentile(["usr"], "s")).collect())
    assert [r[2] for r in got] == [0.25, 0.625, 0.625, 1.0, 1.0]


def test_bucket_sides_and_formats(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.5, 3.0, 4.0)], "x double").withColumn("e", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    got = df.select(bucket_left(F.col("e"), F.col("x")), bucket_right(F.col("e"), F.col("x"))).collect()
    assert [r[0] for r in got] == [0, 0, 2, 2, 3] and [r[1] for r in got] == [0, 1, 2, 3, 3]
    n = spark.range(7).select(history_bucket(F.col("id"))).collect()
    assert [r[0] for r in n] == [0, 1, 2, 3, 3, 3, 4]
    one = spark.range(1).select(smoothed_rate(F.lit(0), F.lit(0)), smoothed_rate(F.lit(2), F.lit(3)), six_digits(F.lit(0.5)), six_digits(F.lit(7.0)), six_digits(F.lit(100.0))).first()
    assert tuple(one) == (0.5, 0.625, "0.5", "7", "100")


def test_metric_of_three_users(spark):
    rows = [(0, "A", 0, 0.9), (1, "A", 1, 0.5), (2, "A", 0, 0.5), (3, "B", 0, 0.3), (4, "C", 1, 0.2)]
    r = evaluate(spark.createDataFrame(rows, "row_id long, usr string, y long, score double")).first()
    assert (r["gauc"], r["users"], r["n_rows"]) == (0.25, 3, 5)
    assert r["ndcg"] == pytest.approx(0.543643, abs=1e-6) and r["primary_score"] == pytest.approx(0.396822, abs=1e-6)


def test_sequences_pad_on_the_left(spark):
    df = spark.createDataFrame([(i, 1, i, it) for i, it in enumerate([7, 8, 9])], "row_id long, usr long, t long, item long")
    vocab = spark.createDataFrame([(7, 2), (9, 3)], "item long, id long")
    got = _map(sequence.item_sequence(df, vocab, 3), "row_id", "seq")
    assert got == {0: [0, 0, 0], 1: [0, 0, 2], 2: [0, 2, 1]}
