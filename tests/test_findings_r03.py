"""Rows beyond the sizes that the other tests reach, and plans that read their input once."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.queries import ORACLES, QUERIES


def test_moved_ids_that_meet_other_rows(spark, tmp_path):
    """Beyond 1,000,000 rows a moved id is another row's: judged by its ids and score, as in the SQL."""
    c = duckdb.connect()
    c.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-25' + to_seconds(i % 1000) AS ts, i % 977 AS user_id, 'view' AS event_type, 1e0 AS value, '{{"k": ' || i % 89 || '}}' AS props
      FROM range(1010000) t(i)) TO '{tmp_path}/events.parquet'""")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = dict(c.execute(ORACLES["submission_violations"]).fetchall())
    got = {r["violation"]: r["n_rows"] for r in QUERIES["submission_violations"](spark, str(tmp_path)).collect()}
    assert got == want


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, module, fit", [("fm_pointwise_train", "factorization", "fit"), ("lambda_stumps", "boosting", "fit_ranker"), ("aux_fold_scores", "boosting", "fit_folds"), ("fm_train", "models", "train_fm")])
def test_fits_read_their_features_from_a_table(spark, monkeypatch, name, module, fit):
    """Each round of a fit would otherwise build the features again."""
    import importlib

    class Seen(Exception):
        pass

    def see(train, *_, **__):
        raise Seen(train.inputFiles())

    monkeypatch.setattr(importlib.import_module(f"tidemark.operators.{module}"), fit, see)
    with pytest.raises(Seen) as e:
        QUERIES[name](spark, SF)
    assert e.value.args[0] and all("/cut-" in f for f in e.value.args[0])


def test_a_step_saves_no_vectors_of_fields(spark, monkeypatch):
    from tidemark.operators import factorization as fm

    rows = spark.createDataFrame([(i, i % 5, i % 3, i % 2) for i in range(40)], "row_id long, usr long, item long, y long")
    m, saved, cut = fm.machine(rows, ["usr", "item"], 3), [], fm.cut
    assert m.sizes == {"usr": 5, "item": 3}
    monkeypatch.setattr(fm, "cut", lambda df: saved.append(df.columns) or cut(df))
    fm.step(rows, m, fm.pointwise())
    assert len(saved) == 3 and not any(c.startswith("_v_") for columns in saved for c in columns)


def test_a_long_list_of_a_user_spans_arrow_batches(spark):
    """Gradients of a user whose rows come in many batches equal those of one batch, and none is lost."""
    from tidemark.operators import boosting

    df = spark.range(700).select(F.col("id").alias("row_id"), F.when(F.col("id") < 600, 1).otherwise(F.col("id") % 7).alias("usr"), (F.col("id") * 7919 % 3 % 2).alias("y"), (F.col("id") * 31 % 97 / 10).alias("s"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old, got = spark.conf.get(size), []
    for n in ("13", "10000"):
        spark.conf.set(size, n)
        got.append({r["row_id"]: (r["g"], r["h"]) for r in boosting.lambdas(df, F.col("s")).collect()})
    spark.conf.set(size, old)
    assert len(got[0]) == 700 and all(got[0][i] == pytest.approx(got[1][i], abs=1e-12) for i in got[1])
    assert "Join" not in boosting.lambdas(df, F.col("s"))._jdf.queryExecution().optimizedPlan().toString()


def test_stacking_builds_its_rows_once(spark):
    from tidemark.operators import models

    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("y"), (F.col("id") % 3).alias("fold"), (F.col("id") % 10 / 10).alias("x"))
    got = models.stacked(rows, ["x"])
    assert got.count() == 300 and got.inputFiles() and all("/cut-" in f for f in got.inputFiles())


def test_days_of_a_key_are_one_row(spark):
    """Features by key and day come without a join back to the log, for keys of short and of long spans."""
    from tidemark.operators.history import daily_history

    rows = [(u, day, 1) for u, step in ((1, 1), (2, 90)) for day in range(0, 30 * step, step) for _ in range(2)] + [(3, None, 1)]
    got = daily_history(spark.createDataFrame(rows, "usr long, day long, y long"), ["usr"], {"n": F.lit(1)}, {"d": (F.col("y"), 2.0)})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    seen = {(r["usr"], r["day"]): (r["n"], r["d"]) for r in got.collect()}
    assert len(seen) == 60
    for (u, day), (n, d) in seen.items():
        past = [x for v, x, _ in rows if v == u and x < day]
        assert n == len(past) and d == pytest.approx(sum(0.5 ** ((day - x) / 2) for x in past), abs=1e-12)
