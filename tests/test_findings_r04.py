"""Fits whose rounds do not grow with the rows, and trainers that run until they stop by themselves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting


def test_rounds_of_fold_models_read_counts_not_rows(spark, monkeypatch):
    """Equal to boosting row by row in plain Python, with missing folds, labels and values, from a row a fold and kind of bins."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        x, z = rng.randrange(6), None if i % 11 == 0 else float(rng.randrange(4))
        rows.append((None if i % 50 == 0 else i % 3, float(x), z, None if i % 37 == 0 else int(rng.random() < 0.1 + 0.13 * x), int(rng.random() < 0.2 + 0.15 * (z or 0))))
    df = spark.createDataFrame(rows, "fold long, x double, z double, y long, other long").repartition(5)
    seen, sums = [], boosting._cell_sums
    monkeypatch.setattr(boosting, "_cell_sums", lambda cells, *a: seen.append(cells.count()) or sums(cells, *a))
    models = boosting.fit_folds(df, ["y", "other"], ["x", "z"], folds=3, rounds=3, bins=4)
    kinds = {(r[0], *(0 if v is None else 1 + sum(e < v for e in models["y", -1].edges[f]) for f, v in zip("xz", r[1:3], strict=True))) for r in rows}
    assert seen == [len(kinds)] * 3 and len(kinds) < 90
    for i, label in enumerate(("y", "other")):
        for k in (-1, 0, 1, 2):
            m = models[label, k]
            mine = [(1 + sum(e < r[1] for e in m.edges["x"]), 0 if r[2] is None else 1 + sum(e < r[2] for e in m.edges["z"]), r[3 + i] or 0) for r in rows if k < 0 or r[0] not in (None, k)]
            rate = (sum(r[2] for r in mine) + 0.5) / (len(mine) + 1)
            plain = boosting.Stumps(m.edges, base=math.log(rate / (1 - rate)))
            for _ in range(3):
                q = [1 / (1 + math.exp(-(plain.base + plain.tables["x"][a] + plain.tables["z"][b]))) for a, b, _ in mine]
                cells = {}
                for j, f in enumerate("xz"):
                    some = sorted({r[j] for r in mine})
                    at = lambda b: [n for n, r in enumerate(mine) if r[j] == b]  # noqa: B023, E731
                    cells[f] = [{"bin": b, "n": len(at(b)), "g": sum(q[n] - mine[n][2] for n in at(b)), "h": sum(q[n] * (1 - q[n]) for n in at(b))} for b in some]
                plain.add(boosting.best_split(cells, least=20), 0.3)
            assert m.base == pytest.approx(plain.base)
            assert all(m.tables[f] == pytest.approx(plain.tables[f], abs=1e-6) for f in "xz")
    got = boosting.fold_scores(df, models).collect()
    for r in got:
        for label in ("y", "other"):
            m = models[label, -1 if r["fold"] is None else r["fold"]]
            b = {f: 0 if r[f] is None else 1 + sum(e < r[f] for e in m.edges[f]) for f in "xz"}
            assert r[f"aux_{label}"] == pytest.approx(1 / (1 + math.exp(-(m.base + m.tables["x"][b["x"]] + m.tables["z"][b["z"]]))))
    assert len(got) == 900 and boosting.fold_scores(df.withColumn("fold", F.lit(7)), models).count() == 900


def asked(spark, monkeypatch, name):
    """What a query gives to the fit: its train rows, loss, epochs and patience."""
    from tidemark.operators import factorization as fm
    from tidemark.queries import QUERIES

    class Seen(Exception):
        pass

    def see(train, valid, fields, loss, epochs=40, patience=4):
        raise Seen(train, loss, epochs, patience)

    monkeypatch.setattr(fm, "fit", see)
    with pytest.raises(Seen) as e:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    return e.value.args


@pytest.mark.parametrize("name", ["fm_pairs_train", "fm_pointwise_train", "listwise_train", "multitask_train"])
def test_training_ends_by_its_metric(spark, monkeypatch, name):
    """The patience is well within the epochs, so it is the metric that ends the training."""
    _, _, epochs, patience = asked(spark, monkeypatch, name)
    assert (epochs, patience) == (40, 4)


def test_lists_are_whole(spark, monkeypatch):
    """Every row of a user with a positive has its part in a step, however long the list."""
    _, loss, _, _ = asked(spark, monkeypatch, "listwise_train")
    rows = spark.range(130).select(F.col("id").alias("row_id"), F.when(F.col("id") < 120, 1).otherwise(2).alias("usr"), (F.col("id") % 3 == 0).cast("long").alias("y"), (F.col("id") % 7 / 7).alias("score"))
    got = {r["row_id"]: r["g"] for r in loss(rows, 0).collect()}
    e = {i: math.exp(i % 7 / 7) for i in range(130)}
    for part in (range(120), range(120, 130)):
        total, pos = sum(e[i] for i in part), sum(i % 3 == 0 for i in part)
        assert all(got[i] == pytest.approx((e[i] / total - (i % 3 == 0) / pos) / 2) for i in part)
    assert len(got) == 130


def test_shards_look_each_string_up_once_a_slice(monkeypatch):
    """Codes in the order of suffixes equal those by place, from far fewer look-ups; runs are put together as a loop would."""
    import numpy as np

    from tidemark.llm import bwt_dedup as bd

    rng = random.Random(3)
    words = [bytes(rng.choices(b"abcdef", k=5)) for _ in range(40)]
    t = bd.Transform([b" ".join(rng.choices(words, k=700)) for _ in range(8)])
    grams = np.unique(bd._packed(np.resize(t.text, t.n + 4), t.n, 4))
    blocks = bd.Blocks([t.prefix(t.n // 3), t.prefix(t.n // 2)])
    symbols = bd.Blocks(blocks.splitters, 4, grams)
    own = np.repeat(np.arange(3, dtype=np.int16), np.diff(t.bounds(blocks.splitters)))
    by_place = np.empty(t.n, dtype=np.int16)
    by_place[t.order] = own
    want = np.roll(symbols.of(t.text, by_place), 4)[t.order]
    asked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x: asked.append(len(v)) or search(a, v, *x))
    assert (t.coded(blocks, symbols)[0] == want).all()
    assert 0 < sum(asked) <= len(grams) * -(-t.n // bd.SLICE)
    parts, rows = [], []
    for _ in range(4):
        codes = np.sort(np.array(rng.choices(range(9), k=50), dtype=np.uint16))
        first, counts = bd._runs_of(codes)
        z, names = np.array(rng.choices(range(5), k=50), dtype=np.uint8), np.arange(len(first), dtype=np.uint64)
        parts.append((z, np.zeros(50, dtype=bool), codes[first], counts, names, names))
        rows += zip(codes.tolist(), z.tolist(), strict=True)
    assert bd.assemble(parts, blocks).z.tolist() == [z for _, z in sorted(rows, key=lambda r: r[0])]
