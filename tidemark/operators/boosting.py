"""Boosted stumps on Spark: lambda-rank within users, and out-of-fold label models.

A feature is binned by exact train quantiles. As every tree is a stump, a model is
one number a feature and bin: the driver holds these small tables, and a row's score
is a sum of lookups, whatever the number of rounds. A round is one aggregate of gradients
by (feature, bin); only features x bins sums leave the cluster, and the best
split is read off their prefix sums. Nulls have a bin of their own before all others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.lineage import cut, place
from tidemark.operators.encode import quantiles
from tidemark.operators.metrics import evaluate


#: Steps a unit of summed gradients; 2**31 rows of gradients up to 1 fit a long.
FIXED = 1 << 32


@dataclass
class Stumps:
    """An additive model: the edges of each feature and what each bin adds."""

    edges: dict[str, list[float]]
    base: float = 0.0
    tables: dict[str, list[float]] = field(default_factory=dict)
    gains: dict[str, float] = field(default_factory=dict)
    splits: list[dict] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def __post_init__(self):
        for f, e in self.edges.items():
            self.tables.setdefault(f, [0.0] * (len(e) + 2))
            self.gains.setdefault(f, 0.0)

    def copy_tables(self) -> dict[str, list[float]]:
        return {f: list(t) for f, t in self.tables.items()}

    def score(self, start: Column | None = None) -> Column:
        """The score of a binned row."""
        out = F.lit(self.base) if start is None else start + self.base
        for f, t in self.tables.items():
            if any(t):
                out = out + F.array(*[F.lit(x) for x in t])[F.col(f"_b_{f}")]
        return out

    def shares(self) -> dict[str, float]:
        """The gain of each feature as a share of all."""
        total = sum(self.gains.values())
        return {f: g / total if total else 0.0 for f, g in self.gains.items()}

    def add(self, split: dict, rate: float) -> None:
        for b in range(len(self.tables[split["feature"]])):
            self.tables[split["feature"]][b] += rate * (split["left"] if b <= split["bin"] else split["right"])
        self.gains[split["feature"]] += split["gain"]
        self.splits.append(split)


def edges_of(train: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct values at the train quantiles of each feature; none is interpolated."""
    number = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f))
    return {f: sorted(set(e)) for f, e in quantiles(train, {f: number(f) for f in features}, bins, interpolate=False).items()}


def binned(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Adds ``_b_{feature}``: 0 for null, else one more than the number of edges below the value."""
    below = lambda f, e: F.lit(len(e)) - place([F.lit(-x) for x in reversed(e)], -F.col(f).cast("double"))
    return rows.withColumns({f"_b_{f}": F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), 0).otherwise(1 + below(f, e)) for f, e in edges.items()})


def lambdas(rows: DataFrame, score: Column, user: str = "usr", label: str = "y", row_id: str = "row_id", sigma: float = 2.0, top: int = 20) -> DataFrame:
    """``rows`` with ``g`` and ``h``: gradients of the pairwise nDCG loss within users.

    A pair of a positive and a negative counts if one of them is among the ``top``
    rows of its user, with the weight of the nDCG that swapping them would change. A user's rows come
    to one task in the order of the scores, as a stream: each row meets the top rows, which
    are held until the user ends for what the rows below give back to them.
    """
    by = Window.partitionBy(user).orderBy(F.col("_s").desc(), row_id)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    y = F.coalesce(F.col(label), F.lit(0)).cast("double")
    ranked = rows.withColumn("_s", score.cast("double")).withColumn("_y", y)
    ranked = ranked.withColumns({"_p": F.row_number().over(by), "_np": F.sum("_y").over(whole)})
    names = rows.columns
    ideals = np.concatenate([[1.0], np.cumsum(1 / np.log2(np.arange(1, top + 1) + 1.0))])
    ideals[0] = ideals[1] if top else 1.0

    def pairs(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Gradient and curvature of each row, what each top row gets from the rows below it, and where users start."""
        s, y, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_s", "_y", "_p"))
        ideal = ideals[np.clip(b.column("_np").to_numpy(zero_copy_only=False), 0, top).astype(np.int64)]
        starts = np.flatnonzero(p == 1)
        of = np.cumsum(p == 1) - 1
        held = np.minimum(np.diff(np.append(starts, len(p))), top)
        g, h, bg, bh = (np.zeros(len(p)) for _ in range(4))
        for k in range(int(held.max(initial=0))):
            at = starts[of] + k
            some = np.flatnonzero(held[of] > k)
            some = some[y[some] != y[at[some]]]
            j = at[some]
            up = np.where(y[some] > y[j], 1.0, -1.0)
            with np.errstate(over="ignore"):
                rho = 1 / (1 + np.exp(up * sigma * (s[some] - s[j])))
            w = np.abs(1 / np.log2(p[some] + 1.0) - 1 / np.log2(p[j] + 1.0)) / ideal[some]
            dg, dh = -up * sigma * rho * w, sigma * sigma * rho * (1 - rho) * w
            g[some] += dg
            h[some] += dh
            below = p[some] > top
            bg -= np.bincount(j[below], dg[below], len(p))
            bh += np.bincount(j[below], dh[below], len(p))
        return g, h, bg, bh, starts

    def out(b, g, h, at):
        part = pa.array(at)
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(part) for c in names], pa.array(g[at]), pa.array(h[at])], [*names, "g", "h"])

    def stream(batches):
        held = None  # the last user's top rows, and what they got so far
        for b in batches:
            if not b.num_rows:
                continue
            kept = np.zeros((2, 0))
            if held is not None:
                b, kept = pa.concat_batches([held[0], b.cast(held[0].schema)]), held[1]
            g, h, bg, bh, starts = pairs(b)
            bg[: kept.shape[1]] += kept[0]
            bh[: kept.shape[1]] += kept[1]
            a = starts[-1]
            z = min(len(g), a + top)
            at = np.concatenate([np.arange(a), np.arange(z, len(g))])
            if len(at):
                yield from out(b, g + bg, h + bh, at)
            held = b.slice(a, z - a), np.stack([bg[a:z], bh[a:z]])
        if held is not None and held[0].num_rows:
            g, h, _, _, _ = pairs(held[0])
            yield from out(held[0], g + held[1][0], h + held[1][1], np.arange(len(g)))

    schema = T.StructType([*rows.schema.fields, T.StructField("g", T.DoubleType()), T.StructField("h", T.DoubleType())])
    return ranked.mapInArrow(stream, schema)


def histogram(rows: DataFrame, features: list[str], sums: dict[str, Column]) -> dict[str, list[dict]]:
    """For each feature its bins in order, with their sums and rows, from one aggregate."""
    cells = rows.select(*[v.alias(k) for k, v in sums.items()], F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_b_{f}").alias("b")) for i, f in enumerate(features)])).alias("c"))
    got = cells.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in sums]).collect()  # features x bins rows
    out: dict[str, list[dict]] = {f: [] for f in features}
    for r in sorted(got, key=lambda r: tuple(r["c"])):
        out[features[r["c"]["f"]]].append({"bin": r["c"]["b"], "n": r["n"], **{k: r[k] or 0.0 for k in sums}})
    return out


def best_split(cells: dict[str, list[dict]], g: str = "g", h: str = "h", n: str = "n", least: int = 1, ridge: float = 1.0) -> dict | None:
    """The split with the greatest gain; of equals (to nine digits) the first feature's lowest bin."""
    best = None
    for f, bins in cells.items():
        total = [sum(b[k] for b in bins) for k in (g, h, n)]
        left = [0.0, 0.0, 0]
        for b in bins[:-1]:
            left = [x + b[k] for x, k in zip(left, (g, h, n), strict=True)]
            right = [t - x for t, x in zip(total, left, strict=True)]
            if left[2] < least or right[2] < least:
                continue
            worth = lambda s: s[0] * s[0] / (s[1] + ridge)
            gain = worth(left) + worth(right) - worth(total)
            if gain > 0 and (best is None or round(gain, 9) > round(best["gain"], 9)):
                best = {"feature": f, "bin": b["bin"], "gain": gain, "left": -left[0] / (left[1] + ridge), "right": -right[0] / (right[1] + ridge)}
    return best


def first_split(train: DataFrame, features: list[str], start: Column, bins: int = 16, **how) -> dict | None:
    """The split that boosting would begin with, from given scores."""
    rows = binned(train, edges_of(train, features, bins))
    return best_split(histogram(lambdas(rows, start, **how), features, {"g": F.col("g"), "h": F.col("h")}))


def fit_ranker(train: DataFrame, valid: DataFrame, features: list[str], rounds: int = 50, rate: float = 0.1, bins: int = 32, patience: int = 30, least: int = 20, ridge: float = 1.0, **how) -> Stumps:
    """Lambda-rank stumps; stops after ``patience`` rounds without a better primary metric on ``valid`` and keeps the best round.

    ``train`` and ``valid`` hold usr, row_id, y and the features.
    """
    model = Stumps(edges_of(train, features, bins))
    narrow = lambda df: cut(binned(df, model.edges).select("usr", "row_id", "y", *[f"_b_{f}" for f in features]))
    train, valid = narrow(train), narrow(valid)
    best, kept, bad = -1.0, (model.copy_tables(), 0), 0
    for _ in range(rounds):
        split = best_split(histogram(lambdas(train, model.score(), **how), features, {"g": F.col("g"), "h": F.col("h")}), least=least, ridge=ridge)
        if split is None:
            break
        model.add(split, rate)
        model.history.append(evaluate(valid.withColumn("score", model.score())).first()["primary_score"])
        if model.history[-1] > best + 1e-5:
            best, kept, bad = model.history[-1], (model.copy_tables(), len(model.splits)), 0
        else:
            bad += 1
            if bad >= patience:
                break
    model.tables, model.splits = kept[0], model.splits[: kept[1]]
    model.gains = {f: sum(s["gain"] for s in model.splits if s["feature"] == f) for f in features}
    return model


def predict(rows: DataFrame, model: Stumps, name: str = "score") -> DataFrame:
    """``rows`` with the model's score."""
    return binned(rows, model.edges).withColumn(name, model.score()).drop(*[f"_b_{f}" for f in model.edges])


def fit_folds(train: DataFrame, labels: list[str], features: list[str], fold: str = "fold", folds: int = 5, rounds: int = 10, rate: float = 0.3, bins: int = 16, least: int = 20, ridge: float = 1.0) -> dict[tuple[str, int], Stumps]:
    """Logistic stumps for each label and left-out fold, and for each label without one (fold -1).

    All models grow together. As stumps see bins alone, rows are counted once by fold and bins, with
    the sum of each label: a round is one pass over these counts, which are bounded by the kinds of bins,
    not by the rows. A batch is scored by all models and summed in fixed point, so a model does
    not depend on the order of its rows. Labels are 0 or 1, null counts as 0.
    """
    edges = edges_of(train, features, bins)
    keys = [(label, k) for label in labels for k in range(-1, folds)]
    kinds = [F.col(f"_b_{f}").cast("int").alias(f"_b_{f}") for f in features]
    rows = binned(train, edges).select(F.col(fold).cast("bigint").alias("_fold"), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(f"_l{i}") for i, c in enumerate(labels)], *kinds)
    cells = cut(rows.groupBy("_fold", *[f"_b_{f}" for f in features]).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_l{i}").alias(f"s{i}") for i in range(len(labels))]))
    used = lambda k, v: v if k < 0 else F.when(F.col("_fold") != k, v)
    first = cells.agg(*[F.sum(used(k, F.col(v))).alias(f"{n}{i}") for i, (label, k) in enumerate(keys) for n, v in (("s", f"s{labels.index(label)}"), ("n", "n"))]).first()
    rates = {key: ((first[f"s{i}"] or 0) + 0.5) / ((first[f"n{i}"] or 0) + 1) for i, key in enumerate(keys)}
    models = {key: Stumps(edges, base=math.log(rates[key] / (1 - rates[key]))) for key in keys}
    for _ in range(rounds):
        found = _cell_sums(cells, features, len(labels), [models[key] for key in keys], folds)
        for i, key in enumerate(keys):
            split = best_split({f: [{"bin": b, "g": g / FIXED, "h": h / FIXED, "n": n} for b, g, h, n in found.get((i, j), [])] for j, f in enumerate(features)}, "g", "h", "n", least, ridge)
            if split is not None:
                models[key].add(split, rate)
    return models


def _cell_sums(cells: DataFrame, features: list[str], labels: int, models: list[Stumps], folds: int) -> dict[tuple[int, int], list[tuple]]:
    """For each model and feature its bins in order, with the gradients and curvatures (in fixed point) and the rows that it learns from."""
    base = np.array([m.base for m in models])
    tables = {f: np.array([m.tables[f] for m in models]) for f in features}
    fixed = lambda v: (np.sign(v) * np.floor(np.abs(v) * FIXED + 0.5)).astype(np.int64)

    def sums(batches):
        total = [np.zeros((3, *tables[f].shape), dtype=np.int64) for f in features]
        for batch in batches:
            if not batch.num_rows:
                continue
            b = {f: batch.column(f"_b_{f}").to_numpy() for f in features}
            fold = batch.column("_fold").fill_null(folds).to_numpy()  # no fold's models learn from a row without one
            n = batch.column("n").to_numpy()
            score = np.repeat(base[:, None], len(n), 1)
            for f in features:
                score += tables[f][:, b[f]]
            with np.errstate(over="ignore"):
                q = 1 / (1 + np.exp(-score))
            seen = np.array([np.full(len(n), True) if k < 0 else (fold != k) & (fold != folds) for k in range(-1, folds)])
            seen = np.tile(seen, (labels, 1)) * n
            s = np.repeat(np.array([batch.column(f"s{i}").to_numpy() for i in range(labels)]), folds + 1, 0) * (seen > 0)
            each = np.stack([(seen - s) * fixed(q) + s * fixed(q - 1), seen * fixed(q * (1 - q)), seen])
            for f, t in zip(features, total, strict=True):
                by = np.argsort(b[f], kind="stable")
                x = b[f][by]
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                t[:, :, x[first]] += np.add.reduceat(each[:, :, by], first, 2)
        for j, t in enumerate(total):
            i, at = (x.ravel() for x in np.indices(t.shape[1:]))
            some = np.flatnonzero(t[2].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (i, np.full(len(i), j), at, *(y.ravel() for y in t))], ["i", "f", "b", "g", "h", "n"])

    got = cells.mapInArrow(sums, "i bigint, f bigint, b bigint, g bigint, h bigint, n bigint").groupBy("i", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    out: dict[tuple[int, int], list[tuple]] = {}
    for r in sorted(got.collect()):  # models x features x bins rows
        out.setdefault((r["i"], r["f"]), []).append((r["b"], r["g"], r["h"], r["n"]))
    return out


def fold_scores(rows: DataFrame, models: dict[tuple[str, int], Stumps], fold: str | None = "fold", prefix: str = "aux_") -> DataFrame:
    """``rows`` with a probability a label: by the model that left the row's fold out, or by the whole one without a fold.

    The models of a label are one array a feature, looked up by fold and bin.
    """
    edges = next(iter(models.values())).edges
    out = binned(rows, edges)
    for label in {key[0]: None for key in models}:
        folds = sorted(k for name, k in models if name == label and k >= 0) if fold else []
        mine = [models[label, k] for k in (-1, *folds)]
        which = F.coalesce(*[F.when(F.col(fold) == k, i) for i, k in enumerate(folds, 1)], F.lit(0))
        held = lambda values, at: F.array(*[F.lit(x) for x in values])[at]  # noqa: B023, E731
        score = held([m.base for m in mine], which)
        for f, e in edges.items():
            if any(any(m.tables[f]) for m in mine):
                score = score + held([x for m in mine for x in m.tables[f]], which * (len(e) + 2) + F.col(f"_b_{f}"))
        out = out.withColumn(f"{prefix}{label}", 1 / (1 + F.exp(-score)))
    return out.drop(*[f"_b_{f}" for f in edges])
