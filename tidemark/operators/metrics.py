"""Grouped ranking metrics: GAUC, nDCG@k and their mean."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import average_rank


def user_metrics(df: DataFrame, user: str = "usr", label: str = "y", score: str = "score", row_id: str = "row_id", k: int = 5, by: list[str] | None = None) -> DataFrame:
    """A row a user (and segment): rows, positives, AUC (null for one class) and nDCG@k.

    Ties count half in the AUC; in the nDCG they keep the order of row ids.
    """
    g = [*(by or []), user]
    place = F.row_number().over(Window.partitionBy(*g).orderBy(F.col(score).desc(), F.col(row_id)))
    ideal = F.row_number().over(Window.partitionBy(*g).orderBy(F.col(label).desc(), F.col(row_id)))
    rows = df.select(*g, F.col(label).cast("double").alias("_y"), average_rank(g, score).alias("_r"), place.alias("_p"), ideal.alias("_i"))
    gain = F.pow(F.lit(2.0), "_y") - 1
    per = rows.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_y").alias("pos"),
        F.sum(F.col("_r") * F.col("_y")).alias("_rs"),
        F.sum(F.when(F.col("_p") <= k, gain / F.log2(F.col("_p") + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(F.col("_i") <= k, gain / F.log2(F.col("_i") + 1.0)).otherwise(0.0)).alias("_idcg"),
    )
    mixed = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    auc = F.when(mixed, (F.col("_rs") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * (F.col("n") - F.col("pos"))))
    return per.select(*g, "n", "pos", auc.alias("auc"), F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")).otherwise(0.0).alias("ndcg"))


def evaluate(df: DataFrame, user: str = "usr", label: str = "y", score: str = "score", row_id: str = "row_id", k: int = 5, by: list[str] | None = None) -> DataFrame:
    """gauc (users weighted by positives), ndcg (mean over all users), primary, users and n_rows, by segment."""
    per = user_metrics(df, user, label, score, row_id, k, by)
    weight = F.when(F.col("auc").isNotNull(), F.col("pos"))
    out = per.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(F.col("auc") * weight) / F.sum(weight), F.lit(0.5)).alias("gauc"),
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"),
        F.count(F.lit(1)).alias("users"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )
    return out.withColumn("primary_score", (F.col("gauc") + F.col("ndcg")) / 2)


#: Rows of whole users that are ranked at once; users with more go the way of ``evaluate``.
GRID_ROWS = 500_000


def _ranked(score: np.ndarray, y: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """AUC's rank sums of positives and DCG@k of each group; rows are sorted by group and row id, groups are numbered from 0."""
    at = np.lexsort((-score, group))  # stable, so ties keep the order of row ids
    s, g, v = score[at], group[at], y[at]
    n = len(s)
    first = np.concatenate([[True], g[1:] != g[:-1]])
    starts = np.flatnonzero(first)
    place = np.arange(n) - starts[g]
    sizes = np.diff(np.append(starts, n))
    # peers of one score share the mean of their ascending ranks
    run = np.flatnonzero(first | np.concatenate([[True], s[1:] != s[:-1]]))
    length = np.diff(np.append(run, n))
    rank = np.repeat(sizes[g[run]] - place[run] - (length - 1) / 2.0, length)
    gain = np.where(place < k, (np.exp2(v) - 1) / np.log2(place + 2.0), 0.0)
    return np.add.reduceat(rank * v, starts), np.add.reduceat(gain, starts)


def evaluate_grid(df: DataFrame, cols: list[str], weights: list[list[float]], user: str = "usr", label: str = "y", row_id: str = "row_id", k: int = 5, by: list[str] | None = None) -> DataFrame:
    """``evaluate`` of weighted sums of ``cols`` at many weights: a row a segment and ``point`` (the number of its weights).

    The log is shuffled once, by user, whatever the number of points: a task takes whole
    users, ranks them at every point and sends on partial sums a point. Users with more
    than ``GRID_ROWS`` rows are evaluated by windows, which spill, point by point.
    """
    by = by or []
    g = [*by, user]
    df = df.select(*g, F.col(row_id).alias("_row"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("_y"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    wide = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > GRID_ROWS).select(*[F.col(c).alias(f"_w_{c}") for c in g])
    some = bool(wide.limit(1).count())
    large = None
    if some:
        met = [df[c].eqNullSafe(wide[f"_w_{c}"]) for c in g]
        for c in met[1:]:
            met[0] = met[0] & c
        large = df.join(wide, met[0], "left_semi")
        df = df.join(wide, met[0], "left_anti")
    kinds = {c: df.schema[c].dataType for c in by}
    names = ["point", "_auc", "_pos", "_ndcg", "users", "n_rows"]

    def sums(table: pa.Table, groups: np.ndarray, starts: np.ndarray):
        """Partial sums of whole users by segment and point."""
        y = table.column("_y").to_numpy()
        c = [np.nan_to_num(table.column(f"_c{i}").to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf) for i in range(len(cols))]
        n, pos = np.diff(np.append(starts, len(y))), np.add.reduceat(y, starts)
        ideal = _ranked(y, y, groups, k)[1]
        mixed = (pos > 0) & (pos < n)
        if by:
            keys = [table.column(b).take(pa.array(starts)).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for b in by]
            _, heads, segment = np.unique(np.stack(keys), axis=1, return_index=True, return_inverse=True)
            segment = segment.ravel()
        else:
            heads, segment = np.array([0]), np.zeros(len(starts), dtype=np.int64)
        out = []
        for p, w in enumerate(weights):
            score = c[0] * w[0]
            for x, v in zip(c[1:], w[1:], strict=True):
                score = score + x * v
            rs, dcg = _ranked(score, y, groups, k)
            auc = np.where(mixed, (rs - pos * (pos + 1) / 2) / np.maximum(pos * (n - pos), 1e-300), 0.0)
            total = lambda v: np.bincount(segment, v, len(heads))  # noqa: B023, E731
            ndcg = np.where(ideal > 0, dcg / np.where(ideal > 0, ideal, 1), 0.0)
            out.append([total(auc * pos * mixed), total(pos * mixed), total(ndcg), total(np.ones(len(n))).astype(np.int64), total(n).astype(np.int64)])
        where = pa.array(starts[heads])
        cols_out = [pa.concat_arrays([table.column(b).take(where).combine_chunks()] * len(weights)) for b in by]
        cols_out.append(pa.array(np.repeat(np.arange(len(weights)), len(heads))))
        cols_out += [pa.array(np.concatenate([o[i] for o in out])) for i in range(5)]
        return pa.RecordBatch.from_arrays(cols_out, [*by, *names])

    def rows(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= GRID_ROWS:
                table = pa.Table.from_batches(held)
                _, starts = numbered(table)
                if len(starts) > 1:  # the last user may go on
                    whole = table.slice(0, starts[-1])
                    yield sums(whole, *numbered(whole))
                    held = table.slice(starts[-1]).to_batches()
                    size = sum(x.num_rows for x in held)
        if held:
            table = pa.Table.from_batches(held)
            yield sums(table, *numbered(table))

    def numbered(table: pa.Table):
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in g:
            code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new) - 1, np.flatnonzero(new)

    kind = ", ".join([*[f"`{c}` {t.simpleString()}" for c, t in kinds.items()], "point bigint, _auc double, _pos double, _ndcg double, users bigint, n_rows bigint"])
    parts = df.repartition(*g).sortWithinPartitions(*g, "_row").mapInArrow(rows, kind)
    if large is not None:
        for p, w in enumerate(weights):
            score = F.col("_c0") * w[0]
            for i, v in enumerate(w[1:], 1):
                score = score + F.col(f"_c{i}") * v
            per = user_metrics(large.withColumn("score", score), user, "_y", "score", "_row", k, by)
            pos = F.when(F.col("auc").isNotNull(), F.col("pos")).otherwise(0.0)
            parts = parts.unionByName(per.groupBy(*by).agg(F.lit(p).cast("bigint").alias("point"), F.sum(F.coalesce(F.col("auc") * pos, F.lit(0.0))).alias("_auc"), F.sum(pos).alias("_pos"), F.sum("ndcg").alias("_ndcg"), F.count(F.lit(1)).alias("users"), F.sum("n").alias("n_rows")))
    out = parts.groupBy(*by, "point").agg(*[F.sum(c).alias(c) for c in names[1:]])
    gauc = F.when(F.col("_pos") > 0, F.col("_auc") / F.col("_pos")).otherwise(0.5)
    out = out.select(*by, "point", gauc.alias("gauc"), (F.col("_ndcg") / F.col("users")).alias("ndcg"), "users", "n_rows")
    return out.withColumn("primary_score", (F.col("gauc") + F.col("ndcg")) / 2)


def user_composition(df: DataFrame, user: str = "usr", label: str = "y", by: list[str] | None = None) -> DataFrame:
    """Shares of users with no, only and mixed positives."""
    per = df.groupBy(*(by or []), user).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    share = lambda c: F.avg(c.cast("double"))
    return per.groupBy(*(by or [])).agg(share(F.col("p") == 0).alias("all_negative"), share(F.col("p") == F.col("n")).alias("all_positive"), share((F.col("p") > 0) & (F.col("p") < F.col("n"))).alias("discriminative"))
