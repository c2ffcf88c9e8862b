"""Centroid clustering of integer vectors with an incremental distance matrix.

A vector takes part if it has exactly ``DIMS`` components, none null or
non-finite; each component x becomes the integer floor(64 * x). The squared
distance to centroid c is |x|^2 - 2 x.c + |c|^2, so what a vector must remember
is one exact integer dot product per centroid. These dot products are computed in
full once and persisted with the vector. When the centroids move, each is
changed by the nonzero components of its centroid's move only, the argmin is
taken again, and the table is written anew; components that stand still cost
nothing. The new centroids are exact floor means of sums that every task forms
for itself, one row a task and cluster. At most ``k`` rows of ``DIMS`` integers
ever reach the driver.

Defined cases: vectors that take no part are not in the result; a null id keeps
its row, but starts no centroid unless too few others are there; repeated rows
count as often as they occur (of rows with one id the one with the smaller
components starts first); fewer vectors than centroids give as many centroids as
vectors; an empty table gives an empty result; other columns are not read.
Integers beyond +-2**27 raise an error, as squared distances would leave a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

DIMS, SCALE, ROUNDS, CENTROIDS, SEED = 64, 64, 3, 16, 1
#: Larger integers are refused: DIMS * (2 * LARGEST) ** 2 must stay below 2**63.
LARGEST = 1 << 27
STATE = "vec_id bigint, x array<int>, dots array<bigint>, norm bigint, cluster int, distance bigint"


def integers(rows: DataFrame, vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    whole = F.coalesce((F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    scaled = lambda v: F.floor(v * scale)
    fits = lambda v: F.when(F.abs(v * scale) <= LARGEST, scaled(v).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return rows.filter(whole).select("vec_id", F.transform(x, fits).alias("x"))


def _start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first centroids: the ``k`` vectors with the smallest hashes of their ids, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = vectors.select("x", key.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in got], dtype=np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, w = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w, dtype=np.int32)), pa.array(a.ravel(), kind))


def _placed(ids: pa.Array, x: np.ndarray, dots: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    """The state of some vectors whose dot products are those of ``centroids``."""
    d = norm[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]
    at = d.argmin(axis=1)  # the first of equals
    cols = [ids, _lists(x, pa.int32()), _lists(dots, pa.int64()), pa.array(norm), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(d)), at])]
    return pa.RecordBatch.from_arrays(cols, ["vec_id", "x", "dots", "norm", "cluster", "distance"])


def _first(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every dot product in full, once."""

    def rows(batches):
        for b in batches:
            x = _matrix(b.column("x"), centroids.shape[1])
            yield _placed(b.column("vec_id"), x, x @ centroids.T, (x * x).sum(axis=1), centroids)

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "x").mapInArrow(rows, STATE)


def _moved(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """The state after the centroids moved: only components that changed touch the dot products."""
    moves = [(c, np.flatnonzero(after[c] != before[c])) for c in range(len(after))]
    moves = [(c, at, (after[c] - before[c])[at]) for c, at in moves if len(at)]

    def rows(batches):
        for b in batches:
            x = _matrix(b.column("x"), after.shape[1])
            dots = _matrix(b.column("dots"), len(after)).copy()
            for c, at, by in moves:
                dots[:, c] += x[:, at] @ by
            yield _placed(b.column("vec_id"), x, dots, b.column("norm").to_numpy(), after)

    return state.mapInArrow(rows, STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floor means of the clusters; an empty one keeps its centroid. Each task sends one row a cluster."""
    k, dims = centroids.shape

    def rows(batches):
        total, n = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            at = b.column("cluster").to_numpy()
            x = _matrix(b.column("x"), dims)
            for c in np.unique(at):
                total[c] += x[at == c].sum(axis=0)
            n += np.bincount(at, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), _lists(total[some], pa.int64())], ["cluster", "n", "s"])

    parts = state.select("x", "cluster").mapInArrow(rows, "cluster int, n bigint, s array<bigint>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), *[exact(F.col("s")[j]).alias(f"s{j}") for j in range(dims)])
    out = centroids.copy()
    for r in sums.collect():  # k rows at most
        out[r["cluster"]] = [int(r[f"s{j}"]) // int(r["n"]) for j in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of integer vectors (vec_id, x), and the final centroids.

    The state of a round is a Parquet table in the shared folder; the one before
    it goes as soon as the next is written.
    """
    scratch = Scratch(vectors.sparkSession)
    vectors = scratch.save(vectors)
    centroids = _start(vectors, k, seed)
    if not len(centroids):
        return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    state = scratch.save(_first(vectors, centroids))
    scratch.drop(vectors)
    for _ in range(rounds):
        after = _means(state, centroids)
        new = scratch.save(_moved(state, centroids, after))
        scratch.drop(state)
        state, centroids = new, after
    return state.select("vec_id", "cluster", "distance"), centroids


def _by_cluster(values: list, kind: str) -> Column:
    """The value of the row's cluster."""
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")[F.col("cluster")]


def report(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    got, centroids = cluster(integers(rows, vector))
    sums = {r["cluster"]: int(r["s"]) for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    inertia = [sums.get(c, 0) for c in range(max(len(centroids), 1))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()] or [""]
    return got.select("vec_id", "cluster", "distance", _by_cluster(inertia, "bigint").alias("cluster_inertia"), F.lit(sum(inertia)).cast("bigint").alias("inertia"), _by_cluster(names, "string").alias("centroid_sha256"))


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """The contract as DuckDB SQL, with every distance computed in full."""
    steps = [
        f"""k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dims})""",
        "e AS (SELECT r, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM k)",
        f"""c0 AS (SELECT c, unnest(range(1, {dims} + 1)) AS j, unnest(x) AS v
  FROM (SELECT row_number() OVER (ORDER BY sha256({SEED} || ':' || vec_id), x) - 1 AS c, x FROM k ORDER BY c LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT e.r, c.c, CAST(sum((e.v - c.v) * (e.v - c.v)) AS BIGINT) AS d FROM e JOIN c{i} c ON e.j = c.j GROUP BY e.r, c.c)")
        steps.append(f"a{i} AS (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS o FROM d{i}) WHERE o = 1)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT a.c, e.j, CAST(sum(e.v) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN e ON a.r = e.r GROUP BY a.c, e.j)")
            steps.append(f"c{i + 1} AS (SELECT c.c, c.j, CASE WHEN s.n IS NULL THEN c.v ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS v FROM c{i} c LEFT JOIN s{i} s ON c.c = s.c AND c.j = s.j)")
    last = rounds
    return f"""
WITH {", ".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM k JOIN a{last} a ON k.r = a.r JOIN h ON a.c = h.c
"""
