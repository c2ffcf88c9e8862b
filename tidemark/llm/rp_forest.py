"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample of SAMPLE rows (chosen by hash): each inner
node splits by the median of the projection on the difference of two random
sample vectors. Every row is then indexed: it falls to one leaf of each tree. A
query walks all trees through one shared priority queue, whose priority is the
sum of the squared margins crossed on the way, and takes the best leaves, of all
trees together as many as a share of one tree's (see ``leaves_read``).
Leaf members are reranked by exact Euclidean distance in double precision.

Neighbouring leaves of a tree are packed into groups of about BLOCK rows, so a
query's vector goes once to a group, not once to a leaf; leaves with more rows
are split by a hash of the id, and the queries of a group into blocks of QBLOCK.
No task holds more than one block of each. A block hands on a query's K best;
these meet by query and candidate, and a ranked window limits them to K before
its shuffle. The leaf counts that the packing needs are TREES * 2**DEPTH numbers
at most, whatever the input.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows without an id;
repeated vectors are ties; an id that repeats is the query's own row and no
candidate of itself, and one candidate at its least distance; fewer than K
candidates are all returned; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Rows that the trees are fitted on at most.
SAMPLE = 32_768
TREES = 8
DEPTH = 10
#: Sample rows of a leaf at least.
LEAF_SAMPLE = 32
#: Leaves read by a query in the deepest forest, as a share of one tree's.
READ = 0.55
#: Rows of a group of leaves, and queries that meet it, in one task.
BLOCK = 4_096
QBLOCK = 4_096
#: Exact distances computed at a time, and candidates that a task holds before it ranks them.
PAIRS, HELD = 1 << 16, 1 << 19
K = 10
SEED = 5


class Forest:
    """Split normals and thresholds of complete binary trees, in heap order."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth, dim = depth, sample.shape[1] if sample.size else 1
        self.normals = np.zeros((trees, 2**depth - 1, dim))
        self.cuts = np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            held = [np.arange(len(sample))]
            for node in range(2**depth - 1):
                rows = held[node]
                w = np.zeros(dim)
                if len(rows) >= 2:
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    w = a - b if np.any(a != b) else rng.standard_normal(dim)
                    w = w / np.linalg.norm(w)
                else:
                    w = rng.standard_normal(dim)
                    w = w / np.linalg.norm(w)
                p = sample[rows] @ w if len(rows) else np.zeros(0)
                c = float(np.median(p)) if len(rows) else 0.0
                self.normals[t, node], self.cuts[t, node] = w, c
                held += [rows[p < c], rows[p >= c]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row."""
        out = np.zeros((len(x), len(self.cuts)), dtype=np.int32)
        for t in range(len(self.cuts)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[t, node]) >= self.cuts[t, node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, x: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The best (tree, leaf) pairs for one query, by a priority queue over all trees."""
        margin = [(self.normals[t] @ x - self.cuts[t]).tolist() for t in range(len(self.cuts))]
        queue = [(0.0, t, 0) for t in range(len(margin))]
        found: list[tuple[int, int]] = []
        first = 2**self.depth - 1
        while queue and len(found) < probes:
            p, t, node = heapq.heappop(queue)
            if node >= first:
                found.append((t, node - first))
                continue
            m = margin[t][node]
            heapq.heappush(queue, (p + max(m, 0.0) ** 2, t, 2 * node + 1))
            heapq.heappush(queue, (p + min(m, 0.0) ** 2, t, 2 * node + 2))
        return found


class Packing:
    """Leaves of each tree, by count, as groups of about BLOCK rows; fuller leaves as blocks."""

    def __init__(self, counts: np.ndarray):
        self.group, self.blocks = np.zeros(counts.shape, dtype=np.int32), []
        for t in range(len(counts)):
            held = BLOCK
            for leaf, c in enumerate(counts[t].tolist()):
                if held + c > BLOCK:
                    self.blocks.append(max(1, -(-c // BLOCK)))
                    held = 0
                self.group[t, leaf] = len(self.blocks) - 1
                held += c


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Vectors of one length, which hold no nulls, as rows of doubles."""
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.stack(column.to_numpy()).astype(np.float64)


def _best(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query, each candidate once; ties to the smaller id."""
    at = np.lexsort((d, ids, q))
    q, ids, d = q[at], ids[at], d[at]
    once = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])] if len(q) else np.zeros(0, bool)
    q, ids, d = q[once], ids[once], d[once]
    at = np.lexsort((ids, d, q))
    q, ids, d = q[at], ids[at], d[at]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], ids[top], d[top]


def _near(x: np.ndarray, xi: np.ndarray, q: np.ndarray, qi: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query place, row place, exact distance) of all that can be among a query's k nearest rows."""
    # an id may repeat: its rows take one place together
    k = min(len(x), k * int(np.unique(xi, return_counts=True)[1].max()) + 1)
    n2, step = (x * x).sum(axis=1), max(1, (1 << 20) // len(x))
    for a in range(0, len(q), step):
        y = q[a : a + step]
        m2 = (y * y).sum(axis=1)
        rough = n2[None, :] - 2 * y @ x.T + m2[:, None]
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * (1 + m2 + n2.max())
        j, i = np.nonzero((rough <= edge[:, None]) & (qi[a : a + step, None] != xi[None, :]))
        for b in range(0, len(i), PAIRS):
            yield j[b : b + PAIRS] + a, i[b : b + PAIRS], np.sqrt(((x[i[b : b + PAIRS]] - y[j[b : b + PAIRS]]) ** 2).sum(axis=1))


def leaves_read(depth: int) -> int:
    """Leaves that a query reads over all trees: a share of one tree's that falls from 2.2 at depth 0 to 0.55 at DEPTH.

    One rule at every size, from measured recall: smaller forests have coarser leaves, whose order tells less.
    """
    return math.ceil(READ * 2 ** ((DEPTH - depth) / 5) * 2**depth)


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for the rows that ``is_query`` marks."""
    spark = table.sparkSession
    kind = "array<float>" if table.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("v") == sizes[0][0])
    picked = rows.select("id", "v").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE).toPandas().sort_values("id")
    # leaves deeper than the sample can fill only scatter rows
    depth = int(max(0, min(DEPTH, np.floor(np.log2(max(1, len(picked) / LEAF_SAMPLE))))))
    probes = probes or leaves_read(depth)
    forest = spark.sparkContext.broadcast(Forest(_matrix(picked["v"]), depth=depth))

    def tally(batches):
        held = np.zeros((TREES, 2**depth), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                for t, leaf in enumerate(forest.value.leaves(_matrix(b.column("v"))).T):
                    held[t] += np.bincount(leaf, minlength=2**depth)
        t, leaf = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(leaf, pa.int32()), pa.array(held[t, leaf])], ["tree", "leaf", "n"])

    counts = np.zeros((TREES, 2**depth), dtype=np.int64)
    for r in rows.select("v").mapInArrow(tally, "tree int, leaf int, n bigint").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        counts[r["tree"], r["leaf"]] = r["n"]
    packing = spark.sparkContext.broadcast(Packing(counts))

    def index(batches):
        group = packing.value.group
        for b in batches:
            if b.num_rows:
                leaf = forest.value.leaves(_matrix(b.column("v")))
                at = pa.array(np.repeat(np.arange(b.num_rows), TREES))
                yield pa.RecordBatch.from_arrays([pa.array(group[np.arange(TREES), leaf].ravel()), pa.array(leaf.ravel()), b.column("id").take(at), b.column("v").take(at)], ["g", "leaf", "id", "v"])

    def ask(batches):
        group = packing.value.group
        for b in batches:
            hits = []
            for v in _matrix(b.column("v")) if b.num_rows else ():
                by: dict[int, list[int]] = {}
                for t, leaf in forest.value.search(v, probes):
                    by.setdefault(int(group[t, leaf]), []).append(leaf)
                hits.append([{"g": g, "leaves": x} for g, x in by.items()])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(hits, pa.list_(pa.struct([("g", pa.int32()), ("leaves", pa.list_(pa.int32()))])))], ["id", "v", "hits"])

    asked = cut(rows.filter("q").select("id", "v").distinct().mapInArrow(ask, f"id bigint, v {kind}, hits array<struct<g int, leaves array<int>>>"))
    met = asked.select(F.explode("hits.g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    # a row a group of leaves that a query meets, TREES * 2**DEPTH at most
    plan = F.broadcast(spark.createDataFrame([(r["g"], int(packing.value.blocks[r["g"]]), -(-r["n"] // QBLOCK)) for r in met], "g int, blocks int, qblocks int"))
    ranged = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("bigint")).cast("int")
    members = rows.select("id", "v").mapInArrow(index, f"g int, leaf int, id bigint, v {kind}").join(plan, "g").select("g", dealt("blocks").alias("block"), ranged("qblocks").alias("qblock"), "leaf", "id", "v")
    queries = asked.select("id", "v", F.explode("hits").alias("x")).select("id", "v", "x.g", "x.leaves").join(plan, "g").select("g", ranged("blocks").alias("block"), dealt("qblocks").alias("qblock"), "leaves", "id", "v")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            left = left.sort_values("leaf")
            x, xi, leaf = _matrix(left["v"]), left["id"].to_numpy(), left["leaf"].to_numpy()
            y, yi = _matrix(right["v"]), right["id"].to_numpy()
            who = np.repeat(np.arange(len(right)), right["leaves"].map(len))
            which = np.concatenate(right["leaves"].to_numpy())
            at = np.argsort(which, kind="stable")
            who, which = who[at], which[at]
            held = 0
            for v in np.unique(which):
                a, b = np.searchsorted(leaf, [v, v + 1])
                q = who[slice(*np.searchsorted(which, [v, v + 1]))]
                if a < b:
                    for j, i, d in _near(x[a:b], xi[a:b], y[q], yi[q], k):
                        got.append((yi[q][j], xi[a:b][i], d))
                        held += len(d)
                        if held > HELD:
                            got = [_best(*map(np.concatenate, zip(*got, strict=True)), k)]
                            held = 0
        q, i, d = _best(*map(np.concatenate, zip(*got, strict=True)), k)
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": d})

    key = ["g", "block", "qblock"]
    found = members.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(rerank, "query_id bigint, vec_id bigint, score double")
    # a candidate turns up in several trees
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
