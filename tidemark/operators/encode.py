"""Train-fitted encoders: quantile buckets, vocabularies, one-hot columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bucket_left
from tidemark.lineage import Ranges, cut, numbered


def quantiles(train: DataFrame, cols: dict[str, Column], n: int, interpolate: bool = True) -> dict[str, list[float]]:
    """The n - 1 inner quantiles of each column over its values that are not null; none for a column without values.

    Exact at any size: values are counted (a hot value is one row), the counts are cut
    into ranges of (column, value), and only the ranges that hold a wanted rank are
    looked into. Ranges' sums and at most two values a quantile reach the driver.
    Without interpolation the value at the lower rank is taken.
    """
    names = list(cols)
    cells = train.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), cols[k].cast("double").alias("v")) for i, k in enumerate(names)])).alias("x"))
    counts = cut(cells.select("x.c", "x.v").filter("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    ranges = Ranges(counts, ["c", "v"])
    counts = counts.withColumn("_p", ranges.part())
    sizes = sorted((r["c"], r["_p"], r["n"]) for r in counts.groupBy("c", "_p").agg(F.sum("n").alias("n")).collect())  # a row a column and range
    wanted, spots = [], {}
    for c in range(len(names)):
        mine = [(p, k) for x, p, k in sizes if x == c]
        total = sum(k for _, k in mine)
        for i in range(1, n) if total else ():
            at = i / n * (total - 1)
            spots[c, i] = at
            for rank in {math.floor(at), math.ceil(at)} if interpolate else {math.floor(at)}:
                before = 0
                for p, k in mine:
                    if before <= rank < before + k:
                        wanted.append((c, p, rank, rank - before))
                        break
                    before += k
    if not wanted:
        return {k: [] for k in names}
    asked = train.sparkSession.createDataFrame(wanted, "c int, _p int, rank bigint, within bigint")
    upto = F.sum("n").over(Window.partitionBy("c", "_p").orderBy("v"))
    some = counts.join(F.broadcast(asked.select("c", "_p").distinct()), ["c", "_p"], "left_semi").withColumn("hi", upto)
    found = some.join(F.broadcast(asked), ["c", "_p"]).filter("hi - n <= within AND within < hi")
    value = {(r["c"], r["rank"]): r["v"] for r in found.select("c", "rank", "v").collect()}  # two a quantile at most
    out: dict[str, list[float]] = {k: [] for k in names}
    for (c, _), at in spots.items():
        lo, hi = math.floor(at), math.ceil(at) if interpolate else math.floor(at)
        low, high = value[c, lo], value[c, hi]
        out[names[c]].append(low if lo == hi or low == high else (hi - at) * low + (at - lo) * high)
    return out


def edges(train: DataFrame, col: Column, n: int) -> DataFrame:
    """One row: the n - 1 inner quantile edges, linearly interpolated, duplicates kept; null without values."""
    found = quantiles(train, {"v": col}, n)["v"]
    return train.sparkSession.createDataFrame([(found or None,)], "edges array<double>")


def with_buckets(rows: DataFrame, train: DataFrame, col: str, n: int, name: str = "bucket", where: Column | None = None) -> DataFrame:
    """Bucket by train-fitted edges, the edge value in the lower bucket.

    ``where`` limits fitting and use to rows with a defined value; others get null.
    """
    fitted = edges(train if where is None else train.filter(where), F.col(col), n)
    code = bucket_left(F.col("edges"), F.col(col))
    # one row of n - 1 doubles
    return rows.join(F.broadcast(fitted)).withColumn(name, code if where is None else F.when(where, code)).drop("edges")


def vocabulary(train: DataFrame, col: str, row_id: str = "row_id") -> DataFrame:
    """(value, id): ids from 0 in order of first sight in train; nulls have none.

    Distinct values are numbered after a partial aggregation, by ranges.
    """
    first = train.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.min(row_id).alias("_f"))
    return numbered(first, ["_f"], "id").select("value", "id")


def encoded(rows: DataFrame, train: DataFrame, cols: list[str], row_id: str = "row_id") -> DataFrame:
    """Global ids of each column: first-seen vocabulary, one unknown slot at its end, offsets in column order.

    Nulls, as values that train has not, get the unknown slot. Numbering counts rows when this is called.
    """
    out, offset = rows, F.lit(0).cast("bigint")
    for c in cols:
        v = vocabulary(train, c, row_id)
        size = v.agg(F.count(F.lit(1)).alias(f"_n_{c}"))
        out = out.join(v.withColumnsRenamed({"value": c, "id": f"_i_{c}"}), c, "left").join(F.broadcast(size))
        out = out.withColumn(f"{c}_id", offset + F.coalesce(F.col(f"_i_{c}"), F.col(f"_n_{c}"))).withColumn(f"_o_{c}", offset + F.col(f"_n_{c}") + 1)
        offset = F.col(f"_o_{c}")
    return out.drop(*[f"_{x}_{c}" for c in cols for x in "ino"])


def set_vocabulary(train: DataFrame, cols: list[str], row_id: str = "row_id") -> tuple[DataFrame, dict[str, int]]:
    """(col, value, id) of all columns in one numbering, and each column's id for what train has not.

    Ids run on from column to column: the values of the first by first sight in train, its
    unknown slot, the second's, and so on. One aggregate finds the values of every column. Nulls have no
    id of their own; they count as unknown.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)]))
    first = cut(train.select(row_id, cells.alias("x")).filter("x.value IS NOT NULL").groupBy("x.c", "x.value").agg(F.min(row_id).alias("_f")))
    sizes = {r["c"]: r["n"] for r in first.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
    unknown, end = {}, 0
    for i, c in enumerate(cols):
        end += sizes.get(i, 0) + 1
        unknown[c] = end - 1
    ids = numbered(first, ["c", "_f", "value"], "id")
    return ids.select(F.array(*[F.lit(c) for c in cols])[F.col("c")].alias("col"), "value", (F.col("id") + F.col("c")).alias("id")), unknown


def encoded_set(rows: DataFrame, train: DataFrame, cols: list[str], row_id: str = "row_id") -> DataFrame:
    """``rows`` with ``{col}_id`` for each column, by ``set_vocabulary``."""
    vocab, unknown = set_vocabulary(train, cols, row_id)
    vocab = cut(vocab)
    out = rows
    for c in cols:
        mine = vocab.filter(F.col("col") == c).select(F.col("value").alias(f"_v_{c}"), F.col("id").alias(f"{c}_id"))
        out = out.join(mine, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}").withColumn(f"{c}_id", F.coalesce(f"{c}_id", F.lit(unknown[c]).cast("bigint")))
    return out


def sorted_vocabulary(train: DataFrame, col: str) -> DataFrame:
    """(value, id): ids from 2 in value order; 0 pads, 1 is unknown."""
    return numbered(train.select(F.col(col).alias("value")).distinct(), ["value"], "id").withColumn("id", F.col("id") + 2)


def known_only(rows: DataFrame, train: DataFrame, col: str, name: str) -> DataFrame:
    """The value where train has it, else null."""
    seen = train.select(F.col(col).alias(f"_{col}")).distinct()
    return rows.join(seen, F.col(col) == F.col(f"_{col}"), "left").withColumn(name, F.col(f"_{col}")).drop(f"_{col}")


def one_hot(rows: DataFrame, col: str, values: list) -> DataFrame:
    """A 0/1 column for each observed value; others are all zero."""
    return rows.select("*", *[F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)).alias(f"{col}_{v}") for v in values])


def category_frame(df: DataFrame, categories: list[str], numbers: list[str], missing: str = "UNK") -> DataFrame:
    """Categories as strings without nulls and numbers as single floats, other columns left out."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in categories], *[F.col(c).cast("float").alias(c) for c in numbers])
