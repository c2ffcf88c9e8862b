"""Tables that cut a lineage, the folder for them, and row numbers over ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; one of its own only for a local master that has none configured."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="tidemark-lineage-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """Run once: a Parquet table in the shared folder, read back.

    Unlike a checkpoint it does not carry the size estimates of the plan behind it, which
    would multiply from round to round of an iteration. The table goes with ``drop``, or when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("cut-"):
                fs, at = _path(df.sparkSession, folder)
                fs.delete(at, True)


class Ranges:
    """Fixed bounds that cut the rows of a frame into parts of an order.

    The bounds are literals in the plan, so a part holds the same rows whenever a lost
    task is run again, without a checkpoint. They come from a sample of at most about
    ``SAMPLE`` order keys, the only rows that reach the driver; what is in the parts is
    then counted over all rows. Few rows are one part.
    """

    SAMPLE, ONE_PART = 8192, 65_536

    def __init__(self, df: DataFrame, order: list[str], parts: int | None = None):
        self.order, self.bounds = order, []
        self.kinds = [df.schema[c].dataType for c in order]
        n = df.count()
        if n > self.ONE_PART:
            parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 4_000_000))
            parts = min(parts, self.SAMPLE)
            keys = df.select(*order).sample(min(1.0, self.SAMPLE / n), seed=1).orderBy(*order).collect()
            cuts = [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []
            self.bounds = [tuple(x) for k, x in enumerate(cuts) if not k or x != cuts[k - 1]]

    @property
    def parts(self) -> int:
        return len(self.bounds) + 1

    def part(self) -> Column:
        """The part of a row, from its order columns."""
        one = lambda b: F.struct(*[F.lit(v).cast(k) for v, k in zip(b, self.kinds, strict=True)])
        return place([one(b) for b in self.bounds], F.struct(*[F.col(c).cast(k) for c, k in zip(self.order, self.kinds, strict=True)]))


def place(bounds: list[Column], value: Column) -> Column:
    """How many of the ascending literal ``bounds`` are not above ``value``; two short searches a row."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    count = lambda some: F.size(F.filter(some, lambda b: b <= value))
    heads = F.array(*bounds[width - 1 :: width]) if len(bounds) >= width else None
    blocks = [bounds[k : k + width - 1] for k in range(0, len(bounds), width)] + [[]]
    first = count(heads)
    if width == 1:
        return first
    short = F.array(*bounds[:1])
    padded = F.array(*[F.array(*x) if x else F.slice(short, 1, 0) for x in blocks])
    return first * width + count(padded[F.least(first, F.lit(len(blocks) - 1))])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the place (from 0) of each row in the order, without a task that sees all rows.

    A row's place is the count of the parts before its own plus its place within it.
    The parts are counted when this is called: one pass over the order columns, three
    where there are many rows.
    """
    ranges = Ranges(df, order)
    within = lambda p: F.row_number().over(Window.partitionBy(p).orderBy(*order)).cast("bigint") - 1
    rows = df.withColumn("_p", ranges.part())
    if ranges.parts == 1:
        return rows.withColumn(name, within("_p")).drop("_p")
    sizes = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part
    starts, total = [], 0
    for p in range(ranges.parts):
        starts.append(total)
        total += sizes.get(p, 0)
    return rows.withColumn(name, F.array(*[F.lit(x).cast("bigint") for x in starts])[F.col("_p")] + within("_p")).drop("_p")


def spread_numbers(df: DataFrame, keys: list[str], by: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, a number from 0 within its keys, and ``n``, the rows of the keys.

    A key's rows are numbered in ``parts`` parts by a hash of ``by`` (which must
    identify a row) and offset, so a key of a third of all rows is no single task. Without
    ``parts`` there are as many as keep one below about a million rows, from one count.
    """
    parts = parts or max(8, -(-df.count() // 1_000_000))
    rows = df.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).withColumn("_by", by)
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_by")) - 1
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sizes.select(*keys, "_part", before.alias("_before"), F.sum("_size").over(Window.partitionBy(*keys)).alias("n"))
    return rows.withColumn("_w", within).join(spans, [*keys, "_part"]).withColumn(name, (F.col("_before") + F.col("_w")).cast("bigint")).drop("_part", "_by", "_w", "_before")

