"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"
#: Spark's setting for deleting an action's shuffle files as it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of one Arrow batch, and its value here: a Python worker holds a batch and what it makes of it.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one is made only for a local master that has none configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Actions within delete their shuffle files as they end, not when the driver collects its garbage, and keep Arrow batches small."""
    before = {k: spark.conf.get(k, d) for k, d in ((RELEASE, "false"), (BATCH, "64m"))}
    spark.conf.set(RELEASE, "true")
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def gone_on_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends, if nothing deletes it before."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def cut(df: DataFrame) -> DataFrame:
    """Run once and cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with releasing(df.sparkSession):
        return df.select("*").checkpoint()  # select: the setting holds for frames made under it


class Scratch:
    """Parquet tables in the shared folder that live as long as one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/scratch-{uuid.uuid4().hex}"
        with releasing(self.spark):
            df.select("*").write.parquet(path)
        self.paths.append(path)
        gone_on_exit(self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete some saved tables, or all."""
        jvm = self.spark.sparkContext._jvm
        gone = {x.inputFiles()[0].rsplit("/", 2)[-2] for x in tables if x.inputFiles()}
        for p in [p for p in self.paths if not tables or p.rsplit("/", 1)[-1] in gone]:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            self.paths.remove(p)


def unit(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) from a keyed hash of the columns."""
    return F.pmod(F.shiftright(F.xxhash64(F.lit(seed), *cols), 11), F.lit(1 << 53)) / F.lit(float(1 << 53))


def fenced(df: DataFrame) -> DataFrame:
    """``df`` with a column ``_fence`` that is not deterministic.

    While it is needed above, no filter moves below this point. A filter on a
    costly array expression would otherwise be rewritten on its inputs, and what
    was computed once a row would be computed for each element of an array.
    """
    return df.withColumn("_fence", F.monotonically_increasing_id())


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    return fenced(df).filter(condition & (F.col("_fence") >= 0)).drop("_fence")
