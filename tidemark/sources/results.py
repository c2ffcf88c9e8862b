"""Result tables of experiments: append, resume and content hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_results(results: DataFrame, path: str) -> None:
    """Append result rows as JSON lines."""
    results.write.mode("append").json(path)


def todo(configs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The configurations without a result yet."""
    return configs.join(done.select(*keys).distinct(), keys, "left_anti")


def content_hash(df: DataFrame) -> DataFrame:
    """An order-insensitive hash of a table's rows, and their number."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum_hash"))


def identity(sources: list[DataFrame], params: dict) -> str:
    """A name for what is built from these parameters and the rows of these sources."""
    hashes = [[c.name, c.dataType.simpleString()] for s in sources for c in s.schema] + [[str(v) for v in content_hash(s).first()] for s in sources]
    return hashlib.sha256(json.dumps([params, hashes], sort_keys=True, default=str).encode()).hexdigest()[:20]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def freeze(scores: DataFrame, path: str) -> None:
    """Store scores as Parquet beside their hash; what is there already is never replaced."""
    scores.write.parquet(f"{path}/rows")
    content_hash(scores.sparkSession.read.parquet(f"{path}/rows")).write.json(f"{path}/hash")


def load_frozen(spark: SparkSession, path: str) -> DataFrame:
    """The stored scores; an error if their rows are not those that were stored."""
    rows = spark.read.parquet(f"{path}/rows")
    want, got = spark.read.schema("n_rows bigint, xor_hash bigint, sum_hash bigint").json(f"{path}/hash").first(), content_hash(rows).first()
    if want is None or tuple(want) != tuple(got):
        raise ValueError(f"{path} does not hold what was stored: {got} instead of {want}")
    return rows


def config_cache(spark: SparkSession, build, root: str, sources: list[DataFrame] | None = None, **params) -> DataFrame:
    """Build once per parameter set and content of the sources: a Parquet table whose path holds their hash."""
    path = f"{root}/{identity(sources or [], params)}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build(**params).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
