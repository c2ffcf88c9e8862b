"""Interaction logs and dimension tables as normalised DataFrames.

A log has the columns row_id, usr, item, ctx, day (ordinal), t (milliseconds),
hr, y (label), alt (a second label), play, dur and split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_END, VALID_END = "2024-01-15", "2024-01-22"
SPLITS = {"train": ("0001-01-01", "2024-01-14"), "valid": (TRAIN_END, "2024-01-21"), "test": (VALID_END, "9999-12-31")}
#: The log CSV, columns in file order not required as the header is read.
LOG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("user_id", "video_id", "tab", "long_view")] + [T.StructField("date", T.IntegerType()), T.StructField("hourmin", T.IntegerType()), T.StructField("time_ms", T.LongType()), T.StructField("duration_ms", T.DoubleType()), T.StructField("play_time_ms", T.DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_split(df: DataFrame, date: Column, splits: dict[str, tuple[str, str]] = SPLITS) -> DataFrame:
    """Add ``split`` by inclusive date ranges; rows outside all of them have none."""
    out = F.lit(None).cast("string")
    for name, (a, b) in splits.items():
        out = F.when(date.between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(out)
    return df.withColumn("split", out)


def event_log(spark: SparkSession, sf_dir: str, splits: dict[str, tuple[str, str]] = SPLITS) -> DataFrame:
    """The ``events`` table as a log."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    item = F.get_json_object("props", "$.k").cast("bigint")
    log = e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("usr"),
        item.alias("item"),
        F.col("event_type").alias("ctx"),
        F.to_date("ts").alias("date"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("day"),
        F.unix_millis(ts).alias("t"),
        F.hour(ts).cast("bigint").alias("hr"),
        (F.col("value") >= 50).cast("bigint").alias("y"),
        (F.col("event_type") == "purchase").cast("bigint").alias("alt"),
        F.col("value").alias("play"),
        item.cast("double").alias("dur"),
    )
    return with_split(log, F.col("date"), splits).drop("date")


def csv_log(spark: SparkSession, paths: list[str], schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """CSV logs with a header, in the order of ``paths``.

    ``row_id`` orders rows by file and place in the file: the file's rank in the
    high digits, then Spark's increasing id, which follows the read order within
    one file's splits. A label is anything but '0'.
    """
    if len(paths) >= 1 << 13:
        raise ValueError("at most 8,191 files")
    place = F.monotonically_increasing_id()
    checked = F.when(place < 1 << 50, place).otherwise(F.raise_error(F.lit("a file of more than 131,072 splits")).cast("bigint"))
    out = None
    for rank, p in enumerate(paths):
        df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(p)
        df = df.withColumn("row_id", checked + F.lit(rank << 50))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("label", (F.col("long_view") != "0").cast("bigint"))


def dimension(df: DataFrame, key: str, positive: tuple[str, ...] = (), forbidden: tuple[str, ...] = ()) -> DataFrame:
    """A dimension table, after checks of unique keys, positive columns and leaking ones."""
    found = [c for c in forbidden if c in df.columns]
    if found:
        raise ValueError(f"columns that leak the outcome: {found}")
    if df.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    for c in positive:
        if df.filter(~(F.col(c) > 0) | F.col(c).isNull()).limit(1).count():
            raise ValueError(f"{c} holds values that are not positive")
    return df
