"""Row-aligned score files: writer, reader and a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import six_digits
from tidemark.lineage import numbered


HEADER = ("row_id", "user_id", "video_id", "score")


def submission_rows(rows: DataFrame, order: str, user: str, item: str, score: str) -> DataFrame:
    """row_id from 0 in the stable order, ids, and the score as %.6g.

    Numbers come from per-range counts, not from one sorted task.
    """
    named = rows.select(F.col(order).alias("_o"), F.col(user).alias("user_id"), F.col(item).alias("item_id"), F.col(score).alias("_s"))
    return numbered(named, ["_o"], "row_id").select("row_id", "user_id", "item_id", six_digits(F.col("_s")).alias("score"))


def write_submission(rows: DataFrame, path: str) -> None:
    """A CSV in parts by ranges of row ids; the header leads the first, so the parts in turn are one file."""
    lines = rows.select(F.col("row_id").alias("_at"), F.to_csv(F.struct("row_id", "user_id", "item_id", "score")).alias("value"))
    head = rows.sparkSession.createDataFrame([(-1, ",".join(HEADER))], "_at bigint, value string")
    lines.unionByName(head).repartitionByRange("_at").sortWithinPartitions("_at").select("value").write.text(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the parts as strings, the header among them; ``bad`` is set where a line has not four fields."""
    schema = "row_id string, user_id string, item_id string, score string, bad string"
    return spark.read.option("columnNameOfCorruptRecord", "bad").schema(schema).csv(path)


def violations(got: DataFrame, expected: DataFrame, repeats: bool = True) -> DataFrame:
    """Counts of each violation; ``got`` has strings, ``expected`` row_id, user_id, item_id.

    Of rows with one id all but the first by value are duplicates; without ``repeats``
    each is judged by its ids and score instead. Where ``got`` was read from a file (it has
    ``bad``), one header line is due.
    """
    file = "bad" in got.columns
    got = got if file else got.withColumn("bad", F.lit(None).cast("string"))
    named = F.concat_ws(",", "row_id", "user_id", "item_id", "score") == ",".join(HEADER)
    rows = got.filter(~named) if file else got
    nth = F.row_number().over(Window.partitionBy("row_id").orderBy("user_id", "item_id", "score")) if repeats else F.lit(1)
    rows = rows.withColumn("nth", nth)
    g = rows.select(F.expr("try_cast(row_id AS bigint)").alias("gid"), F.col("user_id").alias("gu"), F.col("item_id").alias("gi"), F.col("score").alias("gs"), "bad", "nth")
    e = expected.select(F.col("row_id").alias("eid"), F.col("user_id").cast("string").alias("eu"), F.col("item_id").cast("string").alias("ei"))
    s = F.expr("try_cast(gs AS double)")
    kind = (
        F.when(F.col("bad").isNotNull(), "wrong_fields")
        .when(F.col("eid").isNull(), "unexpected_row")
        .when(F.col("gid").isNull(), "missing_row")
        .when(F.col("nth") > 1, "duplicate_row")
        .when(~F.col("gu").eqNullSafe(F.col("eu")) | ~F.col("gi").eqNullSafe(F.col("ei")), "wrong_ids")
        .when(s.isNull(), "not_numeric")
        .when(F.isnan(s) | (F.abs(s) == float("inf")), "not_finite")
        .otherwise("ok")
    )
    found = g.join(e, F.col("gid") == F.col("eid"), "full").groupBy(kind.alias("violation")).agg(F.count(F.lit(1)).alias("n_rows"))
    if not file:
        return found
    heads = got.filter(named).agg(F.count(F.lit(1)).alias("n"))
    wrong = heads.filter("n <> 1").select(F.when(F.col("n") == 0, "missing_header").otherwise("repeated_header").alias("violation"), F.col("n").alias("n_rows"))
    return found.unionByName(wrong)
