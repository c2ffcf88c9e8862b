"""The registry, and the log as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import event_log

#: Added before rounding on both sides: sums that are exact halves of the last digit differ in their last bit.
NUDGE = "1.3e-10"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG = """WITH log AS (
  SELECT event_id AS row_id, user_id AS usr, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, event_type AS ctx,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, epoch_us(ts) // 1000 AS t, CAST(hour(ts) AS BIGINT) AS hr,
    CAST(value >= 50 AS BIGINT) AS y, CAST(event_type = 'purchase' AS BIGINT) AS alt, value AS play,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS dur,
    CASE WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN 'train' WHEN CAST(ts AS DATE) < DATE '2024-01-22' THEN 'valid' ELSE 'test' END AS split,
    CAST(event_id * 7919 % 13 AS DOUBLE) AS s1, CAST(event_id * 104729 % 17 AS DOUBLE) AS s2, CAST(event_id * 1299709 % 101 AS DOUBLE) AS s3
  FROM events)
"""


def query(name: str, sql: str | None = None, log: bool = True):
    """Register a query; its SQL continues LOG unless ``log`` is false."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = ((LOG + sql) if log else sql).replace(", 6)", f" + {NUDGE}, 6)")
        return f

    return add


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with three deterministic score columns that hold many ties."""
    log = event_log(spark, sf_dir)
    return log.withColumns({s: F.pmod(F.col("row_id") * m, F.lit(n)).cast("double") for s, m, n in (("s1", 7919, 13), ("s2", 104729, 17), ("s3", 1299709, 101))})


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six digits, as both engines' sums differ in the last bit."""
    out = F.round((F.col(c) if isinstance(c, str) else c) + F.lit(float(NUDGE)), 6)
    return out.alias(name or c) if (name or isinstance(c, str)) else out
