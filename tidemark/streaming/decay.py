"""Decayed history on a stream of log rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "usr bigint, row_id bigint, day bigint, pos double, total double"
STATE = "day bigint, pos double, total double, day_pos double, day_total double"


def running_decay(log: DataFrame, half_life: float) -> DataFrame:
    """For each row its user's decayed positives and rows of earlier days.

    The state of a user is the last day, both decayed sums before it and the
    day's own sums, which only count from the next day on. Rows of a batch are
    taken in day order; rows of an earlier day than the state's come too late to
    be counted and see the state as it is.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, pos, total, day_pos, day_total = state.get if state.exists else (None, 0.0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["day", "row_id"])
        for d, part in rows.groupby("day", sort=True):
            if day is None:
                day = int(d)
            if d > day:
                fade = 0.5 ** ((d - day) / half_life)
                pos, total = (pos + day_pos) * fade, (total + day_total) * fade
                day, day_pos, day_total = int(d), 0.0, 0.0
            yield pd.DataFrame({"usr": key[0], "row_id": part["row_id"], "day": part["day"], "pos": pos, "total": total})
            if d == day:
                day_pos += float(part["y"].sum())
                day_total += float(len(part))
        state.update((day, pos, total, day_pos, day_total))

    return log.select("usr", "row_id", "day", "y").groupBy("usr").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_rates(log: DataFrame, ts: str = "ts", window: str = "1 day", late: str = "2 days", key: str = "ctx") -> DataFrame:
    """Rows and positives by event-time window and key, with a watermark for late rows."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("pos"))
