"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges of the duration buckets, in seconds.
DURATION_EDGES = (15, 30, 60, 120, 300)
MISSING = "UNK"


def smoothed_rate(pos: Column, total: Column, alpha: float = 0.5) -> Column:
    """(pos + alpha) / (total + 2 alpha)."""
    return (pos + alpha) / (total + 2 * alpha)


def sigmoid(x: Column, limit: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))


def half_life_weight(gap: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), gap / half_life)


def cyclic_hour(hour: Column) -> tuple[Column, Column]:
    angle = hour * (2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def hour_bucket(hhmm: Column) -> Column:
    """Six four-hour buckets of an HHMM integer."""
    return F.floor(F.pmod(F.floor(hhmm / 100), F.lit(24)) / 4).cast("bigint")


def history_bucket(count: Column) -> Column:
    """0, 1, 2, 3 to 5, 6 and more."""
    return F.when(count <= 2, count).when(count <= 5, 3).otherwise(4).cast("bigint")


def duration_bucket(seconds: Column) -> Column:
    out = F.lit(len(DURATION_EDGES))
    for i, edge in reversed(list(enumerate(DURATION_EDGES))):
        out = F.when(seconds < edge, i).otherwise(out)
    return out.cast("bigint")


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "landscape").when(width < height, "portrait").otherwise("square")


def primary_token(text: Column, sep: str) -> Column:
    return F.coalesce(F.nullif(F.get(F.split(text, sep), F.lit(0)), F.lit("")), F.lit(MISSING))


def or_missing(text: Column, missing: str = "__MISSING__") -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(missing))


def date_ordinal(yyyymmdd: Column) -> Column:
    """Days since 1970-01-01 of an integer date."""
    return F.datediff(F.to_date(yyyymmdd.cast("string"), "yyyyMMdd"), F.lit("1970-01-01").cast("date"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def _bound(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def softmax(x: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    shifted = _bound(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y)
    return _bound(shifted, lambda e: _bound(total(e), lambda s: F.transform(e, lambda v: v / s)))


def _product_error(x: Column, y: Column) -> Column:
    """What a rounded product of two doubles lacks, exactly (both are split in halves of 26 bits)."""
    high = lambda v: v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)
    xh, yh = high(x), high(y)
    xl, yl = x - xh, y - yh
    return ((xh * yh - x * y) + xh * yl + xl * yh) + xl * yl


def _tie_down(x: Column) -> Column:
    """``x``, or its first six digits where the seventh is a last 5 that the binary value rounds down from.

    The JVM rounds halves of the shortest decimal up; C rounds the binary value,
    and an exact half to an even digit.
    """
    seven = F.format_string("%.6e", F.abs(x))
    digits = F.regexp_replace(F.substring_index(seven, "e", 1), r"\.", "").cast("double")
    power = F.substring_index(seven, "e", -1).cast("int")
    scale = F.pow(F.lit(10.0), F.abs(power - 6).cast("double"))
    up = F.when(power < 6, (F.abs(x) * scale - digits) + _product_error(F.abs(x), scale)).otherwise((F.abs(x) - digits * scale) - _product_error(digits, scale))
    cut = F.floor(digits / 10)
    tie = (seven.cast("double") == F.abs(x)) & (digits % 10 == 5) & F.abs(power - 6).between(0, 22)
    down = F.concat(cut.cast("string"), F.lit("e"), (power - 5).cast("string")).cast("double") * F.signum(x)
    return F.when(tie & ((up < 0) | ((up == 0) & (cut % 2 == 0))), down).otherwise(x)


def six_digits(x: Column) -> Column:
    """C's %.6g: no trailing zeros, with or without an exponent; nan, inf and -inf."""
    x = x.cast("double")
    s = F.regexp_replace(F.format_string("%.6g", _tie_down(x)), r"(\.\d*?)0+(e|$)", "$1$2")
    s = F.regexp_replace(s, r"\.(e|$)", "$1")
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(s)


def bucket_left(edges: Column, x: Column) -> Column:
    """Number of edges below x."""
    return F.size(F.filter(edges, lambda e: e < x)).cast("bigint")


def bucket_right(edges: Column, x: Column) -> Column:
    """Number of edges at or below x."""
    return F.size(F.filter(edges, lambda e: e <= x)).cast("bigint")


def watch_fraction(play: Column, duration: Column) -> Column:
    """play / duration clipped to [0, 1]; null without a positive duration."""
    return F.when(duration > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), play / duration)))


def half_life_label(half_life: float) -> str:
    """A half-life in a feature's name: 5 rather than 5.0."""
    return f"{half_life:g}"


def age_days(on: Column, since: Column) -> Column:
    """Whole days from one date to a later one; an age below 0 is an error, null dates give null."""
    age = F.datediff(on, since).cast("bigint")
    return F.when(age < 0, F.raise_error(F.lit("a negative age")).cast("bigint")).otherwise(age)
