"""Feature names to plans.

A feature set is a list of names such as ``decay_rate_2.5`` (a user's decayed,
smoothed rate with that half-life in days), ``decay_pos_5``, ``prior_rate``,
``activity``, ``ctx_rate_3`` (of user and context), ``last1``, ``gap_ms`` or a
column of the log. Unknown names are errors when the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bucket_left, smoothed_rate
from tidemark.operators import encode
from tidemark.lineage import cut
from tidemark.operators.history import day_history, momentum

KEYS = {"decay": ["usr"], "ctx": ["usr", "ctx"], "item": ["usr", "item"]}
MOMENTUM = ("last1", "lastk_sum", "lastk_cnt", "gap_ms")


def parse(name: str) -> tuple[str, str, float | None]:
    """(family, measure, half-life)."""
    parts = name.split("_")
    if name in MOMENTUM:
        return "momentum", name, None
    if name in ("activity", "prior_pos", "prior_rate"):
        return "prior", name, None
    if len(parts) == 3 and parts[0] in KEYS and parts[1] in ("pos", "total", "rate"):
        try:
            half_life = float(parts[2])
        except ValueError:
            half_life = 0.0
        if half_life > 0:
            return parts[0], parts[1], half_life
    raise ValueError(f"no such feature: {name}")


def build(log: DataFrame, names: list[str], alpha: float = 0.5) -> DataFrame:
    """``log`` with the named features; families of one key share one aggregation."""
    wanted = {n: parse(n) for n in names if n not in log.columns}
    out = log
    for family, keys in KEYS.items():
        mine = {n: p for n, p in wanted.items() if p[0] == family or family == "decay" and p[0] == "prior"}
        if not mine:
            continue
        spans = sorted({h for _, _, h in mine.values() if h})
        at = lambda m, h: f"_{family}_{m}_{spans.index(h)}"  # noqa: B023, E731
        decayed = {at(m, h): (F.col("y") if m == "pos" else F.lit(1), h) for h in spans for m in ("pos", "total")}
        sums = {"_pos": F.col("y"), "_n": F.lit(1)} if any(p[0] == "prior" for p in mine.values()) else {}
        out = day_history(out, keys, sums, decayed)
        for n, (fam, m, h) in mine.items():
            if fam == "prior":
                value = {"activity": F.col("_n") if sums else None, "prior_pos": F.col("_pos") if sums else None, "prior_rate": smoothed_rate(F.col("_pos"), F.col("_n"), alpha) if sums else None}[n]
            elif m == "rate":
                value = smoothed_rate(F.col(at("pos", h)), F.col(at("total", h)), alpha)
            else:
                value = F.col(at(m, h))
            out = out.withColumn(n, value)
        out = out.drop(*decayed, *sums)
    if any(p[0] == "momentum" for p in wanted.values()):
        out = momentum(out)
    return out.select("row_id", *[F.col(f"`{n}`") for n in names])


def encoded(log: DataFrame, categories: list[str], numbers: list[str], n_buckets: int = 10, alpha: float = 0.5, split: str = "split") -> DataFrame:
    """row_id, split and the global id of each named feature: buckets, vocabularies and offsets of a set in one plan.

    Numbers become buckets by their train quantiles (edges rounded to six digits, so that no engine's last
    bit decides), all found at once; a null, or a gap without a row before it, is ``UNK``. Buckets and
    categories then share one numbering, by first sight in train, with an unknown slot after each feature.
    """
    names = [*categories, *numbers]
    rows = cut(build(log, [split, *names], alpha))
    train = rows.filter(F.col(split) == "train")
    value = lambda n: F.when(F.col(n) >= 0, F.col(n)) if n == "gap_ms" else F.col(n)
    found = encode.quantiles(train, {n: value(n) for n in numbers}, n_buckets)
    code = lambda n: F.coalesce(bucket_left(F.array(*[F.lit(round(e, 6)) for e in found[n]]).cast("array<double>"), value(n).cast("double")).cast("string"), F.lit("UNK"))
    known = lambda n: F.when(value(n).isNotNull(), code(n)).otherwise("UNK")
    coded = rows.select("row_id", split, *categories, *[known(n).alias(n) for n in numbers])
    got = encode.encoded_set(coded, coded.filter(F.col(split) == "train"), names)
    return got.select("row_id", split, *[f"{n}_id" for n in names])
