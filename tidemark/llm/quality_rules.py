"""Quality rules with host-level verdicts.

Each document is held against the base rules; failures are then aggregated by
host (the ``source`` column), each host's failure rate is shrunk with a beta
prior fitted over all hosts by the method of moments, and hosts whose shrunk
rate is above ``max_host_rate`` take their documents with them.

Defined cases: a null or empty text has no words, so it fails; a null source is
a host of its own; a repeated row counts again and gets its own result row; an
empty table gives an empty result; a null doc_id is carried through. Columns
other than doc_id, text and source are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, cut, keep_where, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
#: Bounds of the fitted prior's weight in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)
#: More hosts than this are joined by a salted shuffle instead of a broadcast.
BROADCAST_HOSTS = 100_000
SALTS = 32


def _repeat_words(df: DataFrame) -> DataFrame:
    """From ``_words`` the words covered by 3-word windows that the text holds twice.

    Whole 64-bit window hashes are compared per text; only texts with a repeated
    hash are sorted, as pairs of hash and place, at any length.
    """
    n = F.size("_tri")
    df = df.withColumn("_tri", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_some", F.size(F.array_distinct("_tri")) < n)
    df = df.withColumn("_pairs", F.when(F.col("_some"), F.sort_array(F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i"))))))
    twice = lambda x, i: F.coalesce(F.get("_pairs", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_pairs", i + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_pairs", twice), lambda x: x["i"])))
    gaps = F.aggregate(F.sequence(F.lit(1), F.size("_at") - 1), F.lit(3).cast("bigint"), lambda acc, i: acc + F.least(F.lit(3).cast("bigint"), F.get("_at", i) - F.get("_at", i - 1)))
    return df.withColumn("n_repeat_words", F.when(F.col("_at").isNull() | (F.size("_at") < 1), F.lit(0).cast("bigint")).when(F.size("_at") == 1, F.lit(3).cast("bigint")).otherwise(gaps))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id and source with the base figures and ``base_failed``, row by row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "source", text.alias("_text")).withColumn("_words", words(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeat_words(df)
    return df.select(
        "doc_id",
        "source",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.size(F.split("_text", r"[#*$%&|<>]", -1)) - 1).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    ).withColumn("base_failed", failed())


def failed(n_words: Column | None = None, n_repeat: Column | None = None) -> Column:
    n_words = F.col("n_words") if n_words is None else n_words
    n_repeat = F.col("n_repeat_words") if n_repeat is None else n_repeat
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT_PERCENT)


def host_verdicts(counts: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and verdict; one row a host.

    The partial aggregation runs before the shuffle, so a host with a third of
    all rows arrives as one row a task. The prior is a one-row aggregate over hosts.
    """
    hosts = counts.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("base_failed").cast("double")).alias("f"))
    mean = hosts.agg(F.sum("n").alias("all_n"), (F.sum("f") / F.sum("n")).alias("m"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("q"))
    spread = F.col("q") - F.col("all_n") * F.col("m") * F.col("m")
    noise = F.col("m") * (1 - F.col("m"))
    room = F.col("all_n") - F.col("n2") / F.col("all_n")
    tau = F.when(room > 0, (spread - (F.col("k") - 1) * noise) / room)
    weight = F.when(tau > 0, F.least(F.greatest(noise / tau - 1, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1]))).otherwise(F.lit(PRIOR_WEIGHT[1]))
    prior = mean.select("m", weight.alias("w"))
    rate = (F.col("f") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))
    return hosts.join(F.broadcast(prior)).select("source", F.col("n").cast("bigint").alias("host_docs"), F.col("f").cast("bigint").alias("host_failures"), rate.alias("host_rate"), (rate > max_host_rate).alias("host_failed"))


def with_verdict(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Join host verdicts to rows that have ``source``.

    Up to BROADCAST_HOSTS hosts are broadcast; beyond, both sides are salted so
    that a hot host is dealt over SALTS tasks.
    """
    hosts = hosts.withColumnRenamed("source", "_host")
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    same = rows["source"].eqNullSafe(hosts["_host"])
    if few:
        return rows.join(F.broadcast(hosts), same, "left").drop("_host")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in ("doc_id", "source") if c in rows.columns]), F.lit(SALTS)))
    hosts = hosts.withColumn("_salt2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.join(hosts, rows["source"].eqNullSafe(hosts["_host"]) & (rows["_salt"] == hosts["_salt2"]), "left").drop("_host", "_salt", "_salt2")


def judge(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row a document with base figures, host figures and ``kept``."""
    counts = cut(base_counts(docs))
    hosts = cut(host_verdicts(counts, max_host_rate))
    return with_verdict(counts, hosts).withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


def keep_documents(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass base rules and host verdict, columns unchanged.

    Figures are computed in place a second time rather than joined back, so that
    no text is shuffled and doc_id need not be unique.
    """
    names = docs.columns
    hosts = cut(host_verdicts(base_counts(docs), max_host_rate))
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    df = _repeat_words(whole.withColumn("_words", words(text)))
    df = keep_where(df, ~failed(F.size("_words").cast("bigint"), F.col("n_repeat_words"))).select("_row", F.col("_row.source").alias("source"), F.col("_row.doc_id").alias("doc_id"))
    kept = with_verdict(df, hosts).filter(~F.coalesce("host_failed", F.lit(False)))
    return kept.select("_row.*")
