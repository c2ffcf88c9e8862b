"""Removal of repeated multi-line chunks and passages with content-defined boundaries.

A document's lines are hashed; a rolling hash (xor of rotated line hashes, over
WINDOW lines) ends a chunk wherever it is 0 modulo DIVISOR, so an inserted line
moves no boundary beyond it. Chunks of at least MIN_LINES lines that occur more
than once over all documents are compared byte by byte, and all but the first
occurrence (least doc_id, then text hash and place) are removed.

With ``min_words``, each maximal run of equal lines of so many words that an
earlier place already has goes as well, whole, wherever chunk borders fall. From
each line with a word the shortest run of ``min_words`` words that starts there,
and the shortest that ends there, are compared; the repeated ones cover just
those runs, as a run equals an earlier one where all of these inside it do.
Blank lines do not count in the comparison. A run that overlaps its own first
occurrence stays.

Counting works on hashes, with partial aggregation before the shuffle; only
texts of repeated hashes are moved, and first occurrences are found by grouping
on the bytes. The occurrences of a chunk meet its first one in parts of about
PART_ROWS, so a chunk of a third of all documents spans many tasks. Hash tables
and removal lists are broadcast up to BROADCAST_ROWS rows (lists also up to
BROADCAST_RUNS line intervals) and shuffled beyond.

Defined cases: a null text stays null; an empty text and blank chunks are never
removed; a null doc_id sorts last; rows that repeat doc_id and text are one
document and get the same result; an empty table gives an empty result. Input
columns keep their names and values but for text and, if present, n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, cut, fenced, keep_where, words

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
#: Words from which the queries take a repeated run of lines for a passage.
PASSAGE_WORDS = 50
BROADCAST_ROWS = 250_000
BROADCAST_RUNS = 1_000_000
#: Occurrences of a chunk that one task compares, about.
PART_ROWS = 1024


def _rotated(x: Column, k: int) -> Column:
    return x if not k else F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k))


def with_chunks(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<struct<idx, a, n_lines, text>>, a the first line; null for a null text."""
    df = df.withColumn("_lines", F.split(F.col(text), "\n", -1)).withColumn("_h", F.transform("_lines", lambda x: F.xxhash64(x)))

    def ends(i: Column) -> Column:
        rolled = F.get("_h", i)
        for k in range(1, WINDOW):
            rolled = rolled.bitwiseXOR(_rotated(F.coalesce(F.get("_h", i - k), F.lit(0).cast("bigint")), k))
        return (i == F.size("_lines") - 1) | (F.pmod(F.xxhash64(rolled), F.lit(DIVISOR)) == 0)

    df = df.withColumn("_ends", F.when(F.col("_lines").isNotNull(), F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), ends)))

    def chunk(e: Column, j: Column) -> Column:
        start = F.coalesce(F.get("_ends", j - 1) + 1, F.lit(0))
        return F.struct(j.alias("idx"), start.alias("a"), (e - start + 1).alias("n_lines"), F.array_join(F.slice("_lines", start + 1, e - start + 1), "\n").alias("text"))

    return df.withColumn(out, F.transform("_ends", chunk)).drop("_lines", "_h", "_ends")


def with_passages(df: DataFrame, text: str, out: str, min_words: int) -> DataFrame:
    """Add ``out``: array<struct<a, b, text>>, the shortest runs of ``min_words`` words from and to each line with a word."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.size(words(x)).alias("w")))
    df = df.withColumn("_l", F.filter(lines, lambda v: v["w"] > 0))
    df = df.select("*", F.col("_l.i").alias("_i"), F.col("_l.x").alias("_x"), F.col("_l.w").alias("_w"), F.reverse("_l.w").alias("_r"))

    def reach(sizes: str, at: Column) -> Column:
        """Lines from ``at`` on until there are words enough, or 0; each has a word at least."""
        acc = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))
        more = lambda s, w: F.when(s["w"] < min_words, F.struct((s["n"] + 1).alias("n"), (s["w"] + w).alias("w"))).otherwise(s)
        return F.aggregate(F.slice(F.col(sizes), at + 1, F.lit(min_words)), acc, more, lambda s: F.when(s["w"] < min_words, F.lit(0)).otherwise(s["n"]))

    n = F.size("_x")
    code = lambda first, many: F.when(many > 0, F.shiftleft(first.cast("bigint"), 32) + many)
    ahead = F.transform("_w", lambda _, k: code(k, reach("_w", k)))
    back = F.transform("_r", lambda _, k: _let(reach("_r", k), lambda m: code(n - k - m, m)))
    df = df.withColumn("_p", F.filter(F.array_distinct(F.concat(ahead, back)), lambda c: c.isNotNull()))

    def passage(c: Column) -> Column:
        first, many = F.shiftright(c, 32).cast("int"), c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.struct(F.get("_i", first).alias("a"), F.get("_i", first + many - 1).alias("b"), F.array_join(F.slice("_x", first + 1, many), "\n").alias("text"))

    return df.withColumn(out, F.transform("_p", passage)).drop("_l", "_i", "_x", "_w", "_r", "_p")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _occurrences(docs: DataFrame, min_words: int | None) -> DataFrame:
    """A row a chunk or passage that may go: document key, first and last line, hash, length and text."""
    rows = with_chunks(docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").alias("_t")), "_t", "_c")
    some = F.filter("_c", lambda c: (c["n_lines"] >= MIN_LINES) & c["text"].rlike(r"[^\x20\x09-\x0D]"))
    some = F.transform(some, lambda c: F.struct(c["a"].alias("a"), (c["a"] + c["n_lines"] - 1).alias("b"), c["text"].alias("text")))
    if min_words:
        rows = with_passages(rows, "_t", "_q", min_words)
        some = F.concat(some, "_q")
    rows = fenced(rows).select("doc_id", "th", "_fence", F.explode(some).alias("c")).filter("_fence >= 0")
    return rows.select("doc_id", "th", F.col("c.a").alias("a"), F.col("c.b").alias("b"), F.xxhash64("c.text").alias("ch"), F.octet_length("c.text").alias("len"), F.col("c.text").alias("chunk"))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "a", "b")


def _part() -> Column:
    """Which part of its chunk's occurrences a row belongs to."""
    return F.pmod(F.xxhash64("doc_id", "th", "a"), F.col("parts"))


def _each_part(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))


def removals(docs: DataFrame, scratch: Scratch, min_words: int | None = None) -> DataFrame:
    """(doc_id, th, gone): the line intervals that each document loses, none of which touch."""
    found = _occurrences(docs, min_words)
    twice = found.groupBy("ch", "len").agg(F.min(_order()).alias("lo"), F.max(_order()).alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    twice = scratch.save(twice.select("ch", "len", F.ceil(F.col("n") / PART_ROWS).cast("bigint").alias("parts")))
    if twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = found.join(F.broadcast(twice), ["ch", "len"])
    else:
        hot = twice.filter("parts > 1")  # at most a row for each PART_ROWS occurrences
        few = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        spread = found.join(F.broadcast(hot) if few else hot, ["ch", "len"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
        texts = spread.withColumn("part", _part()).join(_each_part(twice).drop("parts"), ["ch", "len", "part"]).drop("part")
    texts = scratch.save(texts.select("doc_id", "th", "a", "b", "ch", "len", "chunk", "parts"))
    first = texts.groupBy("ch", "len", "chunk").agg(F.min(_order()).alias("first"), F.max("parts").alias("parts"))
    got = texts.withColumn("part", _part()).drop("parts").join(_each_part(first).drop("parts"), ["ch", "len", "chunk", "part"])
    apart = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    gone = got.filter(apart | (F.col("first.b") < F.col("a"))).select("doc_id", "th", "a", "b")
    # a document's intervals are merged where they meet
    w = Window.partitionBy("doc_id", "th").orderBy("a", "b")
    gone = gone.withColumn("_new", F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)))
    gone = gone.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gone = gone.groupBy("doc_id", "th", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return gone.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("gone"))


def _with_gone(docs: DataFrame, min_words: int | None) -> DataFrame:
    """``_row`` (the input row), ``_t`` and ``_gone`` for each document."""
    scratch = Scratch(docs.sparkSession)
    gone = cut(removals(docs, scratch, min_words)).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    scratch.drop()
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("runs")).first()
    few = size["n"] <= BROADCAST_ROWS and size["runs"] <= BROADCAST_RUNS
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_a"), F.xxhash64(docs["text"]).alias("_b"))
    rows = rows.join(F.broadcast(gone) if few else gone, F.col("_a").eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_th")), "left")
    return rows.select("_row", F.col("gone").alias("_gone"), F.col("_row.text").alias("_t"))


def _kept_text() -> Column:
    lines = F.split(F.col("_t"), "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.exists("_gone", lambda g: (g["a"] <= i) & (i <= g["b"])))
    return F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(F.array_join(left, "\n"))


def report(docs: DataFrame, min_words: int | None = None) -> DataFrame:
    """A row a document: chunks, chunks that go whole, removed lines, and the text that stays."""
    lost = F.filter("_chunks", lambda c: F.exists("_gone", lambda g: (g["a"] <= c["a"]) & (c["a"] + c["n_lines"] - 1 <= g["b"])))
    return with_chunks(_with_gone(docs, min_words), "_t", "_chunks").select(
        F.col("_row.doc_id").alias("doc_id"),
        F.coalesce(F.size("_chunks"), F.lit(0)).cast("bigint").alias("n_chunks"),
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size(lost)).cast("bigint").alias("n_removed"),
        F.coalesce(F.aggregate("_gone", F.lit(0), lambda s, g: s + g["b"] - g["a"] + 1), F.lit(0)).cast("bigint").alias("n_removed_lines"),
        _kept_text().alias("text"),
    )


def dedup_documents(docs: DataFrame, min_words: int | None = None, whole: str | None = None) -> DataFrame:
    """The documents with their repeated chunks (and passages) removed; those left without a word go.

    ``whole`` names a further column for the text as it was.
    """
    rows = _with_gone(docs, min_words).withColumn("_new", _kept_text())
    rows = keep_where(rows, F.col("_gone").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    put = {"text": F.col("_new")} | ({"n_chars": F.when(F.col("_gone").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[put.get(c, F.col("_row")[c]).alias(c) for c in docs.columns], *([F.col("_t").alias(whole)] if whole else []))
