"""Chat formatting with typed content parts and a reversible template.

A turn holds parts of the types text, image, audio and document. A visitor over
the parts (one SQL expression) flattens them into one string with ordered
placeholders, and records for every attachment its type, reference and expanded
token count. The template writes each turn as::

    <s>ROLE[INST]CONTENT[/INST]</s>

Control strings inside texts and roles are escaped by one backslash after their
first character; a control string that already has such backslashes gets one
more, so unescaping restores the input exactly.

Defined cases: a null text or role is empty; a null conv_id is a conversation
of its own; turns are ordered by turn (nulls first), ties by role and text;
repeated rows are repeated turns; an empty table gives an empty result; an
unknown part type is a document. Only conv_id, turn, role, text and parts are
read, so other columns cannot clash. A conversation is one output string, so
its turns meet in one task by nature; escaping runs before that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
CONTROL_TAILS = r"s>|/s>|INST\]|/INST\]|\|part\|>|\|image\|>|\|audio\|>|\|document\|>"
ESCAPE = rf"(<|\[)(\\*)({CONTROL_TAILS})"
UNESCAPE = rf"(<|\[)\\(\\*)({CONTROL_TAILS})"
PART_BREAK = "<|part|>"
#: Tokens that one unit (image tile, audio second, document page) expands to.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART_TYPE = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def text_parts(text: Column) -> Column:
    """A plain text as its only part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PART_TYPE)


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("text", "image", "audio"), part["type"]).otherwise("document")


def flatten(parts: Column) -> Column:
    """The visitor's string: escaped texts and placeholders in order.

    Adjacent texts are kept apart by a break, else a control string could form
    across their border.
    """

    def visit(part: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        kept_apart = F.when((i > 0) & (_kind(part) == "text") & (_kind(before) == "text"), PART_BREAK).otherwise("")
        return F.when(_kind(part) == "text", F.concat(kept_apart, escape(part["text"]))).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))

    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    """Type, reference and expanded tokens of the parts that are no text, in order."""
    per_unit = lambda p: F.when(_kind(p) == "image", UNIT_TOKENS["image"]).when(_kind(p) == "audio", UNIT_TOKENS["audio"]).otherwise(UNIT_TOKENS["document"])
    tokens = lambda p: (F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1)) * per_unit(p)).cast("bigint")
    return F.transform(F.filter(parts, lambda p: _kind(p) != "text"), lambda p: F.struct(_kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss spans (start, length) and attachments.

    ``turns`` has conv_id, turn, role and either ``parts`` or ``text``.
    """
    parts = F.col("parts") if "parts" in turns.columns else text_parts(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", escape(F.col("role")).alias("_r"), F.coalesce(flatten(F.col("parts")), F.lit("")).alias("_c"), F.coalesce(attachments(F.col("parts")), F.array().cast("array<struct<type:string,ref:string,tokens:bigint>>")).alias("_a"))
    rows = rows.withColumn("_piece", F.concat(F.lit("<s>"), "_r", F.lit("[INST]"), "_c", F.lit("[/INST]</s>")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "_c")
    rows = rows.select("conv_id", "role", "_r", "_c", "_a", "_piece", F.row_number().over(order).alias("_k"), F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    span = F.when(F.col("role") == trained_role, F.struct((F.col("_from") + F.length("_r") + 9).alias("start"), F.length("_c").cast("bigint").alias("length")))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_k", "_piece", span.alias("span"), "_a"))).alias("_t"))
    return got.select(
        "conv_id",
        F.array_join(F.transform("_t", lambda t: t["_piece"]), "").alias("formatted"),
        F.filter(F.transform("_t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("_t", lambda t: t["_a"])).alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string as array<struct<role, text>>, unescaped."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")
    role = lambda p: F.substring_index(F.substring(p, 4, 2147483647), "[INST]", 1)
    text = lambda p: F.regexp_replace(F.regexp_replace(p, r"^(?s)<s>.*?\[INST\]", ""), r"\[/INST\]$", "")
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.replace(text(p), F.lit(PART_BREAK), F.lit(""))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    under = F.transform(spans, lambda s: unescape(F.replace(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), F.lit(PART_BREAK), F.lit(""))))
    return F.array_join(under, "")


def digest(chats: DataFrame) -> DataFrame:
    """Figures read back from the formatted strings alone."""
    df = chats.withColumn("_turns", read_back(F.col("formatted"))).withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
