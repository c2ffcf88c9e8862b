"""Repair of conversation structure by a persistent audit program (see ``audit_dp``).

1. Native functions find each turn's fault: blank (no word), duplicate (the
   conversation has its role and text earlier) or truncated (the last character
   that is no white space does not end a sentence).
2. Small rows (conversation, turn, digest, code), without texts, are sorted by
   range over the cluster. A task turns each run of one conversation into segments
   of at most ``SEGMENT`` turns and finds for each state at a segment's start the
   cheapest audits by the state at its end; so a conversation that holds a third of
   all turns is worked on by many tasks. The segments of a conversation, a few short strings
   each, are folded in order.
3. Each conversation's audit and its turns meet once more, sorted, and stream
   through the task: nothing but the audit is held.

Order of turns: turn (nulls first), role, SHA-256 of role and text; equal rows
are adjacent. Defined cases: null role and text count as one space, so such a
text is blank and such a role cannot stay; neither can an empty or unknown one
(it is given a role or goes). A null conv_id is a conversation of its own.
Repeated rows are duplicates from the second on. A conversation without turns
has zeros, an empty audit and the hash of an empty string. Texts of any length
are hashed and searched natively. Only conv_id, turn, role and text are read;
an empty table gives an empty result.

By nature one conversation's audit is one value and its SHA-256 one chain, so the
last step reads a conversation in one task, but in a stream.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import audit_dp as dp
from tidemark.llm.common import Scratch

#: Turns of one segment at most.
SEGMENT = 2048
#: Repaired turns of one batch at most.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
INK = r"[^\x20\x09-\x0D]"
ORDER = ["conv_id", "turn", "role", "digest"]


def cleaned(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text; null roles and texts are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """Planted faults by crc32 of ``conv_id:turn``, for tests of a repair."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    rows = cleaned(turns).withColumn("_kind", kind).filter("_kind <> 0")
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_again")).drop("_again")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _facts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role's initial, digest and fault of each turn, the first of its kind not marked; no texts."""
    ink = F.col("text").rlike(INK)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~ink, "b").when(~ended, "t").otherwise("-")
    facts = rows.select("conv_id", "turn", "role", _digest().alias("digest"), fault.alias("fault"))
    # of texts that a conversation holds more than once, where the first stands
    held = facts.filter("fault <> 'b'").groupBy("conv_id", "digest").agg(F.min("turn").alias("_first"), F.count("turn").alias("_with"), F.count(F.lit(1)).alias("_n"))
    held = held.filter("_n > 1").select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), F.when(F.col("_with") == F.col("_n"), F.col("_first")).alias("_first"), F.lit(True).alias("_many"))
    met = facts.join(held, facts["conv_id"].eqNullSafe(held["_c"]) & (facts["digest"] == held["_d"]), "left")
    later = F.col("_many").isNotNull() & (F.col("fault") != "b") & F.col("turn").isNotNull() & (F.col("_first").isNull() | (F.col("turn") > F.col("_first")))
    return met.select("conv_id", "turn", "role", "digest", F.when(later, "d").otherwise(F.col("fault")).alias("fault"))


def _initial(role: str) -> str:
    return role[0] if role.startswith(("s", "u", "a")) else "."


@lru_cache(maxsize=1 << 14)
def _short(codes: str, start: int) -> tuple:
    return tuple(dp.segment(codes, start))


def _table(codes: str, starts: tuple[int, ...]) -> str:
    """Best (cost, audit) by start and end state, as text."""
    out = []
    for s in starts:
        for to, found in enumerate(_short(codes, s) if len(codes) <= 64 else dp.segment(codes, s)):
            if found is not None:
                out.append(f"{s}{to}{found[0]}:{found[1]}")
    return ";".join(out)


def _tables(text: str) -> dict[int, list]:
    out = {s: [None] * 4 for s in dp.STATES}
    for part in text.split(";") if text else []:
        cost, audit = part[2:].split(":")
        out[int(part[0])][int(part[1])] = int(cost), audit
    return out


PARTS = "conv_id bigint, part int, place bigint, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, tables string"


def _parts(facts: DataFrame) -> DataFrame:
    """A row a segment of a conversation."""

    def rows(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        held: list[str] = []  # the codes of the run
        now, begun, seen = None, False, None  # conversation as a tuple, whether another came before it here, last row
        counts, roles = [0, 0, 0, 0], ["", ""]
        ready: list[tuple] = []

        def close():
            nonlocal place
            # a conversation that began here starts with nothing before it; the first of a task, or a later segment, may not
            whole = begun and not place
            starts = (dp.START,) if whole else dp.STATES
            ready.append((now[0], part, place, roles[0], roles[1], *counts, _table("".join(held), starts)))
            place += 1
            held.clear()
            counts[:] = [0, 0, 0, 0]

        def batch():
            cols = list(zip(*ready, strict=True))
            ready.clear()
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "fault")]
            for conv, turn, role, digest, fault in zip(*columns, strict=True):
                if now is None or now[0] != conv:
                    if held:
                        close()
                    begun, now, seen, place = now is not None, (conv,), None, 0
                elif len(held) >= SEGMENT:
                    close()
                if fault in "t-" and seen == (turn, digest):
                    fault = "d"
                seen = turn, digest
                first = _initial(role)
                if not held:
                    roles[:] = [first, first]
                else:
                    counts[3] += roles[1] + first not in ("su", "ua", "au")
                    roles[1] = first
                if fault != "-":
                    counts["bdt".index(fault)] += 1
                held.append(first + ("x" if fault in "bd" else fault))
            if len(ready) >= BATCH_ROWS:
                yield batch()
        if held:
            close()
        if ready:
            yield batch()

    # equal rows stay in one task, as the whole order is the key
    dealt = facts.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(rows, PARTS)


AUDIT = "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _folded(parts: DataFrame) -> DataFrame:
    """A row a conversation."""

    def rows(batches):
        now, fold, last, counts = None, dp.Fold(), None, [0, 0, 0, 0]
        ready: list[tuple] = []

        def batch():
            cols = list(zip(*ready, strict=True))
            ready.clear()
            kinds = [*[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in AUDIT.split(", ")])

        for b in batches:
            names = ("conv_id", "first", "last", "blank", "duplicate", "truncated", "illegal", "tables")
            for conv, first, end, *found, tables in zip(*[b.column(c).to_pylist() for c in names], strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        ready.append((now[0], *counts, *fold.result()))
                    now, fold, last, counts = (conv,), dp.Fold(), None, [0, 0, 0, 0]
                counts = [x + y for x, y in zip(counts, found, strict=True)]
                counts[3] += last is not None and last + first not in ("su", "ua", "au")
                last = end
                fold.add(_tables(tables))
            if len(ready) >= BATCH_ROWS:
                yield batch()
        if now is not None:
            ready.append((now[0], *counts, *fold.result()))
        if ready:
            yield batch()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(rows, AUDIT)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost and audit of each conversation that has turns."""
    return _folded(_parts(_facts(rows)))


REPAIRED = "conv_id bigint, place bigint, turn bigint, edit string, role string, text string"


def _streamed(rows: DataFrame, found: DataFrame, out, schema: str) -> DataFrame:
    """Run ``out`` over (conv_id, turn, role, text) in order, each conversation behind a row with its audit in ``text``."""
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text")
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", "kind", "turn", "role", "text").mapInArrow(out, schema)


def _edits(batches):
    """(conv_id, place, turn, edit, role, text) of every repaired turn, and a row with a null edit before each conversation."""
    audit, at, state, place, conv = "", 0, dp.START, 0, None

    def inserts():
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            at += 1
            state = dp.NEXT[state]
            yield conv, place, None, "I", dp.ROLES[state], ""
            place += 1

    for b in batches:
        for i, kind, turn, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text")], strict=True):
            if kind == 0:
                yield from inserts()
                audit, at, state, place, conv = text, 0, dp.START, 0, i
                yield conv, -1, None, None, "", ""
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            state = dp.NEXT[state] if edit == "R" else dp.KEPT[role[0], state]
            yield conv, place, turn, edit, dp.ROLES[state] if edit == "R" else role, text
            place += 1
    yield from inserts()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations; inserted ones have no turn and an empty text."""

    def out(batches):
        ready, size = [], 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready, strict=True), kinds, strict=True)], [x.split()[0] for x in REPAIRED.split(", ")])
        for row in _edits(batches):
            if row[3] is None:
                continue
            ready.append(row)
            size += len(row[5])
            if len(ready) >= BATCH_ROWS or size > BATCH_BYTES:
                yield pack()
                ready, size = [], 0
        if ready:
            yield pack()

    return _streamed(rows, found, out, REPAIRED)


def hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: the repaired ``role:text``, joined by newlines."""

    def out(batches):
        ids, sums, h = [], [], None
        pack = lambda n: pa.RecordBatch.from_arrays([pa.array(ids[:n], pa.int64()), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])
        for conv, place, _, edit, role, text in _edits(batches):
            if edit is None:
                if h is not None:
                    sums.append(h.hexdigest())
                if len(sums) >= BATCH_ROWS:
                    yield pack(len(sums))
                    ids, sums = [], []
                ids.append(conv)
                h = hashlib.sha256()
                continue
            h.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if h is not None:
            sums.append(h.hexdigest())
        yield pack(len(sums))

    return _streamed(rows, found, out, "conv_id bigint, repaired_sha256 string")


def report(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a conversation of ``turns``: the faults of ``rows``, which are what is left of them, and their repair."""
    scratch = Scratch(turns.sparkSession)
    found = scratch.save(audits(rows))
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    every = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for right in (gaps, found, hashes(rows, found)):
        right = right.withColumnRenamed("conv_id", "_id")
        every = every.join(right, every["conv_id"].eqNullSafe(right["_id"]), "left").drop("_id")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return every.select("conv_id", *[whole(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
