"""Near-duplicate groups by a grouped prefix join on word shingles.

A document's set is its distinct 5-word shingles. Two sets with a Jaccard
similarity of at least 0.75 must share one of the first ``n - ceil(0.75 n) + 1``
shingles in any fixed order (the prefix). The order here puts rare shingles
first, by a count sketch of fixed size over all documents. Then

1. documents with the same set collapse into a class, classes with the same
   prefix and size into a group; only groups are dealt out by prefix shingle;
2. the postings are sorted by shingle and place over the cluster, so a hot
   shingle spans many tasks. Each group is first compared with its neighbour and
   with the head of its piece of the list, each class of a group with the next
   one of the group; links among them are joined into components;
3. groups of different components (or of several) that meet in a list and pass
   the size and position filters are expanded to their member classes, filtered
   by parity bitmaps of the sets' own scale and verified on the texts. So are the
   classes of different components within one group.
4. A list of more than HOT groups is not paired as a whole. Sets whose first
   common shingle is that list's must share a second one in prefixes longer by
   one, so its groups are dealt out again by pairs of shingles; a group of more
   than HOT classes is dealt out by its shingles behind the prefix in the
   same way. Keys whose rows are all of one component are left out, and keys
   that still have more than BLOCK rows are paired block by block.

Pairs within a component are never emitted, so a group of near copies does not
cost the square of its size, and no link between different components is lost.

Shingles are compared by 64-bit hashes. Defined cases: a text without words is
linked with nothing; with fewer than five words the whole sequence is the one
shingle; a null doc_id keeps its row (its component is the least doc_id that is
not null, if any); repeated rows are one class and each keeps its row; an empty
table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, cut, releasing
from tidemark.llm.components import components
from tidemark.llm.shingles import WIDTH, mixed, sets, text_batches

#: The count sketch has this many counters, whatever the input.
SKETCH_BITS = 20
#: Counters in one row of the sketch's tables.
SKETCH_ROW = 1 << 14
#: Longer lists are dealt out again by a second shingle before they are paired.
HOT = 128
#: Groups of one block of a list that is hot still; every two blocks meet in a key of their own.
BLOCK = 512
#: More texts than this are fetched by a shuffle instead of a broadcast of their keys.
BROADCAST_KEYS = 250_000


def _sketch(docs: DataFrame) -> np.ndarray:
    """Documents per bucket of shingle hashes: the one thing that reaches the driver, 8 MB."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for _, texts in text_batches(batches):
            held: list[np.ndarray] = []
            for s in sets(texts):
                held.append((s >> np.uint64(64 - SKETCH_BITS)).view(np.int64))
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
        table = total.reshape(-1, SKETCH_ROW)
        some = np.flatnonzero(table.any(axis=1))
        narrow = np.uint16 if total.max(initial=0) < 1 << 16 else np.int64
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([table[k].astype(narrow).tobytes() for k in some.tolist()], pa.binary())], ["b", "c"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for x in batches:
            for b, c in zip(x.column("b").to_pylist(), x.column("c").to_pylist(), strict=True):
                total.setdefault(b, np.zeros(SKETCH_ROW, dtype=np.int64))
                total[b] += np.frombuffer(c, np.uint16 if len(c) == 2 * SKETCH_ROW else np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["b", "c"])

    with releasing(docs.sparkSession):
        got = docs.select("text").mapInArrow(count, "b int, c binary").repartition("b").mapInArrow(add, "b int, c binary").collect()
    total = np.zeros((-(-(1 << SKETCH_BITS) // SKETCH_ROW), SKETCH_ROW), dtype=np.int64)
    for r in got:
        total[r["b"]] = np.frombuffer(r["c"], np.int64)
    return total.ravel()


def _levels(total: np.ndarray) -> np.ndarray:
    """Six bits a bucket: how far its count stands above the mean, on a log scale."""
    mean = max(total.mean(), 1e-9)
    z = np.maximum(0.0, (total - mean) / np.sqrt(mean))
    return np.minimum(63, np.floor(4 * np.log2(1 + z))).astype(np.uint8)


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def parity(s: np.ndarray) -> bytes:
    """Parities of a set's hashes over at least twice as many places as it has members."""
    size = max(256, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).view(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference; the wider bitmap is folded to the other's width."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _order(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set in the fixed order, rare shingles first."""
    return np.sort((level[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(58)) | (s & np.uint64((1 << 58) - 1)))


def _described(docs: DataFrame, shared) -> DataFrame:
    """A row a document: set size, class, group, prefix (and the shingle after it) and bitmap."""

    def rows(batches):
        for b, texts in text_batches(batches):
            n, cid, gid, prefix, bits = [], [], [], [], []
            for s in sets(texts):
                k = len(s)
                n.append(k)
                cid.append(xxhash.xxh3_128_digest(s.tobytes()) if k else None)
                p = _order(s, shared.value)[: prefix_length(k) + 1].tobytes() if k else b""
                gid.append(xxhash.xxh3_64_intdigest(p, seed=k) - 2**63 if k else None)
                prefix.append(p)
                bits.append(parity(s) if k else b"")
            cols = [b.column("doc_id"), b.column("th"), b.column("len"), pa.array(n, pa.int32()), pa.array(cid, pa.binary()), pa.array(gid, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "len", "n", "cid", "g", "prefix", "bits"])

    source = docs.select("doc_id", F.xxhash64("text").alias("th"), F.octet_length("text").alias("len"), "text")
    return source.mapInArrow(rows, "doc_id bigint, th bigint, len int, n int, cid binary, g bigint, prefix binary, bits binary")


def _groups(rows: DataFrame) -> DataFrame:
    """A row a group with its prefix, the widest thing that a group has."""
    return rows.filter("n > 0").groupBy("g", "n").agg(F.first("prefix").alias("prefix"))


def _postings(groups: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            n = b.column("n").to_numpy()
            size = np.array([prefix_length(k) for k in n.tolist()], dtype=np.int64)
            prefix = [p[: 8 * k] for p, k in zip(b.column("prefix").to_pylist(), size.tolist(), strict=True)]
            g = b.column("g").to_numpy()
            at = 0
            while at < len(size):
                end = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 500_000)) + at)
                part = size[at:end]
                pos = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                token = np.frombuffer(b"".join(prefix[at:end]), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(g[at:end], part)), pa.array(np.repeat(n[at:end], part)), pa.array(pos.astype(np.int32))], ["token", "g", "n", "pos"])
                at = end

    return groups.select("g", "n", "prefix").mapInArrow(rows, "token bigint, g bigint, n int, pos int")


def _lists(postings: DataFrame) -> DataFrame:
    """Postings of shingles that more than one group has, each with its neighbour and head in its piece of the list.

    Sorted by range, so the list of a hot shingle is dealt to many tasks. A
    task's first and last rows stay, as their lists may go on elsewhere.
    """
    names = ["token", "g", "n", "pos"]

    def rows(batches):
        held = None  # the last row, with its neighbour and head
        start = True
        for b in batches:
            now = [b.column(c).to_numpy() for c in names]
            if held is not None:
                now = [np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held[0], now, strict=True)]
            m = len(now[0])
            if not m:
                continue
            same = np.concatenate([[False], now[0][1:] == now[0][:-1]])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(m)))
            prev = [np.concatenate([x[:1], x[:-1]]) for x in now[1:]]
            first = [x[head] for x in now[1:]]
            if held is not None and held[1] is not None:
                run = int(np.argmin(same[1:])) + 1 if not same[1:].all() else m
                for x, v in zip(first, held[2], strict=True):
                    x[:run] = v
                for x, v in zip(prev, held[1], strict=True):
                    x[0] = v
                same[0] = True
            keep = same.copy()
            keep[:-1] |= same[1:]
            if start:
                keep[0], start = True, False
            last = m - 1
            held = [x[last] for x in now], ([x[last] for x in prev] if same[last] else None), [x[last] for x in first]
            keep[last] = False  # comes with the next batch or at the end
            at = np.flatnonzero(keep)
            yield from out(at, now, prev, first, same)
        if held is not None:
            one = lambda row: [np.array([x]) for x in row]
            yield from out(np.array([0]), one(held[0]), one(held[1] or held[0][1:]), one(held[2]), np.array([held[1] is not None]))

    def out(at, now, prev, first, same):
        none = ~same[at]
        cols = [pa.array(x[at]) for x in now] + [pa.array(x[at], mask=none) for x in [*prev, *first]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds, strict=True)], [*names, "p_g", "p_n", "p_pos", "h_g", "h_n", "h_pos"])

    dealt = postings.repartitionByRange("token", "pos", "n", "g").sortWithinPartitions("token", "pos", "n", "g")
    return dealt.mapInArrow(rows, "token bigint, g bigint, n int, pos int, p_g bigint, p_n int, p_pos int, h_g bigint, h_n int, h_pos int")


def _next_in_group(classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes that follow each other in a group; a group may span tasks, whose borders are left out."""

    def rows(batches):
        last = None
        for b in batches:
            u, v = [], []
            for g, c in zip(b.column("g").to_pylist(), b.column("cid").to_pylist(), strict=True):
                if last and last[0] == g:
                    u.append(last[1])
                    v.append(c)
                last = g, c
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return classes.select("g", "cid").repartitionByRange("g", "cid").sortWithinPartitions("g", "cid").mapInArrow(rows, "u binary, v binary")


def _may(a: str, b: str):
    """Size and position filter for two postings of one shingle."""
    need = (3 * (F.col(f"{a}n") + F.col(f"{b}n")) + 6) / 7
    return (F.least(f"{a}n", f"{b}n") * 4 >= F.greatest(f"{a}n", f"{b}n") * 3) & (F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos")) >= F.floor(need))


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes whose bitmaps leave room for the similarity."""

    def rows(batches):
        for b in batches:
            a, c = b.column("a_bits").to_pylist(), b.column("b_bits").to_pylist()
            room = (b.column("a_n").to_numpy().astype(np.int64) + b.column("b_n").to_numpy()).tolist()
            ok = pa.array([4 * min(x, y) >= 3 * max(x, y) and 7 * apart(p, q) <= r for p, q, r, x, y in zip(a, c, room, b.column("a_n").to_pylist(), b.column("b_n").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(ok)

    of = lambda x, side: classes.select(F.col("cid").alias(x), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits"))
    both = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v")
    return both.select("u", "v", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(rows, "u binary, v binary")


def _by_second(hot: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings (key, g, n, pos, label) of hot lists (token, g, label) by the listed shingle and each later one of the longer prefix."""

    def rows(batches):
        for b in batches:
            keys, size, places = [], [], []
            for token, p in zip(b.column("token").to_pylist(), b.column("prefix").to_pylist(), strict=True):
                t = np.frombuffer(p, np.int64)
                at = int(np.searchsorted(t.view(np.uint64), np.int64(token).view(np.uint64)))
                keys.append(mixed(t[at + 1 :].view(np.uint64) + mixed(np.array([token], dtype=np.int64).view(np.uint64))))
                size.append(len(t) - at - 1)
                places.append(at)
            of = np.repeat(np.arange(len(size)), size)
            for a in range(0, len(of), 500_000):
                part = of[a : a + 500_000]
                key = np.concatenate(keys)[a : a + 500_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("g").take(pa.array(part)), b.column("n").take(pa.array(part)), pa.array(np.array(places, dtype=np.int32)[part]), b.column("label").take(pa.array(part))], ["token", "g", "n", "pos", "label"])

    return hot.join(groups.select("g", "n", "prefix"), "g").select("token", "g", "n", "prefix", "label").mapInArrow(rows, "token bigint, g bigint, n int, pos int, label binary")


def _by_tail(members: DataFrame, docs: DataFrame, shared) -> DataFrame:
    """(key, cid, label) of classes of one group by each shingle of the tail that two similar ones must share."""
    texts = docs.select(F.xxhash64("text").alias("th"), F.octet_length("text").alias("len"), "text").filter("text IS NOT NULL")

    def rows(batches):
        for b, texts in text_batches(batches):
            for k, s in enumerate(sets(texts)):
                p = prefix_length(len(s))
                t = _order(s, shared.value)[p + 1 : 2 * p + 2]
                key = mixed(t + mixed(np.array([b.column("g")[k].as_py()], dtype=np.int64).view(np.uint64))).view(np.int64)
                at = pa.array(np.full(len(key), k))
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("cid").take(at), b.column("label").take(at)], ["key", "cid", "label"])

    one = members.join(texts, ["th", "len"]).groupBy("cid", "g", "label").agg(F.first("text").alias("text"))
    return one.mapInArrow(rows, "key bigint, cid binary, label binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = 75) -> DataFrame:
    """The pairs (u, v) of classes whose whole sets really reach the similarity."""
    wanted = pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid"))).distinct()
    keys = wanted.join(classes.select("cid", "th", "len"), "cid")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    texts = docs.select(F.xxhash64("text").alias("th"), F.octet_length("text").alias("len"), "text").filter("text IS NOT NULL")
    texts = texts.join(F.broadcast(keys) if few else keys, ["th", "len"]).groupBy("cid").agg(F.first("text").alias("text"))

    def check(batches):
        for b, left in text_batches(batches, "a"):
            right = [x.encode() for x in b.column("b").to_pylist()]
            ok = []
            for x, y in zip(sets(left, width), sets(right, width), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(ok)], ["u", "v", "ok"])

    left = pairs.join(texts.select(F.col("cid").alias("u"), F.col("text").alias("a")), "u")
    both = left.join(texts.select(F.col("cid").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(check, "u binary, v binary, ok boolean").filter("ok").select("u", "v")


def _unsettled(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys that can make a pair, with their number ``m``: two rows at least, not all of one component (a null label stands for several)."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("x"), F.max("label").alias("y"), F.count("label").alias("one"))
    return rows.join(counts.filter("m > 1 AND (x <> y OR one < m)").select(key, "m"), key)


def _two(rows: DataFrame, key: str, name: str, more: tuple[str, ...], long: bool) -> DataFrame:
    """Every two rows of a key with different names, once, as ``a_`` and ``b_`` columns.

    Where keys are long (``m`` rows), their rows are dealt to blocks of about BLOCK, and
    every two blocks of a key meet in a key of their own.
    """
    cols, keys, once = (name, *more), [key], F.col(f"a_{name}") < F.col(f"b_{name}")
    a, b = (rows.select(key, "m", *[F.col(c).alias(f"{x}_{c}") for c in cols]) for x in "ab")
    if long:
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        block = lambda x: F.pmod(F.xxhash64(f"{x}_{name}"), blocks).cast("int")
        a = a.withColumn("_i", block("a")).withColumn("_j", F.explode(F.sequence("_i", blocks - 1)))
        b = b.withColumn("_j", block("b")).withColumn("_i", F.explode(F.sequence(F.lit(0), "_j")))
        keys, once = [key, "_i", "_j"], (F.col("_i") < F.col("_j")) | once
    return a.drop("m").join(b.drop("m"), keys).filter(once & (F.col(f"a_{name}") != F.col(f"b_{name}")))


def _met(scratch: Scratch, rows: DataFrame, key: str, name: str, more: tuple[str, ...]) -> DataFrame:
    """Every two rows of an unsettled key; only keys of more than BLOCK rows are cut into blocks."""
    rows = scratch.save(_unsettled(rows, key))
    short = _two(rows.filter(F.col("m") <= BLOCK), key, name, more, False)
    long = rows.filter(F.col("m") > BLOCK)
    return short.unionByName(_two(long, key, name, more, True).select(*short.columns)) if long.limit(1).count() else short


def _others(scratch: Scratch, lists: DataFrame, rows: DataFrame, members: DataFrame, docs: DataFrame, shared) -> DataFrame:
    """Pairs (u, v) of classes of different components that share a prefix shingle and pass the filters."""
    kinds = members.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    own = kinds.select("g", F.when(F.col("x") == F.col("y"), F.col("x")).alias("label"))
    named = lists.select("token", "g", "n", "pos").join(own, "g")
    named = scratch.save(_unsettled(named, "token"))
    parts = [_two(named.filter(F.col("m") <= HOT), "token", "g", ("n", "pos", "label"), False)]
    hot = named.filter(F.col("m") > HOT)
    if hot.limit(1).count():
        # only the prefixes of groups in hot lists are shuffled again
        wanted = hot.select("g").distinct()
        few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        of_hot = rows.select("g", "n", "prefix").join(F.broadcast(wanted) if few else wanted, "g", "left_semi")
        second = scratch.save(_by_second(hot.select("token", "g", "label"), _groups(of_hot)))
        parts.append(_met(scratch, second, "token", "g", ("n", "pos", "label")))
    differ = F.coalesce(F.col("a_label") != F.col("b_label"), F.lit(True))
    parts = [x.filter(differ & _may("a_", "b_")).select(F.least("a_g", "b_g").alias("x"), F.greatest("a_g", "b_g").alias("y")) for x in parts]
    met = (parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]).distinct()
    of = lambda g, c: members.select(F.col("g").alias(g), F.col("cid").alias(c), F.col("label").alias(f"{c}_label"))
    between = met.join(of("x", "u"), "x").join(of("y", "v"), "y").filter("u_label <> v_label").select("u", "v")

    # classes of one group with several components
    several = _unsettled(members.select(F.col("g").alias("key"), "g", "cid", "th", "len", "label"), "key")
    halves = [_two(several.filter(F.col("m") <= HOT), "key", "cid", ("label",), False)]
    big = several.filter(F.col("m") > HOT)
    if big.limit(1).count():
        halves.append(_met(scratch, scratch.save(_by_tail(big, docs, shared)), "key", "cid", ("label",)))
    for both in halves:
        between = between.unionByName(both.filter("a_label <> b_label").select(F.col("a_cid").alias("u"), F.col("b_cid").alias("v")))
    return between.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, the text's key (th, len) and a label of the group, a row a document."""
    spark = docs.sparkSession
    scratch = Scratch(docs.sparkSession)
    shared = spark.sparkContext.broadcast(_levels(_sketch(docs)))
    rows = scratch.save(_described(docs, shared))
    alike = rows.filter("n > 0").groupBy("cid", "g", "n").agg(F.min("doc_id").alias("least"), F.min(F.struct("th", "len")).alias("t"), F.first("bits").alias("bits"))
    classes = scratch.save(alike.select("cid", "g", "n", "least", "t.th", "t.len", "bits"))
    lists = scratch.save(_lists(_postings(_groups(rows))))

    # neighbours and heads in the lists, by one class of each group, and the classes of a group in a row
    heads = classes.groupBy("g").agg(F.min("cid").alias("c"))
    later = lists.filter("p_g IS NOT NULL")
    near = [later.filter(_may(x, "")).select(F.least(f"{x}g", "g").alias("a"), F.greatest(f"{x}g", "g").alias("b")) for x in ("p_", "h_")]
    chain = near[0].unionByName(near[1]).distinct()
    chain = chain.join(heads.select(F.col("g").alias("a"), F.col("c").alias("u")), "a").join(heads.select(F.col("g").alias("b"), F.col("c").alias("v")), "b").select("u", "v")
    first = chain.unionByName(_next_in_group(classes)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = scratch.save(_close(first, classes))
    links = scratch.save(verified(first, classes, docs))
    label = components(links)

    # what is left: lists and groups that hold several components
    members = scratch.save(classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "g", "th", "len", F.coalesce("label", "cid").alias("label")))
    cross = scratch.save(_close(_others(scratch, lists, rows, members, docs, shared).join(first, ["u", "v"], "left_anti"), classes))
    more = scratch.save(verified(cross, classes, docs))
    if more.limit(1).count():
        label = components(links.unionByName(more))

    owned = classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least", F.coalesce("label", "cid").alias("label"))
    named = owned.groupBy("label").agg(F.min("least").alias("component_id"))
    of = owned.join(named, "label").select("cid", "label", "component_id")
    out = rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "cid", "th", "len").join(of, "cid", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "th", "len", "label")
    out = cut(out)
    scratch.drop()
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the least doc_id, columns unchanged.

    Documents without words all stay. Of rows that repeat doc_id and text of the
    one that stays, all but one go, too.
    """
    names = docs.columns
    got = link(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "len")).alias("k")
    stay = got.filter(F.col("n_shingles") > 0).groupBy("label").agg(first).select(F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th"), F.col("k.len").alias("_len"))
    empty = ~F.coalesce(docs["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["doc_id"].alias("_a"), F.xxhash64(docs["text"]).alias("_b"), F.octet_length(docs["text"]).alias("_l"), empty.alias("_e"))
    few = stay.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    met = rows.filter(~F.col("_e")).join(F.broadcast(stay) if few else stay, F.col("_a").eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_th")) & (F.col("_l") == F.col("_len")), "left_semi")
    repeated = got.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count() > 0
    if repeated:
        met = met.withColumn("_k", F.row_number().over(Window.partitionBy("_a", "_b").orderBy(F.xxhash64("_row")))).filter("_k = 1")
    return met.select("_row.*").unionByName(rows.filter("_e").select("_row.*"))
