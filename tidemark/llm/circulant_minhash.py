"""Near-duplicate groups by circulant MinHash.

A document's set is its distinct 3-word shingles. Two permutations make all
signature coordinates: the first, sigma, shuffles the shingles' places in the
universe of 2**64; the second, pi, is shifted circularly by k for coordinate k, which is
min over the set of pi((sigma(x) - k) mod 2**64). Both are bijections of 64-bit
numbers, so no table of a permutation is held.

1. Documents with the same set collapse into a class.
2. A class has ``BANDS`` band keys of ``ROWS`` coordinates. The keys are sorted by
   range over the cluster; each class of a bucket is compared with the one before it
   and with the head of its piece of the bucket. Pairs whose sizes and parity
   bitmaps leave room for the similarity are verified on the texts' full sets, and links
   are joined into components.
3. Buckets that still hold classes of several components are cut into blocks of
   ``BLOCK`` classes. Every two blocks of a bucket meet in a row of their own, where
   sizes and bitmaps (both filters are exact) leave few pairs; these are verified, too. So
   a bucket of any size is done whole, by many tasks.

At a similarity of exactly 0.85 all bands miss a pair with a chance of
(1 - 0.85**6)**40 = 6e-9; nothing else can lose a link. Pairs within a component are
never emitted.

Defined cases: a text without words is linked with nothing and kept; with fewer
than three words the whole sequence is the one shingle; a null doc_id keeps its row
(its component is the least doc_id that is not null, if any, and it is kept only if
there is none); repeated rows are one class and each keeps its row; an empty
table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, cut
from tidemark.llm.components import components
from tidemark.llm.ngram_jaccard import parity, verified
from tidemark.llm.shingles import mixed, sets, text_batches

WIDTH, PERCENT = 3, 85
ROWS, BANDS = 6, 40
#: Classes of one block of a bucket with several components.
BLOCK = 256
#: Bitmaps are folded to this many bytes at most; a folded one still bounds the difference from below.
BITMAP = 1 << 13
SIGMA, PI = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
P1, P2 = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def signatures(members: list[np.ndarray]) -> np.ndarray:
    """The signature (a row of ROWS * BANDS coordinates) of each set; none may be empty."""
    starts = np.cumsum([0, *[len(s) for s in members[:-1]]])
    y = mixed(np.concatenate(members) ^ SIGMA)  # sigma
    out = np.empty((len(members), ROWS * BANDS), dtype=np.uint64)
    z, t = np.empty_like(y), np.empty_like(y)
    for k in range(ROWS * BANDS):  # pi, shifted by k
        np.subtract(y, np.uint64(k), out=z)
        np.bitwise_xor(z, PI, out=z)
        np.multiply(z, P1, out=z)
        np.right_shift(z, np.uint64(32), out=t)
        np.bitwise_xor(z, t, out=z)
        np.multiply(z, P2, out=z)
        np.right_shift(z, np.uint64(29), out=t)
        np.bitwise_xor(z, t, out=z)
        out[:, k] = np.minimum.reduceat(z, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    s = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), s.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key * P1 + s[:, :, r])
    return key


def _bitmap(s: np.ndarray) -> bytes:
    b = parity(s)
    if len(b) > BITMAP:
        x = np.frombuffer(b, np.uint64)
        while 8 * len(x) > BITMAP:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        b = x.tobytes()
    return b


def _described(docs: DataFrame) -> DataFrame:
    """A row a document: set size, class, band keys and bitmap."""

    def rows(batches):
        for b, texts in text_batches(batches, most=1 << 20):
            found = list(sets(texts, WIDTH))
            some = [s for s in found if len(s)]
            keys = iter(band_keys(signatures(some))) if some else iter(())
            n, cid, bands, bits = [], [], [], []
            for s in found:
                n.append(len(s))
                cid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(next(keys).tobytes() if len(s) else None)
                bits.append(_bitmap(s) if len(s) else None)
            cols = [b.column("doc_id"), b.column("th"), b.column("len"), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(bands, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "len", "n", "cid", "bands", "bits"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.octet_length("text").alias("len"), "text")
    return source.mapInArrow(rows, "doc_id bigint, th bigint, len int, n bigint, cid binary, bands binary, bits binary")


def _postings(classes: DataFrame) -> DataFrame:
    """(key, cid, n), a row a class and band."""

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                key = np.frombuffer(b"".join(part.column("bands").to_pylist()), dtype=np.int64)
                of = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("cid").take(of), part.column("n").take(of)], ["key", "cid", "n"])

    return classes.select("cid", "n", "bands").mapInArrow(rows, "key bigint, cid binary, n bigint")


def _buckets(postings: DataFrame) -> DataFrame:
    """The postings of buckets with several classes, each with its neighbour and its head in its piece of the bucket.

    Sorted by range, so a large bucket is dealt to many tasks. A task's first and
    last rows stay, as their buckets may go on elsewhere.
    """

    def rows(batches):
        held = p = h = None  # the last row as a batch, its neighbour and its head
        start = True
        for b in batches:
            if held is not None:
                b = pa.concat_batches([held, b])
            m = b.num_rows
            if not m:
                continue
            key, cid = b.column("key").to_numpy(), b.column("cid")
            same = np.concatenate([[False], key[1:] == key[:-1]])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(m)))
            first = cid.take(pa.array(head))
            before = cid.take(pa.array(np.maximum(np.arange(m) - 1, 0)))
            if p is not None:
                same[0] = True
                first = pc.if_else(pa.array(head == 0), h, first)
                before = pc.if_else(pa.array(np.arange(m) == 0), p, before)
            keep = same.copy()
            keep[:-1] |= same[1:]
            if start:
                keep[0], start = True, False
            held = b.slice(m - 1)
            p, h = (before[m - 1], first[m - 1]) if same[m - 1] else (None, None)
            keep[m - 1] = False  # comes with the next batch or at the end
            at = pa.array(np.flatnonzero(keep))
            none = pa.scalar(None, pa.binary())
            alone = pa.array(~same)
            yield out(b.take(at), *[pc.if_else(alone, none, x).take(at) for x in (before, first)])
        if held is not None:
            yield out(held, *[pa.array([None if x is None else x.as_py()], pa.binary()) for x in (p, h)])

    def out(b, before, first):
        return pa.RecordBatch.from_arrays([b.column("key"), b.column("cid"), b.column("n"), before, first], ["key", "cid", "n", "p", "h"])

    dealt = postings.repartitionByRange("key", "n", "cid").sortWithinPartitions("key", "n", "cid")
    return dealt.mapInArrow(rows, "key bigint, cid binary, n bigint, p binary, h binary")


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(bits), width // 8), dtype=np.uint64)
    for k, b in enumerate(bits):
        x = np.frombuffer(b, np.uint64)
        while 8 * len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def _roomy(a: list[bytes], b: list[bytes], m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[j]) leave room for the similarity by sizes and bitmaps: |A xor B| <= (100 - P) / (100 + P) * (|A| + |B|)."""
    ok = 100 * np.minimum(m[i], n[j]) >= PERCENT * np.maximum(m[i], n[j])
    widths = np.minimum(np.array([len(x) for x in a])[i], np.array([len(x) for x in b])[j])
    for w in np.unique(widths[ok]).tolist():
        at = np.flatnonzero(ok & (widths == w))
        (iu, ii), (ju, jj) = (np.unique(x[at], return_inverse=True) for x in (i, j))
        x, y = _folded([a[k] for k in iu], w), _folded([b[k] for k in ju], w)
        for s in range(0, len(at), 1 << 13):
            part = slice(s, s + (1 << 13))
            apart = np.bitwise_count(x[ii[part]] ^ y[jj[part]]).sum(axis=1, dtype=np.int64)
            ok[at[part]] = (100 + PERCENT) * apart <= (100 - PERCENT) * (m[i[at[part]]] + n[j[at[part]]])
    return ok


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            every = np.arange(b.num_rows)
            ok = _roomy(b.column("a_bits").to_pylist(), b.column("b_bits").to_pylist(), b.column("a_n").to_numpy(), b.column("b_n").to_numpy(), every, every)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok))

    of = lambda x, side: classes.select(F.col("cid").alias(x), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits"))
    both = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v")
    return both.select("u", "v", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(rows, "u binary, v binary")


def _met(scratch: Scratch, buckets: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes of different components that share a bucket and pass the exact filters."""
    named = buckets.select("key", "cid").join(members.select("cid", "label"), "cid")
    counts = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    # blocks of a bucket by hash: about BLOCK classes each, so that none is numbered in one task
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int")
    mixed_keys = counts.select("key", blocks.alias("blocks"))
    rows = scratch.save(named.join(mixed_keys, "key").select("key", "cid", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block")))
    full = rows.join(members.select("cid", "n", "label", "bits"), "cid")
    block = scratch.save(full.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("cid", "n", "label", "bits")).alias("l")))
    one = block.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("l").alias("a"))
    both = one.join(block.select("key", F.col("block").alias("j"), F.col("l").alias("b")), ["key", "j"]).select("i", "j", "a", "b")

    def pairs(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                i, j, a, b = (batch.column(c)[row].as_py() for c in ("i", "j", "a", "b"))
                names = {x: k for k, x in enumerate({x["label"] for x in a + b})}
                la, lb = (np.array([names[x["label"]] for x in side]) for side in (a, b))
                x, y = np.nonzero(np.triu(la[:, None] != lb[None, :], 1) if i == j else la[:, None] != lb[None, :])
                ok = _roomy([z["bits"] for z in a], [z["bits"] for z in b], np.array([z["n"] for z in a]), np.array([z["n"] for z in b]), x, y)
                found = sorted({tuple(sorted((a[s]["cid"], b[t]["cid"]))) for s, t in zip(x[ok].tolist(), y[ok].tolist(), strict=True)})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in found], pa.binary()) for k in (0, 1)], ["u", "v"])

    return both.mapInArrow(pairs, "u binary, v binary").distinct()


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row a document."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(_described(docs))
    alike = rows.filter("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("least"), F.min(F.struct("th", "len")).alias("t"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = scratch.save(alike.select("cid", "n", "least", "t.th", "t.len", "bands", "bits"))
    buckets = scratch.save(_buckets(_postings(classes)))
    later = buckets.filter("p IS NOT NULL")
    chain = later.select(F.col("p").alias("u"), F.col("cid").alias("v")).unionByName(later.select(F.col("h").alias("u"), F.col("cid").alias("v")))
    chain = chain.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = scratch.save(verified(scratch.save(_close(chain, classes)), classes, docs, WIDTH, PERCENT))
    label = scratch.save(components(first))

    members = scratch.save(classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n", "least", "bits", F.coalesce("label", "cid").alias("label")))
    cross = scratch.save(_met(scratch, buckets, members))
    more = scratch.save(verified(cross, classes, docs, WIDTH, PERCENT))
    if more.limit(1).count():
        stars = label.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
        label = components(stars.unionByName(more))

    owned = classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least", F.coalesce("label", "cid").alias("label"))
    named = owned.groupBy("label").agg(F.min("least").alias("component_id"))
    of = owned.join(named, "label").select("cid", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(of, "cid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    out = cut(out)
    scratch.drop()
    return out
