"""Quality rules, n-gram join, line dedup and byte-string dedup against brute force, on odd rows."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import bwt_dedup, line_chunks, ngram_jaccard, quality_rules
from tidemark.llm.common import Scratch
from tidemark.llm.components import components


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_quality_counts(odd_docs, no_docs):
    docs = _rows(odd_docs)
    got = quality_rules.judge(odd_docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == Counter((i, *brute.quality(t)) for i, t in docs)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(no_docs).count() == 0


def test_quality_of_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(140_000)) + " w5 w6 w7"
    df = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    r = quality_rules.base_counts(df).first()
    assert (r["n_words"], r["n_repeat_words"]) == (140_003, 6)


def test_quality_on_both_sides_of_a_power_of_two(spark):
    """Texts just under and over 2**17 words count alike: no length changes how windows are compared."""
    rows = []
    for k, n in enumerate(((1 << 17) - 5, (1 << 17) + 5)):
        w = [f"w{i * 7919 % 99991}x{i}" for i in range(n)]
        w[1000:1004] = w[50:54]
        w[n - 3 :] = w[50:53]
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.base_counts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("a"))).collect()}
    assert got == {k: brute.quality(t)[4] for k, t in rows} == {0: 11, 1: 11}


def test_hosts_that_fail_take_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "bad", "short") for i in range(95)] + [(i, "bad", good) for i in range(95, 100)] + [(i, "fine", good) for i in range(100, 200)] + [(500, None, good)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host_failed", F.lit(9))
    kept = quality_rules.keep_documents(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(100, 200), 500}


def test_hosts_beyond_the_broadcast(spark, monkeypatch, odd_docs):
    plain = Counter(map(tuple, quality_rules.judge(odd_docs).select("doc_id", "n_words", "kept").collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", 1)
    assert Counter(map(tuple, quality_rules.judge(odd_docs).select("doc_id", "n_words", "kept").collect())) == plain


def test_ngram_components(odd_docs, no_docs):
    docs = _rows(odd_docs)
    want = Counter((i, *c) for (i, _), c in zip(docs, brute.components(docs), strict=True))
    got = ngram_jaccard.link(odd_docs)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    assert ngram_jaccard.link(no_docs).count() == 0


def test_ngram_chain_of_near_copies(spark, monkeypatch):
    """Neighbours link, far ends do not; and the way past the broadcast gives the same."""
    words = [f"t{i}" for i in range(400)]
    docs = [(k, " ".join(words[6 * k : 6 * k + 120])) for k in range(40)] + [(100 + k, " ".join(f"u{k}_{i}" for i in range(30))) for k in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = Counter((i, *c) for (i, _), c in zip(docs, brute.components(docs), strict=True))
    assert len({c for _, _, c in want}) < 50
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_KEYS", 0)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.link(df).collect()) == want


def _shared_prefixes(rng, n):
    """Texts of few words from few templates, so that many sets share prefixes, sizes and shingles."""
    out = []
    for i in range(n):
        head = [f"h{rng.randint(0, 3)}x{k}" for k in range(rng.choice([7, 9, 12]))]
        tail = [f"t{rng.randint(0, 2)}y{k}" for k in range(rng.choice([3, 4, 8]))]
        both = head + tail
        for _ in range(rng.randint(0, 2)):
            both[rng.randrange(len(both))] = rng.choice("uvw")
        out.append((i, " ".join(both)))
    return out


@pytest.mark.parametrize(("hot", "flat"), [(128, False), (1, False), (2, True), (128, True)])
def test_ngram_short_texts_with_shared_prefixes(spark, monkeypatch, hot, flat):
    """Links within hot lists, within groups, and with the shingle order by hash alone, against brute force."""
    monkeypatch.setattr(ngram_jaccard, "HOT", hot)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 2 * hot)  # lists that stay hot are cut into several blocks
    if flat:
        monkeypatch.setattr(ngram_jaccard, "_levels", lambda total: np.zeros(len(total), dtype=np.uint8))
    rows = _shared_prefixes(random.Random(hot), 260)
    want = Counter((i, *c) for (i, _), c in zip(rows, brute.components(rows), strict=True))
    got = ngram_jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want


@pytest.mark.parametrize("hot", [128, 2])
def test_ngram_keeps_links_beside_a_stranger_in_the_group(spark, monkeypatch, hot):
    """A and B (similarity 6/8) stay linked where an unlike C of their prefix and size sorts between them."""
    monkeypatch.setattr(ngram_jaccard, "HOT", hot)
    monkeypatch.setattr(ngram_jaccard, "_levels", lambda total: np.zeros(len(total), dtype=np.uint8))
    rows = []
    for i in range(400):
        w = [f"a{i}b{k}" for k in range(11)]
        rows += [(3 * i, " ".join([*w[:10], "x"])), (3 * i + 1, " ".join([*w[:10], "y"])), (3 * i + 2, " ".join([*w[:7], *(f"c{i}d{k}" for k in range(4))]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(400) if got[3 * i + 1] != 3 * i or got[3 * i + 2] != 3 * i + 2] == []


def test_lists_keep_every_shared_shingle(spark):
    """Over many tasks and batches, postings of shingles that two groups have stay, with a neighbour each but the first of a piece."""
    rng = random.Random(5)
    rows = sorted({(rng.choice([1, 2, 3, *range(10, 400)]), g) for g in range(600) for _ in range(3)})
    df = spark.createDataFrame([(t, g, 10 + g % 7, g % 5) for t, g in rows], "token long, g long, n int, pos int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = ngram_jaccard._lists(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = Counter(t for t, _ in rows)
    want = {(t, g) for t, g in rows if many[t] > 1}
    have = Counter((r["token"], r["g"]) for r in got)
    assert want <= set(have) and max(have.values()) == 1
    held = {(r["token"], r["g"]) for r in got if r["p_g"] is not None}
    assert all((r["token"], r["p_g"]) in want and (r["token"], r["h_g"]) in want for r in got if r["p_g"] is not None)
    assert len(want - held) <= len({t for t in many if many[t] > 1}) + 8


def test_ngram_keeps_one(odd_docs):
    docs = _rows(odd_docs)
    kept = ngram_jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    left = _rows(kept)
    groups = brute.grouped((r, d) for r, d in zip(brute.roots(docs), docs, strict=True) if brute.shingles(d[1]))
    firsts = [min((i is None, i or 0) for i, _ in g) for g in groups.values()]
    assert Counter(i for i, t in left if brute.shingles(t)) == Counter(None if z else i for z, i in firsts)
    assert Counter(i for i, t in left if not brute.shingles(t)) == Counter(i for i, t in docs if not brute.shingles(t))


def test_groups_without_ids_stay_apart(spark):
    texts = [" ".join(f"{k}w{i}" for i in range(20)) for k in range(3)]
    df = spark.createDataFrame([(None, t) for t in texts + texts[:1]] + [(4, "")], "doc_id long, text string")
    assert Counter(t for _, t in _rows(ngram_jaccard.keep_one(df))) == Counter([*texts, ""])


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 2000), (2000, 3000), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 2000: 1000, 3000: 1000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_chunks(odd_docs, no_docs, monkeypatch):
    docs = _rows(odd_docs)
    want = Counter((i, t) for (i, _), t in zip(docs, brute.line_dedup(docs), strict=True))
    assert Counter(_rows(line_chunks.report(odd_docs))) == want
    monkeypatch.setattr(line_chunks, "BROADCAST_ROWS", 0)
    assert Counter(_rows(line_chunks.report(odd_docs))) == want
    out = line_chunks.dedup_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    changed = {(i, t) for i, t in want if brute.WORD.search(t or "")}
    assert {(i, t) for i, t in _rows(out) if brute.WORD.search(t or "")} == changed
    assert line_chunks.dedup_documents(no_docs).count() == 0


def _spans_of(df):
    return Counter(map(tuple, df.collect()))


def _want_spans(docs):
    return Counter((i, *s) for (i, _), s in zip(docs, brute.spans(docs), strict=True))


def test_byte_strings(odd_docs, no_docs, monkeypatch):
    want = _want_spans(_rows(odd_docs))
    assert _spans_of(bwt_dedup.dedup(odd_docs)) == want
    monkeypatch.setattr(bwt_dedup, "BROADCAST_ROWS", -1)
    assert _spans_of(bwt_dedup.dedup(odd_docs)) == want
    assert bwt_dedup.dedup(no_docs).count() == 0


def test_byte_strings_over_many_shards_and_blocks(spark, monkeypatch):
    """Passages in changing contexts, runs of one byte, one id in many rows, over small shards, pieces and blocks."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(6)] + ["z" * 300, "ab" * 120]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(30))]
        for _ in range(rng.randint(0, 3)):
            x = rng.choice(passages)
            a = rng.randint(0, len(x) // 2)
            parts += [x[a : a + rng.randint(45, 200)], word()]
        rows.append((None if i % 17 == 3 else 7 if i % 11 == 5 else i, " ".join(parts)))
    for name, size in (("SHARD_BYTES", 900), ("PIECE_BYTES", 120), ("BLOCK_ROWS", 1500)):
        monkeypatch.setattr(bwt_dedup, name, size)
    assert _spans_of(bwt_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == _want_spans(rows)


def test_byte_strings_of_very_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) + 5000))
    rows = [(1, long), (2, "new start " + long[700_000:] + long[:200]), (3, "q" * (1 << 20)), (4, "q" * 2000 + "r")]
    assert _spans_of(bwt_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == _want_spans(rows)


def test_rounds_order_suffixes():
    """The vector after the last round is the order of all suffixes, and its marks are the common prefixes below 50."""
    strings = [b"banana" * 12, b"bandana" * 10, b"ananas" * 12, b"a" * 80, b"nab" * 20]
    shards = [bwt_dedup.Transform([s]) for s in strings]
    blocks = bwt_dedup.Blocks([])
    coded = [t.coded(blocks) for t in shards]
    parts = []
    for k, (_, own, _) in enumerate(coded):
        first, counts = bwt_dedup._runs_of(own)
        same = np.zeros(len(first), dtype=np.uint64)
        parts.append((np.full(len(own), k, dtype=np.uint8), np.zeros(len(own), dtype=bool), own[first], counts, same, same))
    v = bwt_dedup.assemble(parts, blocks)
    symbols = np.concatenate([before for before, _, _ in coded])
    for _ in range(24):
        v = bwt_dedup.assemble([bwt_dedup.refine(v, 0, symbols)], blocks)
    rows = sorted((bytes(np.take(t.text, np.arange(i, i + 50), mode="wrap")), k) for k, t in enumerate(shards) for i in range(t.n))
    assert v.z.tolist() == [k for _, k in rows]
    assert v.marks.tolist() == [True] + [a[0] != b[0] for a, b in zip(rows[:-1], rows[1:], strict=True)]


def test_rounds_of_more_bytes_end_with_the_same_order():
    """Dictionaries of 3, 4 and 6 bytes give the order of all suffixes in 16, 12 and 8 rounds."""
    strings = [b"banana" * 12, b"bandana" * 10, b"ananas" * 12, b"a" * 80, b"nab" * 20]
    shards = [bwt_dedup.Transform([s]) for s in strings]
    rows = sorted((bytes(np.take(t.text, np.arange(i, i + 50), mode="wrap")), k) for k, t in enumerate(shards) for i in range(t.n))
    blocks = bwt_dedup.Blocks([])
    for width in bwt_dedup.WIDTHS:
        grams = np.unique(np.concatenate([bwt_dedup._packed(np.resize(t.text, t.n + width), t.n, width) for t in shards]))
        symbols = bwt_dedup.Blocks([], width, grams)
        coded = [t.coded(blocks, symbols) for t in shards]
        parts = []
        for k, (_, own, _) in enumerate(coded):
            first, counts = bwt_dedup._runs_of(own)
            same = np.zeros(len(first), dtype=np.uint64)
            parts.append((np.full(len(own), k, dtype=np.uint8), np.zeros(len(own), dtype=bool), own[first], counts, same, same))
        v = bwt_dedup.assemble(parts, blocks)
        before = np.concatenate([x for x, _, _ in coded])
        for _ in range(48 // width):
            v = bwt_dedup.assemble([bwt_dedup.refine(v, 0, before)], symbols)
        assert v.z.tolist() == [k for _, k in rows]
        assert v.marks.tolist() == [True] + [a[0] != b[0] for a, b in zip(rows[:-1], rows[1:], strict=True)]


def test_the_dictionary_keeps_to_its_bound(spark, monkeypatch):
    """Strings of as many bytes as fit the bound, whichever shards hold them; pairs, if none fit."""
    rng = random.Random(4)
    shards = spark.createDataFrame([([bytearray(rng.choices(b"abcde", k=400))],) for _ in range(6)], "strings array<binary>").repartition(3)
    for most, want in ((1 << 18, 6), (700, 4), (200, 3), (20, 2)):
        monkeypatch.setattr(bwt_dedup, "MOST_GRAMS", most)
        width, grams = bwt_dedup._dictionary(Scratch(spark), shards)
        texts = [bwt_dedup._joined([bytes(x) for x in r["strings"]]) for r in shards.collect()]
        kinds = {bwt_dedup._packed(np.resize(t, len(t) + width), len(t), width)[i] for t in texts for i in range(len(t))}
        assert width == want and (grams.tolist() == sorted(int(x) for x in kinds) if width > 2 else grams is None)


def test_sorting_a_shard_holds_little_memory():
    """Rows that differ early are not sorted on, and no table of eight bytes a suffix outlives its step."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 117, 1 << 20, dtype=np.uint8).tobytes()
    tracemalloc.start()
    t = bwt_dedup.Transform([text, text[:1000]])
    most = tracemalloc.get_traced_memory()[1] / t.n
    tracemalloc.stop()
    assert most < 40 and (~t.parts).sum() > 900


@pytest.mark.parametrize("keys", [250_000, 0])
def test_prefixes_of_groups_outside_hot_lists_are_not_dealt_again(spark, monkeypatch, keys):
    """A second split reads the prefixes of the groups in hot lists alone, by a broadcast of their keys or by a shuffle."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common = [word() for _ in range(5)]
    rows = [(i, " ".join([*common, *[word() for _ in range(7)]])) for i in range(12)] + [(i, " ".join(word() for _ in range(12))) for i in range(20, 80)]
    seen, plain = [], ngram_jaccard._by_second
    monkeypatch.setattr(ngram_jaccard, "_by_second", lambda hot, groups: seen.append((hot.select("g").distinct().count(), groups.count())) or plain(hot, groups))
    monkeypatch.setattr(ngram_jaccard, "_levels", lambda total: np.zeros(len(total), dtype=np.uint8))
    monkeypatch.setattr(ngram_jaccard, "prefix_length", lambda n: n)
    for name, n in (("HOT", 3), ("BROADCAST_KEYS", keys)):
        monkeypatch.setattr(ngram_jaccard, name, n)
    got = ngram_jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r["doc_id"] == r["component_id"] for r in got.collect())
    assert seen == [(12, 12)]
