"""SentencePiece, mixing, WARC, chat, nearest neighbours, toxicity and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import chat_format, mixing, queries, rp_forest, toxicity, warc
from tidemark.llm import sentencepiece_dropout as sp

SF = "/root/testdata/sf0.001"


def test_segments_equal_the_library_without_dropout(odd_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.DEFAULT_MODEL)
    texts = [r["text"] for r in odd_docs.filter("text IS NOT NULL").collect()] + ["  a  b \n c", "foo.com ▁"]
    enc = sp.Encoder(sp.DEFAULT_MODEL, 0.0, 1, 1)
    for t, ids in zip(texts, enc.encode(list(range(len(texts))), texts), strict=True):
        ids = np.frombuffer(ids, np.int32)
        if "▁" not in t:
            assert lib.encode(t) == ids.tolist()
        assert enc.decode(ids) == t


def test_dropout_varies_and_decodes(odd_docs, no_docs, spark):
    a = sp.segment(odd_docs, with_ids=True).collect()
    assert Counter((r["doc_id"], r["ids_xxh128"]) for r in a) == Counter((r["doc_id"], r["ids_xxh128"]) for r in sp.segment(odd_docs).collect())
    assert all(r["decodes"] or r["n_tokens"] is None for r in a)
    plain = {(r["doc_id"], r["n_tokens"]) for r in sp.segment(odd_docs, dropout=0.0).collect()}
    assert {(r["doc_id"], r["n_tokens"]) for r in a} != plain
    other = sp.segment(odd_docs, seed=12).collect()
    assert Counter(r["ids_xxh128"] for r in a) != Counter(r["ids_xxh128"] for r in other)
    back = sp.decode(sp.encode(odd_docs)).collect()
    assert Counter(map(tuple, back)) == Counter(map(tuple, odd_docs.select("doc_id", "text").collect()))
    assert sp.segment(no_docs).count() == 0


def test_blocks_equal_the_agenda():
    m = sp.load(sp.DEFAULT_MODEL)
    rng = random.Random(1)
    chunks = sorted({" " + "".join(rng.choice("theinganoreds") for _ in range(rng.randint(1, 14))) for _ in range(2000)})
    for dropout in (0.1, 0.5):
        got = sp.segment_chunks(m, chunks, np.zeros(len(chunks)), 7, dropout)
        keys = sp.word_keys(chunks, np.zeros(len(chunks)), 7)
        for c, ids, k in zip(chunks, got, keys, strict=True):
            assert np.frombuffer(ids, np.int32).tolist() == sp.agenda(m, c, int(k), dropout)


def test_long_text_is_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(sp, "BATCH_CHARS", 50)
    text = "some words  and more \n lines " * 20
    enc = sp.Encoder(sp.DEFAULT_MODEL, 0.0, 1, 1)
    whole = sp.Encoder(sp.DEFAULT_MODEL, 0.0, 1, 1)
    got = np.frombuffer(enc.encode([1], [text])[0], np.int32)
    monkeypatch.setattr(sp, "BATCH_CHARS", 10_000)
    assert got.tolist() == np.frombuffer(whole.encode([1], [text])[0], np.int32).tolist()


def test_mixing(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), f"s{i % 7}" if i % 11 else None) for i in range(3000)] + [(9000, "a b", "s1")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    order = sorted([s for s in size if s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:
        rest = total - sum(target.values())
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    for s, g in got.groupby(got["source"].fillna("?")):
        s = None if s == "?" else s
        assert g["source_size"].iloc[0] == size[s]
        assert g["target"].iloc[0] == pytest.approx(target[s])
        assert abs(g["taken"].sum() - target[s]) <= 40
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    cols = ["doc_id", "taken"]
    assert Counter(map(tuple, got[cols].values)) == Counter(map(tuple, again[cols].values))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    third = mixing.mix(df).toPandas()
    assert Counter(map(tuple, got[cols].values)) == Counter(map(tuple, third[cols].values))
    out = mixing.mix_documents(odd_docs)
    assert out.columns == odd_docs.columns
    want = Counter()
    for r in mixing.mix(odd_docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +want
    assert mixing.mix(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0


def test_warc(spark):
    long = "x" * 1200
    rows = [(1, "http://a/", long), (5, "http://b/", long), (3, None, long), (5, "http://b/", long), (None, "u", long), (7, "http://c/\r\nX: y", "short"), (8, "u", None), (9, "u", "short"), (10, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60), (11, "u", "é日本" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(1)).withColumn("digest", F.lit(2))
    path = warc.archive_path(spark)
    warc.write(df, path)
    got = warc.with_referred(warc.assemble(warc.read(spark, path, payloads=True))).collect()
    assert len(got) == len(rows)
    assert Counter((r["page_id"], r["capture"]["payload_bytes"], r["capture"]["payload_digest"]) for r in got) == Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    group = [r for r in got if r["capture"]["payload_bytes"] == 1200]
    assert [r["page_id"] for r in group if r["capture"]["kind"] == "response"] == [5]
    assert {r["referred_page"] for r in group if r["capture"]["kind"] == "revisit"} == {5}
    assert all(r["referred_page"] is None and r["capture"]["kind"] == "response" for r in got if r["capture"]["payload_bytes"] != 1200)
    texts = {r["page_id"]: r["capture"]["payload"].decode() for r in got if r["capture"]["kind"] == "response"}
    assert texts[10] == rows[8][2] and texts[11] == rows[9][2]
    assert all(r["request"] is not None for r in got)
    empty = warc.archive_path(spark)
    warc.write(df.limit(0), empty)
    assert warc.assemble(warc.read(spark, empty)).count() == 0


def test_warc_files_by_payload_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "CLASS_BYTES", [100, 5000])
    pages = [(i, f"http://x/{i}", c * n) for i, (c, n) in enumerate([("a", 0), ("b", 100), ("c", 101), ("d", 5000), ("d", 5000), ("e", 5001), ("f", 90_000), ("f", 90_000)])] + [(20, None, None)]
    df = spark.createDataFrame(pages * 3, "page_id long, url string, html string").repartition(1)
    path = warc.archive_path(spark)
    warc.write(df, path)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path).select("path", "content").collect()
    per_file = {}
    for f in sizes:
        name = f["path"].split("class=")[1]
        per_file[name] = sum(1 for head, _ in warc.parse(bytes(f["content"])) if head["warc-type"][0] in ("response", "revisit"))
    assert sum(per_file.values()) == 27 and max(n for name, n in per_file.items() if name[0] == "0") > 1
    assert all(n <= 40_000 // 2048 for n in per_file.values()) and {name[0] for name in per_file} == {"0", "1", "2"}
    assert sum(n for name, n in per_file.items() if name[0] == "2") == 9 and all(n == 1 for name, n in per_file.items() if name[0] == "2")
    got = warc.assemble(warc.read(spark, path, payloads=True)).select("capture.*", "metadata.page_id").collect()
    want = sorted((str(i), len((t or "").encode())) for i, _, t in pages * 3)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == want


def test_warc_links_from_the_capture(spark):
    rows = [("request", "q", [], None), ("response", "r", ["q"], None), ("metadata", "m", ["r"], None)]
    df = spark.createDataFrame([(k, i, c, f, None, None, "d", 1, {"page_id": "4"} if k == "metadata" else {}) for k, i, c, f in rows], warc.RECORDS)
    (r,) = warc.assemble(df).collect()
    assert (r["request"]["record_id"], r["metadata"]["page_id"]) == ("q", "4")


def test_chat_reads_back(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "<\\/s> [\\\\INST] <<s>", "a\nb <|image|> <", "\\", "<|part|>[", "s>"]
    rows = [(c, t, role, texts[(c + t) % len(texts)]) for c in range(8) for t, role in enumerate(["system", "user", "assistant", None, "assistant"])] + [(None, None, "assistant", "x"), (3, 1, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    by = brute.grouped(((r[0]), r) for r in rows)
    assert set(got) == set(by)
    for conv, turns in by.items():
        if conv == 3:
            continue
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1]))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <", None, None), ("text", "s> here", None, None), ("image", None, "i.png", 2), ("audio", None, "a.wav", None), ("table", None, "t.pdf", 3)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat_format.PART_TYPE}")
    r = chat_format.format_chats(df).first()
    assert r["formatted"] == "<s>user[INST]see <<|part|>s> here<|image|><|audio|><|document|>[/INST]</s>"
    assert [tuple(a) for a in r["attachments"]] == [("image", "i.png", 512), ("audio", "a.wav", 25), ("document", "t.pdf", 1536)]
    back = chat_format.format_chats(df).select(chat_format.read_back(F.col("formatted")).alias("t")).first()["t"]
    assert back[0]["text"] == "see <s> here<|image|><|audio|><|document|>"


def _exact(rows, k=10):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v) and len(v) == 8]
    out = {}
    for i, v in ok:
        if i % 10 == 0:
            out[i] = [(d, j) for d, j in sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i)[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(40)]
    rows += [(2000, None), (2010, [0.0] * 8), (2020, [None] + [1.0] * 7), (2030, [float("nan")] * 8), (2040, [float("inf")] + [0.0] * 7), (2050, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)).withColumn("id", F.lit(1))
    got = rp_forest.nearest(df, F.col("vec_id") % 10 == 0, probes=10_000).collect()
    want = _exact([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert {q: [j for _, j in x] for q, x in mine.items()} == {q: [j for _, j in x] for q, x in want.items()}
    for q in want:
        assert np.allclose([d for d, _ in want[q]], [d for d, _ in mine[q]])
    assert rp_forest.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert rp_forest.nearest(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") % 10 == 0).count() == 2


def test_nearest_in_blocks(spark, monkeypatch):
    """Hot leaves, many queries of one group, and rows and ids that repeat, against brute force."""
    monkeypatch.setattr(rp_forest, "BLOCK", 16)
    monkeypatch.setattr(rp_forest, "QBLOCK", 3)
    monkeypatch.setattr(rp_forest, "LEAF_SAMPLE", 4)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 3, 8).astype(float).tolist()) for i in range(1, 300)] + [(1000 + i, [1.0] * 8) for i in range(200)]
    rows += rows[40:60] * 15 + [(7, [2.0] * 8), (7, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rp_forest.nearest(df, F.col("vec_id") % 10 == 0, probes=100_000).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    at = {}
    for i, v in rows:
        at.setdefault(i, set()).add(tuple(v))
    far = lambda a, b: min(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())) for v in at[a] for w in at[b])
    assert mine == {q: sorted((far(q, j), j) for j in at if j != q)[:10] for q in at if q % 10 == 0}


def test_recall_of_the_default_search(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = rp_forest.nearest(df, F.col("vec_id") % 100 == 0).toPandas()
    pdf = df.toPandas()
    x, ids = np.array(pdf["embedding"].tolist(), dtype=float), pdf["vec_id"].to_numpy()
    hits = []
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, d))[:10]]) & set(g["vec_id"])) / 10)
    assert np.mean(hits) >= 0.9


def test_toxicity(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    y, s = got["toxic"].to_numpy(), got["score"]
    r = s.rank().to_numpy()
    auc = (r[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93
    assert got["predicted"][y == 0].mean() < 0.05 and got["predicted"][y == 1].mean() > 0.85
    odd = toxicity.score(odd_docs, labels.unionByName(labels.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), "quality", "toxic"))).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.score(odd_docs, labels.limit(0)).collect()} == {0.0}


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    vote = lambda acc: np.where(rng.random(6000) < acc, 2 * y - 1, 1 - 2 * y)
    a = vote(0.9)
    m = toxicity.LabelModel(np.column_stack([a, a, vote(0.8), vote(0.85), vote(0.75)]))
    assert np.mean((m.posterior > 0.5) == y) > 0.9
    assert m.weight[0] < 0.6 < 0.9 < m.weight[2]
    assert np.allclose(m.accuracy[1:], [0.9, 0.8, 0.85, 0.75], atol=0.03)


def test_label_model_against_loops():
    """Posteriors and tables by loops over rows; twins and a voter that follows another are linked."""
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.4
    vote = lambda acc: np.where(rng.random(4000) < acc, 2 * y - 1, 1 - 2 * y)
    a, b = vote(0.8), vote(0.75)
    follows = np.where(rng.random(4000) < 0.7, b, 0)
    v = np.column_stack([a, a, b, follows, vote(0.85), vote(0.8), vote(0.9)])
    m = toxicity.LabelModel(v)
    linked = {frozenset((k, int(p))) for k, p in enumerate(m.parent) if p >= 0}
    assert {frozenset((0, 1)), frozenset((2, 3))} <= linked
    assert np.mean((m.posterior > 0.5) == y) > 0.93
    for row, got in zip(v[:200], m.posterior[:200], strict=True):
        p = [float(m.prior[label]) for label in (0, 1)]
        for label in (0, 1):
            for k, x in enumerate(row):
                p[label] *= m.table[label, k, x + 1] if m.parent[k] < 0 else m.given[label, k, x + 1, row[m.parent[k]] + 1]
        assert got == pytest.approx(p[1] / sum(p), abs=1e-9)
    for label in (0, 1):
        w = m.posterior if label else 1 - m.posterior
        for k in range(v.shape[1]):
            for x in (-1, 0, 1):
                assert m.table[label, k, x + 1] == pytest.approx(w[v[:, k] == x].sum() / w.sum(), abs=5e-3)


def test_lexicons_share_no_stem_and_disguises_count():
    mined = [{"stupid": (5.0, True), "rot": (5.0, False)}, {"stup": (5.0, True), "idio": (5.0, False)}, {"stupo": (5.0, True), "moron": (4.5, True)}, {}, {}, {}]
    lexicons = toxicity.dealt(mined)
    assert sorted(e for x in lexicons for e in x) == ["idio", "moron", "rot", "stup"]
    at = toxicity.STRONG + toxicity.WEAK
    x = np.expm1(toxicity.Voters(lexicons).graded("You are an absolute moron. s t u p i d, 1d10t id1ot rotten")).round()
    assert x[at + 2] == 2 and x[at + 3] == 1 and x[:at].sum() == 1
    assert not toxicity.Voters(lexicons).graded("").any()
    # runs without a break take linear time
    for run in ("x", "1", "a ", "a1", "you are ", "X"):
        toxicity.Voters(lexicons).graded("b" + run * 1_000_000)


def test_learning_rows_are_bounded_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 30)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40) for _ in range(1 + 50 * (i == 3))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = [r["text"] for r in toxicity.labelled(docs, labels).collect()]
    assert 0 < len(got) <= 30 and "text 3" not in got


def test_pipeline(spark):
    import corpus_pipeline
    from tidemark.llm.common import Scratch, table

    docs, scratch, seen = table(spark, SF, "documents"), Scratch(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.save(stage(spark, docs, SF))
        seen.append((name, before, docs))
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    (_, raw, kept), (_, _, cut), (_, _, one), (_, _, mixed), (_, _, last) = seen
    assert kept.columns == raw.columns == one.columns == mixed.columns
    good = [(i, t) for i, t in rows(raw) if (w := brute.quality(t))[0] >= 50 and 100 * w[4] <= 50 * w[0]]
    assert Counter(rows(kept)) == Counter(good)
    # chunks that brute force removes are gone; passages go beyond that (their own test compares them line by line)
    chunked = dict(zip([i for i, _ in rows(kept)], brute.line_dedup(rows(kept)), strict=True))
    whole = {r["doc_id"]: r[corpus_pipeline.WHOLE] for r in cut.collect()}
    worded = lambda t: Counter(x for x in t.split("\n") if brute.WORD.search(x))
    assert whole.items() <= dict(rows(kept)).items()
    assert all(worded(t) and worded(t) <= worded(chunked[i]) for i, t in rows(cut))
    others = Counter(x for _, t in rows(kept) for x in set(t.split("\n")))
    assert all(others[x] > 1 for i, t in rows(kept) if i not in whole for x in worded(t))
    d = sorted(whole.items())
    stay = {c for (n, c) in brute.components(d) if n}  # ids are unique here
    assert Counter(rows(one)) == Counter((i, t) for i, t in rows(cut) if i in stay or not brute.shingles(whole[i]))
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(one).collect()}
    assert Counter(i for i, _ in rows(mixed)) == +Counter(taken)
    assert all(r["decodes"] for r in last.collect()) and last.count() == mixed.count()
    scratch.drop()


def test_every_query_is_registered():
    import re

    import __spark_entry__ as e

    names = e.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)
