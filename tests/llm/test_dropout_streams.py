"""Each word occurrence, and each copy of a document, is varied anew."""

import random

import numpy as np
import pytest

from tidemark.llm import sentencepiece_dropout as sp

TEXT = "international understanding " * 400


def test_occurrences_have_more_than_a_few_forms():
    enc = sp.Encoder(sp.DEFAULT_MODEL, 0.1, 11)
    forms = set()
    for key in range(3):
        (ids,) = enc.encode([key], [TEXT.strip()])
        ids = np.frombuffer(ids, np.int32)
        assert enc.decode(ids) == TEXT.strip()
        forms |= {w.strip("|") for w in "|".join(enc.model.pieces[i] for i in ids).split("▁") if w.startswith("i")}
    assert len(forms) > 20


def test_shortcut_equals_the_agenda():
    m, enc = sp.load(sp.DEFAULT_MODEL), sp.Encoder(sp.DEFAULT_MODEL, 0.2, 7)
    text = " " + TEXT + "a b cd " * 50 + "x" * 80
    got = enc.encode([5], [text[1:]])[0]
    chunks = sp.CHUNK.findall(text)
    doc = np.uint64(sp.xxhash.xxh3_64_intdigest("5", seed=7))
    stream = sp.mixed(doc ^ (np.arange(len(chunks)).astype(np.uint64) * sp.M1))
    want = [i for c, k in zip(chunks, sp.word_keys(chunks, stream, 7), strict=True) for i in sp.agenda(m, c, int(k), 0.2)]
    assert np.frombuffer(got, np.int32).tolist() == want


def test_copies_differ(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, TEXT)] * 3 + [(2, TEXT)], "doc_id long, text string")
    got = corpus_pipeline.segments(spark, docs, "").collect()
    assert len({r["ids_xxh128"] for r in got}) == 4 and all(r["decodes"] for r in got)


def test_segments_equal_a_plain_merge_loop():
    """Against brute force, over word lengths on both sides of the block limit."""
    import random

    import sentencepiece

    from tests.llm import brute

    real, m = brute.piece_scores(sentencepiece.SentencePieceProcessor(model_file=sp.DEFAULT_MODEL)), sp.load(sp.DEFAULT_MODEL)
    rng = random.Random(4)
    chunks = sorted({" " + "".join(rng.choice("theinganoreds") for _ in range(rng.choice([1, 3, 7, 20, 40, 62, 63, 64, 70]))) for _ in range(160)})
    for dropout in (0.0, 0.1, 0.6):
        got = sp.segment_chunks(m, chunks * 8, np.arange(8 * len(chunks)) % 3, 7, dropout)
        keys = sp.word_keys(chunks * 8, np.arange(8 * len(chunks)) % 3, 7)
        for c, ids, k in list(zip(chunks * 8, got, keys, strict=True))[:: 1 if dropout == 0.1 else 5]:
            skipped = lambda a, b, e, k=k: not sp.alive(np.array([k]), a, b, e, dropout)[0]
            assert [m.pieces[i] for i in np.frombuffer(ids, np.int32).tolist()] == brute.merge_dropout(real, c, skipped)


def test_ids_do_not_depend_on_the_batch(monkeypatch):
    text = "some words  and more \n lines\nof\ntext " * 60
    want = sp.Encoder(sp.DEFAULT_MODEL, 0.3, 1).encode(["k", "j"], [text, "short one"])
    for size in (40, 333):
        monkeypatch.setattr(sp, "BATCH_CHARS", size)
        assert sp.Encoder(sp.DEFAULT_MODEL, 0.3, 1).encode(["k", "j"], [text, "short one"]) == want


@pytest.mark.parametrize("rounds", [1, 500])
def test_long_chunks_equal_the_agenda(monkeypatch, rounds):
    """Chunks of more than 64 characters: words run together, scripts without spaces, base64, runs and repeated patterns."""
    from tidemark.llm import sentencepiece_dropout as sd

    monkeypatch.setattr(sd, "ROUNDS", rounds)
    model = sd.load(sd.DEFAULT_MODEL)
    rng = random.Random(7)
    words = [p for p in model.ids if len(p) > 2 and "▁" not in p]
    kinds = [
        lambda n: "".join(rng.choice(words) for _ in range(n // 4)),
        lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n)),
        lambda n: "".join(rng.choice("ABCDefgh0123+/xyz") for _ in range(n)),
        lambda n: rng.choice(["x", "ab", "the", "=-", "aab", "1000", "=="]) * n,
        lambda n: "   " + "".join(rng.choice(["日本", "the", "😀", "é", "aaaa", "▁", "\x00"]) for _ in range(n)),
    ]
    for k in range(60):
        chunk = kinds[k % 5](rng.randint(65, 250))
        for dropout in (0.0, 0.1, 0.6):
            stream = np.array([k], dtype=np.uint64)
            word = int(sd.word_keys([chunk], stream, 3)[0])
            want = [b for s in sd.agenda(model, chunk, word, dropout) for b in ([s] if s >= 0 else model.byte_ids[list(chr(-1 - s).encode())].tolist())]
            got = np.frombuffer(sd.segment_chunks(model, ["a", chunk], np.array([0, k], dtype=np.uint64), 3, dropout)[1], dtype=np.int32).tolist()
            assert got == want, (k, dropout)


def test_words_outside_the_vocabulary_are_spelled_together(monkeypatch):
    """A block's words with foreign characters are spelled in one go, with the ids of the plain agenda."""
    m, calls, plain = sp.load(sp.DEFAULT_MODEL), [], sp.spelled
    monkeypatch.setattr(sp, "spelled", lambda *a: calls.append(1) or plain(*a))
    chunks = [f" {a}{b}ü\U00013000{c}" for a in "abcdefgh" for b in "klmnop" for c in "rstuv"]
    got = sp.segment_chunks(m, chunks, np.arange(len(chunks)), 7, 0.2)
    assert len(calls) == 1
    word = sp.word_keys(chunks, np.arange(len(chunks)), 7)
    for c, k, ids in zip(chunks, word.tolist(), got, strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == plain(m, np.array(sp.agenda(m, c, k, 0.2), dtype=np.int32)).tolist()


def test_frequent_words_stay_as_rare_ones_pass(monkeypatch):
    """Words that each batch has are merged without dropout once, however many others fill the cache."""
    seen, plain = [], sp.segment_chunks
    monkeypatch.setattr(sp, "segment_chunks", lambda m, chunks, *a: seen.extend(chunks if len(a) == 4 else []) or plain(m, chunks, *a))
    monkeypatch.setattr(sp, "KEEP_BYTES", 100_000)
    enc = sp.Encoder(sp.DEFAULT_MODEL, 0.1, 3)
    for k in range(40):
        enc.encode([k], ["often met words " + " ".join(f"rare{k}x{i}" for i in range(60))])
    assert seen.count(" often") == 1 and enc.kept_bytes < 101_000
