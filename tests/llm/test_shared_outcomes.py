"""Occurrences of a word that lose the same merges share one agenda."""

import random

import numpy as np

from tidemark.llm import sentencepiece_dropout as sp


def plain(m, key: str, text: str, seed: int, dropout: float) -> list[int]:
    """Every occurrence in an agenda of its own, chunks cut by the pattern."""
    chunks = sp.CHUNK.findall(" " + text if text else "")
    doc = np.uint64(sp.xxhash.xxh3_64_intdigest(key, seed=seed))
    stream = sp.mixed(doc ^ (np.arange(len(chunks)).astype(np.uint64) * sp.M1))
    syms = [s for c, k in zip(chunks, sp.word_keys(chunks, stream, seed).tolist(), strict=True) for s in sp.agenda(m, c, k, dropout)]
    return sp.spelled(m, np.array(syms, dtype=np.int64)).tolist()


def test_frequent_words_need_few_agendas(monkeypatch):
    rows, block = [], sp._block
    monkeypatch.setattr(sp, "_block", lambda m, codes, *a, **k: rows.append(len(codes)) or block(m, codes, *a, **k))
    text = "international understanding " * 2000
    enc = sp.Encoder(sp.DEFAULT_MODEL, 0.1, 7)
    for key in ("1", "2", "3"):
        got = np.frombuffer(enc.encode([key], [text])[0], np.int32).tolist()
        if key == "3":
            assert got == plain(enc.model, key, text, 7, 0.1)
    assert sum(rows) < 4000  # of 12,000 occurrences, most of which lose a merge


def test_outcomes_equal_agendas_on_odd_texts(monkeypatch):
    rng = random.Random(5)
    words = ["the", "understanding", "naïve", "\U00013000x", "  ", "\n", "\n\n", "▁", "a" * 63, "b" * 80, "tion,", "\t", "\r", "日本語の", " \n "]
    texts = ["", " ", "\n", "  a", "a  \n  b ", *("".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 120))) for _ in range(40))]
    for dropout in (0.0, 0.1, 0.6):
        enc = sp.Encoder(sp.DEFAULT_MODEL, dropout, 7)
        for _ in range(3):  # with nothing kept, and with all
            got = enc.encode([str(k) for k in range(len(texts))], texts)
            assert [np.frombuffer(x, np.int32).tolist() for x in got] == [plain(enc.model, str(k), t, 7, dropout) for k, t in enumerate(texts)]
            assert [enc.decode(np.frombuffer(x, np.int32)) for x in got] == texts
        monkeypatch.setattr(sp, "KEEP_BYTES", 4000)
