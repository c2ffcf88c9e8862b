"""What the n-gram join holds beside the heap: Arrow batches, and the arrays that texts are hashed in."""

import tracemalloc

import numpy as np

from tidemark.llm import ngram_jaccard as nj
from tidemark.llm.common import BATCH, BATCH_BYTES
from tidemark.llm.shingles import sets


def test_the_sketch_reads_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d e f{i}") for i in range(20)], "doc_id bigint, text string")
    seen, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: (seen.append(spark.conf.get(BATCH, "64m")), collect(self))[1])
    assert nj._sketch(docs).sum() == 40  # two shingles each, one of them in all
    assert seen == [BATCH_BYTES] and int(BATCH_BYTES.rstrip("m")) <= 2


def test_texts_are_hashed_in_little_memory():
    words = np.random.default_rng(1).integers(0, 9999, 200_000).astype("S5")
    texts = [b" ".join(words[a : a + 300].tolist()) for a in range(0, len(words), 300)]
    first = [s.tobytes() for s in sets(texts[:3])]  # and the powers
    tracemalloc.start()
    n = sum(len(s) for s in sets(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 << 20 and n > 190_000
    assert [s.tobytes() for t in texts[:3] for s in sets([t])] == first
