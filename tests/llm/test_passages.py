"""Repeated passages of lines and copies, planted in other contexts."""

import random

import pytest

from tidemark.llm import line_chunks


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def passages_gone(docs, least=50):
    """Text each document keeps if all lines in runs of ``least`` words of smaller ids go: by comparison of all runs."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        lines, runs = t.split("\n"), []
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if len(" ".join(lines[a : b + 1]).split()) >= least:
                    runs.append((a, b, "\n".join(lines[a : b + 1])))
        lost = {k for a, b, s in runs if s in seen for k in range(a, b + 1)}
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in lost)
        seen |= {s for *_, s in runs}
    return out


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_planted_passages_go_whole(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_chunks, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(line_chunks, "MIN_LINES", 10**6)  # passages alone
    rng = random.Random(5)
    docs = []
    for n_lines in (1, 2, 4, 8):
        for k in range(6):
            passage = "\n".join(prose(rng, 60 // n_lines + 1) for _ in range(n_lines))
            i = 100 * n_lines + 3 * k
            docs += [(i + j, "\n".join([prose(rng, 9), prose(rng, 5), passage, prose(rng, 7)])) for j in (0, 1)] + [(i + 2, passage)]
    got = {r["doc_id"]: r["text"] for r in line_chunks.report(spark.createDataFrame(docs, "doc_id long, text string"), 50).collect()}
    assert got == passages_gone(docs)
    assert all(got[i + 2 + 3 * k] == "" and len(got[i + 1 + 3 * k].split()) == 21 for i in (100, 200, 400, 800) for k in range(6))


def test_a_run_keeps_its_own_first_occurrence(spark):
    twice = "\n".join(["word"] * 120)
    df = spark.createDataFrame([(1, twice), (2, "\n\n" + twice), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_chunks.report(df, 50).collect()}
    assert len(got[1].split()) == 50 and not got[2].split() and got[3] is None and got[4] == ""


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_parts_of_a_common_chunk(spark, monkeypatch, broadcast):
    rng = random.Random(8)
    passage = "\n".join(prose(rng, 20) for _ in range(4))
    docs = [(i, "\n".join([prose(rng, 6), passage, prose(rng, 6)])) for i in range(60)] + [(100 + i, prose(rng, 12)) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r["doc_id"]: r["text"] for r in line_chunks.report(df, 50).collect()}
    monkeypatch.setattr(line_chunks, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(line_chunks, "BROADCAST_RUNS", broadcast)
    monkeypatch.setattr(line_chunks, "PART_ROWS", 7)
    got = {r["doc_id"]: r["text"] for r in line_chunks.report(df, 50).collect()}
    assert got == want and want[0] == docs[0][1] and all(len(want[i].split()) == 12 for i in range(1, 60))
