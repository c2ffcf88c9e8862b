"""Conversation repair, centroid clustering and circulant MinHash against brute force, on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import audit_dp, centroids, circulant_minhash, turn_repair

TURNS = "conv_id long, turn long, role string, text string, audit string, cost string, place long"
LETTERS = {"K": 0, "R": 3, "D": 4, "I": 3}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else "".join(k for k in x if k not in ".!?") if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, hash) of ordered (role, text) rows: whole strings of every state, all compared."""
    seen, faults = set(), []
    for r, x in rows:
        ink = x.rstrip(" \t\n\x0b\x0c\r").lstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not ink else "duplicate" if (r, x) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((r, x))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(0, ""): (0, "", ())}  # (rows read, last initial): cost, audit, repaired
    for i in range(len(rows) + 1):
        for _ in range(3):  # insertions
            for (j, s), (cost, audit, done) in list(best.items()):
                if j == i:
                    for role in ("user", "assistant"):
                        if (s, role[0]) in step:
                            new = cost + 3, audit + "I", (*done, role + ":")
                            at = (i, step[s, role[0]])
                            best[at] = min(best.get(at, new), new)
        if i == len(rows):
            break
        (r, x), fault = rows[i], faults[i]
        for (j, s), (cost, audit, done) in list(best.items()):
            if j != i:
                continue
            moves = [(4, "D", s, None)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (s, r[:1]) in step and r:
                    moves.append((more, "K", step[s, r[:1]], f"{r}:{x}"))
                for role in ("user", "assistant"):
                    if (s, role[0]) in step:
                        moves.append((3 + more, "R", role[0], f"{role}:{x}"))
            for c, letter, to, row in moves:
                new = cost + c, audit + letter, done if row is None else (*done, row)
                best[i + 1, to] = min(best.get((i + 1, to), new), new)
    cost, audit, done = min(v for (j, s), v in best.items() if j == len(rows) and s in ("", "a"))
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    count = Counter(faults)
    return count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()


def order(row):
    c, t, r, x = row
    return (t is not None, t or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest())


def want(rows):
    out = {}
    left = damage(rows)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == c), key=order)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *repair([(r[2], r[3]) for r in mine]))
    return out


def made_turns(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "u", "sage"]
    texts = ["Yes.", "No", "Why?", " \t", "", None, "Go on!", "a b c", "x. \n", "日本。"]
    return [(rng.randrange(n // 6), rng.choice([None, *range(9)]), rng.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(10**6)}.") for _ in range(n)]


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], TURNS)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in turn_repair.report(df, turn_repair.damaged(df)).collect()}


@pytest.mark.parametrize("segment", [1, 2048])
def test_repair_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    rng = random.Random(4)
    rows = made_turns(rng, 600) + [(None, 1, "user", "Hm?"), (None, 2, "assistant", "Ah."), (None, None, None, None)]
    rows += [(7000, k, "user" if k % 2 else "assistant", "Long " * 40_000 + ".") for k in range(6)]
    rows += [(8000, k, rng.choice(["user", "assistant", "system"]), f"Turn {k // 3}{rng.choice('.?x')}") for k in range(300)]
    lone = [c for c in range(9000, 9100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:1]
    rows += [(c, 0, "user", "Gone.") for c in lone]
    rows += rows[:20]
    found = got(spark, rows)
    assert found == want(rows)
    assert lone and found[lone[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repair_of_nothing(spark):
    assert got(spark, []) == {}


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "One?"), (1, 1, "user", "Two."), (1, 2, "assistant", "Three"), (2, 0, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = turn_repair.cleaned(df)
    turns = turn_repair.repaired(plain, turn_repair.audits(plain)).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["turn"], r["edit"], r["role"], r["text"]) for r in turns] == [
        (1, 0, "K", "user", "One?"), (1, None, "I", "assistant", ""), (1, 1, "K", "user", "Two."), (1, 2, "K", "assistant", "Three"),
        (2, None, "I", "user", ""), (2, 0, "K", "assistant", "Hi."),
    ]


@pytest.mark.parametrize("modulus", [3, audit_dp.MODULUS])
def test_audits_survive_hash_collisions(monkeypatch, modulus):
    monkeypatch.setattr(audit_dp, "MODULUS", modulus)
    rng = random.Random(5)
    names = {"s": "system", "u": "user", "a": "assistant", ".": "tool"}
    for _ in range(300):
        codes = [(rng.choice("suuaaa."), rng.choice("---tx")) for _ in range(rng.randrange(14))]
        rows = [(names[i], " " if f == "x" else f"{k}" + ("." if f == "-" else "")) for k, (i, f) in enumerate(codes)]
        cut = rng.randrange(len(codes) + 1)
        fold = audit_dp.Fold()
        for part in (codes[:cut], codes[cut:]):
            text = "".join(i + f for i, f in part)
            fold.add({s: audit_dp.segment(text, s) for s in audit_dp.STATES})
        assert fold.result() == repair(rows)[4:6]


def test_audits_share_prefixes():
    node = audit_dp.Node()
    for k in range(1000):
        node = audit_dp.Node("KD"[k % 2], node)
    a, b = audit_dp.Node("I", node), audit_dp.Node("K", node)
    assert audit_dp.less(a, b) and not audit_dp.less(b, a) and audit_dp.less(node, a)
    assert node.above(0).depth == 0 and len(node.up) == 10


def kmeans(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept))
    c = [list(v) for _, _, v in start[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, z, strict=True)), j) for j, z in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    name = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in c]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), name[j]) for i, d, j in last)


VECTORS = "vec_id long, embedding array<float>, cluster string, x int, distance string"


@pytest.mark.parametrize("n", [0, 5, 400])
def test_clusters_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    vector = lambda: [float(np.float32(x)) for x in rng.normal(size=64) * 0.2]
    rows = [(i, vector()) for i in range(n)]
    if n > 5:
        rows += rows[:60] + [(i + 1000, rows[0][1]) for i in range(100)] + [(2000, [0.0] * 64), (None, vector()), (0, vector())]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [None] * 64), (3004, [math.nan] * 64), (3005, [math.inf] * 64), (3006, [1.0] * 65)]
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], VECTORS)
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert Counter(tuple(r[c] for c in names) for r in centroids.report(df).collect()) == kmeans(rows)


def test_moves_touch_only_changed_components():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (30, 64))
    before = rng.integers(-50, 50, (16, 64))
    after = before.copy()
    after[3, 5] += 7
    after[9, :4] -= 2
    dots = x @ before.T
    for c in range(16):
        at = np.flatnonzero(after[c] != before[c])
        dots[:, c] += x[:, at] @ (after[c] - before[c])[at]
    assert (dots == x @ after.T).all()


def minhash(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in circulant_minhash.link(df).collect())


def wanted(docs):
    return Counter((i, n, c, i == c) for (i, _), (n, c) in zip(docs, brute.components(docs, 3, 85), strict=True))


def test_minhash_components(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert minhash(odd_docs) == wanted(docs)
    assert circulant_minhash.link(no_docs).count() == 0


def test_minhash_of_template_families(spark, monkeypatch):
    """Families of texts around the threshold; small blocks, so that buckets span several."""
    monkeypatch.setattr(circulant_minhash, "BLOCK", 4)
    rng = random.Random(8)
    docs = []
    for f in range(6):
        base = [f"f{f}w{k}" for k in range(90)]
        for _ in range(60):
            text = list(base)
            for _ in range(rng.randrange(6)):
                text[rng.randrange(90)] = f"z{rng.randrange(40)}"
            docs.append((len(docs), " ".join(text)))
    docs += [(1000 + k, " ".join(f"t{j}" for j in range(3 * k, 3 * k + 100))) for k in range(30)]
    want = wanted(docs)
    assert 60 < len({c for _, _, c, _ in want}) < 360
    assert minhash(spark.createDataFrame(docs, "doc_id long, text string")) == want


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 2**63, 700, dtype=np.uint64)
    a, b = np.concatenate([both, rng.integers(0, 2**63, 150, dtype=np.uint64)]), np.concatenate([both, rng.integers(0, 2**63, 150, dtype=np.uint64)])
    s = circulant_minhash.signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 0.7) < 0.09
    y = circulant_minhash.mixed(a ^ circulant_minhash.SIGMA)
    assert len(np.unique(y)) == len(a)  # a permutation
    keys = circulant_minhash.band_keys(s)
    assert keys.shape == (2, circulant_minhash.BANDS) and len(np.unique(keys[0])) == circulant_minhash.BANDS


def test_long_words_and_texts_beyond_a_slice(spark, monkeypatch):
    from tidemark.llm import shingles

    monkeypatch.setattr(shingles, "SLICE", 64)
    monkeypatch.setattr(shingles, "_POWERS", [])
    texts = [" ".join(f"word{k}" for k in range(60)), "y" * 500, "one " + "z" * 200 + " two three four", "a b"]
    small = [s.tolist() for s in shingles.sets([t.encode() for t in texts], 3)]
    assert [len(s) for s in small] == [58, 1, 3, 1]
    assert small == [s.tolist() for s in shingles.sets([t.encode() for t in texts], 3)]
    changed = texts[0].replace("word30", "other")
    assert len(set(small[0]) & set(next(iter(shingles.sets([changed.encode()], 3))).tolist())) == 55
