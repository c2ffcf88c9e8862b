"""Brute-force versions in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def roots(docs, width=5, percent=75):
    """A number for each row's group, in order."""
    sets = [shingles(t, width) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(docs))]


def components(docs, width=5, percent=75):
    """(n_shingles, least doc_id reachable) for each row, in order."""
    sets, root, out = [shingles(t, width) for _, t in docs], roots(docs, width, percent), []
    for i in range(len(docs)):
        ids = [docs[j][0] for j in range(len(docs)) if root[j] == root[i] and docs[j][0] is not None]
        out.append((len(sets[i]), (min(ids) if ids else None) if sets[i] else docs[i][0]))
    return out


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def spans(docs):
    """n_bytes, n_removed, n_spans and hash of each row for 50-byte strings of smaller ids."""
    first = {}
    data = [(10**18 if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for j in range(len(b) - 49):
            s = b[j : j + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def chunks(text):
    def h(b):
        return xxhash.xxh64_intdigest(b, seed=42)

    lines, out, at = text.split("\n"), [], 0
    hs = [h(x.encode()) for x in lines]
    for i in range(len(lines)):
        before = hs[i - 1] if i else 0
        rolled = hs[i] ^ (((before << 1) | (before >> 63)) & (2**64 - 1))
        end = h(rolled.to_bytes(8, "little"))
        if i == len(lines) - 1 or (end - 2**64 if end >= 2**63 else end) % 3 == 0:
            out.append(lines[at : i + 1])
            at = i + 1
    return out


def line_dedup(docs):
    """The text each row keeps; rows in order of (id, null last, Spark's text hash)."""

    def key(d):
        h = 42 if d[1] is None else xxhash.xxh64_intdigest(d[1].encode(), seed=42)
        return (d[0] is None, d[0] or 0, h - 2**64 if h >= 2**63 else h)

    first, kept = {}, {}
    for d in sorted(set(docs), key=key):
        if d[1] is None:
            kept[d] = None
            continue
        left = []
        for k, c in enumerate(chunks(d[1])):
            s = "\n".join(c)
            if len(c) >= 2 and WORD.search(s) and first.setdefault(s, (d, k)) != (d, k):
                continue
            left.append(s)
        kept[d] = "\n".join(left)
    return [kept[d] for d in docs]


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def piece_scores(sp):
    """Scores of the real pieces of a SentencePiece processor."""
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}


def merge_dropout(real, chunk, skipped):
    """Pieces of one chunk: the best mergeable pair of neighbours that is not skipped is merged, over and over.

    ``skipped(start, mid, end)`` says whether a candidate's merge is skipped.
    """
    parts = list(chunk.replace(" ", "▁"))
    while True:
        best, at = None, 0
        for k in range(len(parts) - 1):
            score = real.get(parts[k] + parts[k + 1])
            end = at + len(parts[k]) + len(parts[k + 1])
            if score is not None and (best is None or score > best[0]) and not skipped(at, at + len(parts[k]), end):
                best = score, k
            at += len(parts[k])
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
