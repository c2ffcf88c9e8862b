"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary and scores come from a SentencePiece BPE model file with byte
fallback; the segmentation is this module's. A text is cut into chunks that no
merge can cross (a run of spaces with the word after it, or a line end). Within
a chunk the agenda holds the candidate merges; the best score goes first, then
the leftmost. Each candidate that comes up is skipped for good if a keyed hash
of (seed, stream, chunk, its borders) falls below ``dropout``. Every word
occurrence has a stream of its own, a 64-bit keyed hash of the document, its
copy number and the word's place, so each occurrence is varied anew, while
reruns agree. Without dropout the ids equal the library's.

The agenda runs for many chunks of like length at once, in numpy; a chunk of more
than 64 characters is first cut where no piece of the vocabulary could cross, and what
stays long merges many places at once. A dead
candidate is dead from the start, as its hash depends on nothing else. The merges
of a word without dropout are kept between batches; an occurrence for which they
all survive takes their outcome, as no other candidate ever comes first. Where
some of them are dead, the merges with just these dead are kept in the same way and
tried next, and so on, so occurrences that lose the same merges share one agenda.
Only words met once and what is lost by few occurrences run agendas of their own.

Defined cases: a null text stays null (no ids), an empty text has none; a
character outside the vocabulary, and a literal U+2581, becomes its UTF-8 bytes,
so every text decodes to itself; long texts are cut between chunks and handled
piece by piece, with the same ids as at once; equal rows with equal keys get equal ids. Columns other than the key
and the text are carried through where asked.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import mixed

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 11
SPACE = "▁"
CHUNK = re.compile(r" *[^ \n]+| +|\n")
BLANK, LINE = ord(" "), ord("\n")
#: Characters of text that are handled at once; ids do not depend on it.
BATCH_CHARS = 1 << 20
#: Bytes of words and their merges that a worker keeps between batches.
KEEP_BYTES = 96 << 20
#: Times that a word was met from which every set of merges that it loses is kept, and most times in a row that one is looked up.
OFTEN = 8
DEEP = 4
#: Symbols of the chunks whose agendas run at once.
BLOCK_SYMBOLS = 1 << 19
#: Candidates that are looked up at once.
LOOK = 1 << 15
#: Rounds of merges in long stretches before the rest goes through a queue.
ROUNDS = 500
DEAD = np.iinfo(np.int64).max
#: What stands at a place whose symbol has become part of the one before.
GONE = np.iinfo(np.int32).min
M1 = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Vocabulary tables of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        # equal scores share a rank, so that ties go to the leftmost
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        self.rank = np.zeros(n, dtype=np.int64)
        for i in plain:
            self.rank[i] = rank_of[sp.get_score(i)]
        self.out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.out[i] = bytes([b])
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.chars[ord(" ")] = self.chars[ord(SPACE)]
        self.chars[ord(SPACE)] = -1
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.n, self.pair_keys = n, keys
        self.pair_ids = np.array([pairs[k] for k in keys.tolist()], dtype=np.int32)
        # pairs of characters that stand side by side in some piece: no merge crosses any other border
        self.longest = max(map(len, self.ids), default=1)
        beside = {(ord(a) << 21) | ord(b) for p in self.ids for a, b in zip(p.replace(SPACE, " "), p.replace(SPACE, " ")[1:], strict=False)}
        self.beside = np.array(sorted(beside), dtype=np.int64)
        self.bits = 1 << 21
        # the last pair of each slot; pairs that share one are found by search
        slots = self._slot(keys)
        self.slot = np.full(self.bits, -1, dtype=np.int32)
        self.slot[slots] = np.arange(len(keys))
        self.shared = np.bincount(slots, minlength=self.bits) > 1
        #: The pieces' bytes side by side, and where each begins and how long it is.
        self.out_bytes = np.frombuffer(b"".join(self.out), dtype=np.uint8)
        self.out_n = np.array([len(x) for x in self.out], dtype=np.int64)
        self.out_at = np.cumsum(self.out_n) - self.out_n

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * M1) >> np.uint64(43)).view(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two symbols make, or -1; symbols outside the vocabulary are negative."""
        got = np.full(left.shape, -1, dtype=np.int32)
        keys = left.astype(np.int64) * self.n + right
        slot = self._slot(keys)
        at = self.slot[slot]
        may = np.flatnonzero((left >= 0) & (right >= 0) & (at >= 0))
        k, at = keys[may], at[may]
        many = np.flatnonzero(self.shared[slot[may]])
        at[many] = np.minimum(np.searchsorted(self.pair_keys, k[many]), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == k
        got[may[hit]] = self.pair_ids[at[hit]]
        return got


@cache
def load(path: str) -> Model:
    return Model(path)


def borders(start, mid, end) -> np.ndarray:
    """Hashes of candidates' places."""
    return mixed(((np.asarray(start, dtype=np.uint64) << np.uint64(42)) | (np.asarray(mid, dtype=np.uint64) << np.uint64(21)) | np.asarray(end, dtype=np.uint64)) + M1)


def survives(word: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    return mixed(word ^ place) >= np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))


def alive(word: np.ndarray, start, mid, end, dropout: float) -> np.ndarray:
    """Whether candidates survive; ``word`` is the keyed hash of seed, stream and chunk."""
    if dropout <= 0:
        return np.ones(np.shape(word), dtype=bool)
    return survives(word, borders(start, mid, end), dropout)


def agenda(model: Model, chunk: str, word: int, dropout: float) -> list[int]:
    """Segment one chunk with a priority queue; symbols outside the vocabulary are -1 - code point."""
    sym = [c if (c := int(model.chars[ord(x)])) >= 0 else -1 - ord(x) for x in chunk]
    n = len(sym)
    ids = np.array(sym, dtype=np.int32)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    queue: list[tuple[int, int, int, int, int]] = []

    def push(lefts: list[int]) -> None:
        if not lefts:
            return
        l = np.array(lefts)  # noqa: E741
        r = np.array([nxt[i] for i in lefts])
        got = model.merged(ids[l], ids[r])
        ok = got >= 0
        ok[ok] = alive(np.full(int(ok.sum()), word, dtype=np.uint64), l[ok], r[ok], np.array([end[i] for i in r[ok].tolist()]), dropout)
        for i, j, m in zip(l[ok].tolist(), r[ok].tolist(), got[ok].tolist(), strict=True):
            heapq.heappush(queue, (int(model.rank[m]), i, j, end[j], m))

    push(list(range(n - 1)))
    gone = [False] * n
    while queue:
        _, i, j, e, m = heapq.heappop(queue)
        if gone[i] or gone[j] or nxt[i] != j or end[j] != e:
            continue
        ids[i], gone[j], nxt[i], end[i] = m, True, nxt[j], e
        if nxt[i] < n:
            prv[nxt[i]] = i
        push(([prv[i]] if prv[i] >= 0 else []) + ([i] if nxt[i] < n else []))
    return [int(ids[i]) for i in range(n) if not gone[i]]


def _block(model: Model, codes: np.ndarray, word: np.ndarray, dropout: float, path: np.ndarray | None = None, offset: np.ndarray | None = None, dead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Agendas of many chunks of one length: symbols and how many of them each chunk keeps.

    ``path`` takes the hashes of the merged places in turn; ``offset`` is where each begins in a longer chunk;
    ``dead`` holds hashes of places that are not merged, one column or more a chunk.
    """
    n, size = codes.shape
    ids = model.chars[codes]
    ids = np.where(ids < 0, -1 - codes.astype(np.int32), ids)
    left = np.full(n, size)
    if size < 2:
        return ids, left
    # symbols stay at the place where they begin: ``nxt`` and ``prv`` are the symbols' ends and the symbols before them
    nxt = np.broadcast_to(np.arange(1, size + 2, dtype=np.int16), (n, size + 1)).copy()
    prv = np.broadcast_to(np.arange(-1, size, dtype=np.int16), (n, size + 1)).copy()
    shift = np.zeros(n, dtype=np.int64) if offset is None else offset
    never = np.iinfo(np.int32).max
    rank = np.full((n, size), never, dtype=np.int32)
    made = np.full((n, size), -1, dtype=np.int32)

    def look(rows, i, j):
        """Take the candidates of symbols ``i`` and ``j``, side by side, anew."""
        got = model.merged(ids[rows, i], ids[rows, j])
        ok = np.flatnonzero(got >= 0)
        r, a, b = rows[ok], i[ok], j[ok]
        if dropout > 0:
            live = alive(word[r], a + shift[r], b + shift[r], nxt[r, b] + shift[r], dropout)
            ok, r, a = ok[live], r[live], a[live]
        elif dead is not None:
            live = (borders(a, b, nxt[r, b])[:, None] != dead[r]).all(axis=1)
            ok, r, a = ok[live], r[live], a[live]
        rank[rows, i] = never
        rank[r, a], made[r, a] = model.rank[got[ok]], got[ok]

    rows, most = np.arange(n), max(1, LOOK // n)
    for a in range(0, size - 1, most):
        i = np.tile(np.arange(a, min(a + most, size - 1)), n)
        look(np.repeat(rows, len(i) // n), i, i + 1)
    while True:
        k = rank[rows]
        best = np.argmin(k, axis=1)  # the leftmost of the best
        some = k[np.arange(len(rows)), best] != never
        rows, best = rows[some], best[some]
        if not len(rows):
            break
        mid = nxt[rows, best].astype(np.int64)
        end = nxt[rows, mid].astype(np.int64)
        if path is not None:
            path[rows, size - left[rows]] = borders(best + shift[rows], mid + shift[rows], end + shift[rows])
        ids[rows, best], rank[rows, mid], ids[rows, mid] = made[rows, best], never, GONE
        nxt[rows, best], prv[rows, end] = end, best
        left[rows] -= 1
        rank[rows, best] = never
        on = np.flatnonzero(end < size)
        look(rows[on], best[on], end[on])
        before = prv[rows, best].astype(np.int64)
        on = np.flatnonzero(before >= 0)
        look(rows[on], before[on], best[on])
    r, c = np.nonzero(ids != GONE)
    out = np.zeros_like(ids)
    out[r, np.arange(len(r)) - np.repeat(np.cumsum(left) - left, left)] = ids[r, c]
    return out, left


def _window_least(key: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """The least key from ``back`` places before to ``ahead`` after each place."""
    width = back + ahead + 1
    low = np.concatenate([np.full(back, DEAD), key, np.full(ahead, DEAD)])
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(key)], low[width - span : width - span + len(key)])


def _line(model: Model, codes: np.ndarray, word: np.ndarray, offset: np.ndarray, last: np.ndarray, dropout: float) -> np.ndarray:
    """Agendas of long stretches that lie side by side: the symbol at each place, or DEAD where one goes on.

    ``offset`` is a place's distance from the start of its chunk, ``last`` tells the last place of a stretch.
    A candidate is merged as soon as none of a better rank lies within the longest piece around it, as
    whatever could take one of its symbols first would have to begin with such a one. Of those of one rank
    that overlap, every other one is merged, from the left. Only where a merge makes a candidate of its own
    rank or a better one, or where one of the same rank is undecided, does what lies to the right of it, one
    after the other without a wide gap, wait for the next round. So rounds merge many places of one stretch at once, with the outcome of the agenda; what
    is left after ``ROUNDS`` rounds goes through a queue.
    """
    n = len(codes)
    ids = model.chars[codes].astype(np.int64)
    ids = np.where(ids < 0, -1 - codes, ids)
    end = np.arange(1, n + 1)
    begin = np.arange(-1, n)  # where the symbol that ends at a place begins
    stop = np.concatenate([last, [True]])
    rank = np.full(n, DEAD)
    made = np.full(n, -1, dtype=np.int64)

    def merges(first, start, mid, second, stops):
        """Rank and piece of symbols side by side; DEAD where they do not merge."""
        r, m = np.full(len(start), DEAD), np.full(len(start), -1, dtype=np.int64)
        got = model.merged(first.astype(np.int32), second.astype(np.int32))
        ok = np.flatnonzero(got >= 0)
        shift = offset[start[ok]] - start[ok]
        ok = ok[alive(word[start[ok]], start[ok] + shift, mid[ok] + shift, stops[ok] + shift, dropout)]
        r[ok], m[ok] = model.rank[got[ok]], got[ok]
        return r, m

    def look(at: np.ndarray) -> None:
        """Take candidates (at, next symbol) anew."""
        rank[at] = DEAD
        at = at[~stop[end[at] - 1]]
        mid = end[at]
        rank[at], made[at] = merges(ids[at], at, mid, ids[mid], end[mid])

    def merge(at: np.ndarray) -> np.ndarray:
        """Merge candidates that do not overlap; the places whose candidates are new."""
        mid = end[at]
        ids[at], ids[mid], rank[mid] = made[at], DEAD, DEAD
        end[at] = end[mid]
        begin[end[at]] = at
        left = begin[at][(at > 0) & ~stop[np.maximum(at - 1, 0)]]
        new = np.unique(np.concatenate([at, left]))
        look(new)
        return new

    look(np.arange(n))
    reach = 2 * model.longest
    live = np.flatnonzero(rank != DEAD)
    for _ in range(ROUNDS):
        if not len(live):
            return ids
        best = rank == _window_least(rank, reach, reach)
        at = live[best[live]]
        joined = np.concatenate([[False], (at[1:] == end[at[:-1]]) & (rank[at[1:]] == rank[at[:-1]])])
        run = np.cumsum(~joined) - 1
        heads = at[~joined]
        before = begin[heads]
        known = ~((before >= 0) & (rank[np.maximum(before, 0)] == rank[heads]) & (end[np.maximum(before, 0)] == heads))
        nth = np.arange(len(at)) - np.flatnonzero(~joined)[run]
        waits = rank.copy()  # candidates that this round leaves undecided
        waits[at[known[run]]] = DEAD
        at = at[(nth % 2 == 0) & known[run]]
        blocked = _window_least(waits, reach, 0)[at] <= rank[at]
        # what the merges would make of their neighbours, from the left
        stops = end[end[at]]
        touching = np.concatenate([[False], at[1:] == stops[:-1]])
        start = np.where(touching, np.concatenate([[0], at[:-1]]), begin[at])
        inner = (at > 0) & ~stop[np.maximum(at - 1, 0)]
        start = np.maximum(start, 0)
        symbol = np.where(touching, np.concatenate([[0], made[at[:-1]]]), ids[start])
        lower = np.full(len(at), DEAD)
        lower[inner] = merges(symbol[inner], start[inner], at[inner], made[at][inner], stops[inner])[0]
        open_ = ~stop[stops - 1]
        upper = np.full(len(at), DEAD)
        o = stops[open_]
        upper[open_] = merges(made[at][open_], at[open_], o, ids[o], end[o])[0]
        upsets = np.minimum(lower, upper) <= rank[at]
        chain = np.cumsum(np.concatenate([[True], np.diff(at) > 2 * reach])) - 1 if len(at) else at
        barred = np.cumsum(upsets | blocked) - (upsets & ~blocked)
        first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]])) if len(at) else at
        merge(at[barred == (barred - blocked)[first][chain]])
        live = np.flatnonzero(rank != DEAD)
    queue = [(int(rank[p]), int(p), int(end[end[p]]), int(made[p])) for p in live.tolist()]
    heapq.heapify(queue)
    while queue:
        r, p, e, m = heapq.heappop(queue)
        if rank[p] == r and made[p] == m and end[end[p]] == e:
            for x in merge(np.array([p])).tolist():
                if rank[x] != DEAD:
                    heapq.heappush(queue, (int(rank[x]), x, int(end[end[x]]), int(made[x])))
    return ids


def _long_chunks(model: Model, chunks: list[str], word: np.ndarray, dropout: float) -> list[np.ndarray]:
    """Symbols of long chunks, cut where no piece of the vocabulary can cross."""
    codes = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    size = np.array([len(c) for c in chunks])
    base = np.cumsum(size) - size
    of = np.repeat(np.arange(len(chunks)), size)
    offset = np.arange(len(codes)) - base[of]
    pair = (codes[:-1] << 21) | codes[1:]
    found = np.minimum(np.searchsorted(model.beside, pair), max(len(model.beside) - 1, 0))
    ends = np.ones(len(codes), dtype=bool)
    if len(model.beside):
        ends[:-1] = (model.beside[found] != pair) | (of[1:] != of[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    length = np.diff(np.append(starts, len(codes)))
    out = np.full(len(codes), DEAD)
    for n in np.unique(length[length <= 64]).tolist():
        every = starts[length == n]
        for a in range(0, len(every), BLOCK_SYMBOLS // n):
            at = every[a : a + BLOCK_SYMBOLS // n]
            ids, left = _block(model, codes[at[:, None] + np.arange(n)], word[of[at]], dropout, offset=offset[at])
            r, c = np.nonzero(np.arange(n) < left[:, None])
            out[at[r] + c] = ids[r, c]
    far = np.repeat(length > 64, length)
    if far.any():
        out[far] = _line(model, codes[far], word[of[far]], offset[far], ends[far], dropout)
    return [x[x != DEAD] for x in np.split(out, base[1:])]


def keyed(h: np.ndarray, streams: np.ndarray, seed: int) -> np.ndarray:
    return mixed(h ^ mixed(streams.astype(np.uint64) + np.uint64(seed * int(M1) % 2**64)))


def word_keys(chunks: list[str], streams: np.ndarray, seed: int) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chunks), dtype=np.uint64, count=len(chunks))
    return keyed(h, streams, seed)


def spelled_width(syms: np.ndarray) -> np.ndarray:
    """How many ids each symbol takes: those outside the vocabulary take one for each UTF-8 byte."""
    code = np.where(syms < 0, -1 - syms, 0)
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def spelled(model: Model, syms: np.ndarray) -> np.ndarray:
    """Symbols outside the vocabulary as their UTF-8 bytes."""
    code = np.where(syms < 0, -1 - syms, 0)
    width = spelled_width(syms)
    at = np.cumsum(width) - width
    out = np.repeat(syms, width).astype(np.int32)
    for w in (1, 2, 3, 4):
        odd = np.flatnonzero((syms < 0) & (width == w))
        if not len(odd):
            continue
        c = code[odd]
        for j in range(w):
            bits = (c >> (6 * (w - 1 - j))) & 0x3F if j else c >> (6 * (w - 1))
            lead = 0x80 if j else {1: 0, 2: 0xC0, 3: 0xE0, 4: 0xF0}[w]
            out[at[odd] + j] = model.byte_ids[bits | lead]
    return out


def segment_chunks(model: Model, chunks: list[str], streams: np.ndarray, seed: int, dropout: float, take: Callable | None = None, dead: list[np.ndarray] | None = None) -> list[bytes]:
    """Ids of each chunk as int32 bytes.

    ``take`` gets those of chunks of at most 64 characters in blocks instead: which they are, ids and hashes of
    merges side by side, and how many of both each has. ``dead`` lists hashes of places for each that are not merged.
    """
    word = word_keys(chunks, streams, seed) if dropout > 0 else np.zeros(len(chunks), dtype=np.uint64)
    size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    out: list[bytes] = [b""] * len(chunks)

    def put(k: int, syms: np.ndarray) -> None:
        if (syms < 0).any():
            syms = spelled(model, syms)
        out[k] = syms.astype(np.int32).tobytes()

    far = np.flatnonzero(size > 64)
    if len(far):
        for k, syms in zip(far.tolist(), _long_chunks(model, [chunks[k] for k in far.tolist()], word[far], dropout), strict=True):
            put(k, syms)
    for n in np.unique(size[size <= 64]).tolist():
        at = np.flatnonzero(size == n)
        if len(at) < 2 and take is None:
            for k in at.tolist():
                put(k, np.array(agenda(model, chunks[k], int(word[k]), dropout), dtype=np.int32))
            continue
        step = BLOCK_SYMBOLS // n
        for a in range(0, len(at), step):
            part = at[a : a + step]
            some = part.tolist()
            codes = np.frombuffer("".join([chunks[k] for k in some]).encode("utf-32-le"), dtype=np.uint32).reshape(len(part), n).astype(np.int64)
            path, gone = None if take is None else np.zeros((len(part), n), dtype=np.uint64), None
            if dead is not None:
                mine = [dead[k] for k in some]
                many = np.fromiter(map(len, mine), dtype=np.int64, count=len(mine))
                gone = np.zeros((len(part), many.max()), dtype=np.uint64)
                gone[np.arange(gone.shape[1]) < many[:, None]] = np.concatenate(mine)
            ids, left = _block(model, codes, word[part], dropout, path, dead=gone)
            flat, size_of = ids[np.arange(n) < left[:, None]], left
            if (flat < 0).any():
                size_of = np.add.reduceat(spelled_width(flat), np.cumsum(left) - left)
                flat = spelled(model, flat)
            if take is not None:
                take(part, flat, size_of, path[np.arange(n) < (n - left)[:, None]], n - left)
                continue
            raw, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(size_of)).tolist()
            for k, lo, hi in zip(some, [0, *ends], ends, strict=False):
                out[k] = raw[lo:hi]
    return out


def _slices(text: str) -> Iterator[str]:
    """A long text in pieces, cut only where no chunk goes on: at a line end or before a space that follows a word."""
    at = 0
    while len(text) - at > BATCH_CHARS:
        cut = at + BATCH_CHARS
        while cut < len(text) and not (text[cut] == "\n" or (text[cut] == " " and text[cut - 1] != " ")):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Codes(dict):
    """Numbers for strings, in order of first sight, and the strings."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self.names)
        self.names.append(key)
        return n


class _Pool:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.empty(16, dtype=kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.all, np.empty(max(len(values), self.n // 2), dtype=self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class _Kept:
    """Words by number, and outcomes: a word's ids and merges when certain of its places are dead."""

    def __init__(self, model: Model):
        self.model = model
        self.numbers = _Codes()
        #: For each word: hash, length, times met, and its outcome with no place dead, or -1.
        self.hash, self.size, self.met, self.root = _Pool(np.uint64), _Pool(np.int32), _Pool(np.int64), _Pool(np.int32)
        #: Ids and merges of all outcomes, where each outcome's begin, and how many they are.
        self.ids, self.path = _Pool(np.int32), _Pool(np.uint64)
        self.ids_at, self.ids_n, self.path_at, self.path_n = _Pool(np.int64), _Pool(np.int32), _Pool(np.int64), _Pool(np.int32)
        #: (outcome, bits of its merges that are dead, too) -> outcome; and the dead places of each that has some.
        self.next: dict[tuple[int, int], int] = {}
        self.dead: dict[int, np.ndarray] = {}

    def nbytes(self) -> int:
        pools = (self.hash, self.size, self.met, self.root, self.ids, self.path, self.ids_at, self.ids_n, self.path_at, self.path_n)
        return sum(p.held.nbytes for p in pools) + 160 * len(self.numbers) + 400 * len(self.next)

    def without_rare(self, most: int) -> _Kept:
        """The words met most often with their outcomes with no place dead, in about ``most`` bytes; they count half."""
        out, root = _Kept(self.model), self.root.all
        by = np.flatnonzero(root >= 0)
        by = by[np.argsort(-self.met.all[by], kind="stable")]
        each = 250 + 6 * self.ids_n.all[root[by]] + 12 * self.path_n.all[root[by]]
        by = by[np.cumsum(each, dtype=np.int64) <= most]
        for k in by.tolist():
            out.numbers[self.numbers.names[k]]  # numbered anew
        out.hash.add(self.hash.all[by])
        out.size.add(self.size.all[by])
        out.met.add(self.met.all[by] // 2)
        out.root.add(np.arange(len(by)))
        for (a, at, n), (b, at_, n_) in (((out.ids, out.ids_at, out.ids_n), (self.ids, self.ids_at, self.ids_n)), ((out.path, out.path_at, out.path_n), (self.path, self.path_at, self.path_n))):
            first, many = at_.all[root[by]], n_.all[root[by]]
            after = np.cumsum(many, dtype=np.int64)
            a.add(b.all[np.repeat(first - after + many, many) + np.arange(many.sum())])
            at.add(after - many)
            n.add(many)
        return out

    def code(self, names: list[str], met: np.ndarray) -> np.ndarray:
        """The numbers of different words, which are counted as met so often."""
        code = np.fromiter(map(self.numbers.__getitem__, names), dtype=np.int64, count=len(names))
        new = self.numbers.names[self.hash.n :]
        self.hash.add(np.fromiter(map(xxhash.xxh3_64_intdigest, new), dtype=np.uint64, count=len(new)))
        self.size.add(np.fromiter(map(len, new), dtype=np.int32, count=len(new)))
        self.met.add(np.zeros(len(new), dtype=np.int64))
        self.root.add(np.full(len(new), -1, dtype=np.int32))
        self.met.all[code] += met
        return code

    def outcomes(self, words: np.ndarray, *dead: list[np.ndarray]) -> np.ndarray:
        """New outcomes of words of at most 64 characters; ``dead`` lists dead places for each, if there are some."""
        out = np.empty(len(words), dtype=np.int32)

        def take(part, flat, ids_n, path, path_n):
            out[part] = self.ids_at.n + np.arange(len(part))
            for pool, begin, number, values, many in ((self.ids, self.ids_at, self.ids_n, flat, ids_n), (self.path, self.path_at, self.path_n, path, path_n)):
                begin.add(pool.n + np.cumsum(many) - many)
                number.add(many)
                pool.add(values)

        names = self.numbers.names
        segment_chunks(self.model, [names[k] for k in words.tolist()], np.zeros(len(words)), 0, 0.0, take, *dead)
        return out

    def roots(self, code: np.ndarray, least: int) -> np.ndarray:
        """The outcomes of words with no place dead; -1 for those met less often, or too long."""
        used = np.unique(code)
        new = used[(self.root.all[used] < 0) & (self.size.all[used] <= 64) & (self.met.all[used] >= least)]
        self.root.all[new] = self.outcomes(new)
        return self.root.all[code]

    def vary(self, code: np.ndarray, stream: np.ndarray, seed: int, dropout: float) -> np.ndarray:
        """The outcome of each occurrence, or -1 where it needs an agenda of its own."""
        at = self.roots(code, 2)
        key = keyed(self.hash.all[code], stream, seed)
        live = np.flatnonzero(at >= 0)
        for depth in range(DEEP):
            # the merges of its outcome that are dead for an occurrence
            first, many = self.path_at.all[at[live]], self.path_n.all[at[live]]
            lost = np.zeros(len(live), dtype=np.uint64)
            on, step = np.flatnonzero(many > 0), 0
            while len(on):
                ok = survives(key[live[on]], self.path.all[first[on] + step], dropout)
                lost[on[~ok]] |= np.uint64(1 << step)
                step += 1
                on = on[many[on] > step]
            some = np.flatnonzero(lost)
            live, lost = live[some], lost[some]
            if not len(live):
                break
            if depth == DEEP - 1:
                at[live] = -1
                break
            by = np.lexsort((lost, at[live]))
            live, lost = live[by], lost[by]
            now = at[live]
            head = np.flatnonzero(np.concatenate([[True], (now[1:] != now[:-1]) | (lost[1:] != lost[:-1])]))
            count = np.diff(np.append(head, len(live)))
            word = code[live[head]]
            pairs = list(zip(now[head].tolist(), lost[head].tolist(), strict=True))
            then = np.fromiter((self.next.get(x, -1) for x in pairs), dtype=np.int32, count=len(pairs))
            new = np.flatnonzero((then < 0) & ((count > 1) | (self.met.all[word] >= OFTEN)))
            if len(new):
                dead = [self._lost(*pairs[k]) for k in new.tolist()]
                then[new] = self.outcomes(word[new], dead)
                for k, n, x in zip(new.tolist(), then[new].tolist(), dead, strict=True):
                    self.next[pairs[k]], self.dead[n] = n, x
            at[live] = np.repeat(then, count)
            live = live[at[live] >= 0]
        return at

    def _lost(self, outcome: int, lost: int) -> np.ndarray:
        """The dead places of an outcome with some of its merges."""
        first = int(self.path_at.held[outcome])
        more = self.path.held[[first + k for k in range(lost.bit_length()) if lost >> k & 1]]
        return np.concatenate([self.dead[outcome], more]) if outcome in self.dead else more


class Encoder:
    """``streams`` bounds the segmentations that a word can have; None sets no bound."""

    def __init__(self, path: str, dropout: float, seed: int, streams: int | None = None):
        self.model, self.dropout, self.seed, self.streams = load(path), dropout, seed, streams
        self.kept = _Kept(self.model)

    def encode(self, keys: list, texts: list[str | None]) -> list[bytes | None]:
        """int32 ids of each text; ``keys`` choose the streams."""
        out: list[bytes | None] = [None] * len(texts)
        group: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if t is None:
                continue
            if len(t) > BATCH_CHARS:
                out[i] = self._long(keys[i], t)
                continue
            if chars + len(t) > BATCH_CHARS:
                self._into(out, group, keys, texts)
                group, chars = [], 0
            group.append(i)
            chars += len(t)
        self._into(out, group, keys, texts)
        return out

    def _long(self, key, text: str) -> bytes:
        """A long text piece by piece; words keep their places in the whole."""
        done, place = [], 0
        for k, piece in enumerate(_slices(text)):
            ids, n = self._batch([key], [piece if k else " " + piece], place)
            done += ids
            place += n
        return b"".join(done)

    def _into(self, out: list, group: list[int], keys: list, texts: list) -> None:
        for i, b in zip(group, self._batch([keys[i] for i in group], [" " + texts[i] if texts[i] else "" for i in group])[0], strict=True):
            out[i] = b

    def _batch(self, keys: list, texts: list[str], first: int = 0) -> tuple[list[bytes], int]:
        """Ids of each text, whose words' places count from ``first``, and the number of words."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if not len(data):
            return [b""] * len(texts), 0
        # a chunk begins with a text, at and after a line end, and at a space that follows none
        blank, line = data == BLANK, data == LINE
        begins = line.copy()
        begins[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        after = np.cumsum([len(x) for x in raw])
        begins[[0, *after[after < len(data)].tolist()]] = True
        begins = np.flatnonzero(begins)
        ends = np.searchsorted(begins, after)
        spans = np.append(begins, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(spans), pa.py_buffer(data)]).dictionary_encode()
        names, nth = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        if self.kept_bytes > 3 * KEEP_BYTES // 4:
            self.kept = self.kept.without_rare(KEEP_BYTES // 4)
        kept, code = self.kept, self.kept.code(names, np.bincount(nth))[nth]
        stream = np.zeros(len(nth), dtype=np.uint64)
        if self.dropout > 0:
            sizes = np.diff(ends, prepend=0)
            doc = np.repeat(np.fromiter((xxhash.xxh3_64_intdigest(str(k), seed=self.seed & (2**63 - 1)) for k in keys), dtype=np.uint64, count=len(keys)), sizes)
            place = first + np.arange(len(nth)) - np.repeat(ends - sizes, sizes)
            stream = mixed(doc ^ (place.astype(np.uint64) * M1))
            if self.streams:
                stream %= np.uint64(self.streams)
            at = kept.vary(code, stream, self.seed, self.dropout)
        else:
            at = kept.roots(code, 1)
        alone = np.flatnonzero(at < 0)
        own = segment_chunks(self.model, [names[k] for k in nth[alone].tolist()], stream[alone], self.seed, self.dropout)
        # ids of outcomes, and after these those of occurrences on their own
        pool = np.concatenate([kept.ids.all, np.frombuffer(b"".join(own), dtype=np.int32)])
        start, size = (np.append(x.all, 0)[at] for x in (kept.ids_at, kept.ids_n))
        size[alone] = many = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        start[alone] = kept.ids.n + np.cumsum(many) - many
        after = np.cumsum(size, dtype=np.int64)
        flat = pool[np.repeat(start - after + size, size) + np.arange(after[-1])]
        edges = [0, *np.append(0, after)[ends].tolist()]
        return [flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], len(nth)

    @property
    def kept_bytes(self) -> int:
        return self.kept.nbytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the space that encoding puts in front."""
        if not len(ids):
            return ""
        n = self.model.out_n[ids]
        after = np.cumsum(n)
        raw = self.model.out_bytes[np.repeat(self.model.out_at[ids] - after + n, n) + np.arange(after[-1])].tobytes().decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL, dropout: float = DROPOUT, seed: int = SEED, streams: int | None = None) -> DataFrame:
    """``docs``' key and ``ids``, an array of int; null for a null text."""

    def run(batches):
        enc = Encoder(model, dropout, seed, streams)
        for b in _small(batches):
            got = enc.encode(b.column("k").to_pylist(), b.column("t").to_pylist())
            ids = pa.array([None if x is None else np.frombuffer(x, np.int32) for x in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("k"), ids], ["k", "ids"])

    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded``'s key and ``text``."""

    def run(batches):
        enc = Encoder(model, 0.0, 0, 1)
        for b in batches:
            texts = [None if x is None else enc.decode(np.array(x, dtype=np.int64)) for x in b.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(texts, pa.string())], ["k", "text"])

    kind = encoded.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()
    return encoded.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def _small(batches, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text, or one row."""
    for b in batches:
        size = np.diff(np.frombuffer(b.column("t").buffers()[1], dtype=np.int32, count=b.num_rows + 1 + b.column("t").offset)[b.column("t").offset :]) if b.num_rows else np.array([])
        at, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > most:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)


def segment(docs: DataFrame, model: str = DEFAULT_MODEL, dropout: float = DROPOUT, seed: int = SEED, streams: int | None = None, with_ids: bool = False, copy: str | None = None) -> DataFrame:
    """Encode, decode and compare every whole text in one pass.

    doc_id, n_tokens, ids_xxh128 (of the little-endian int32 ids), decodes (the
    decoded text equals the input) and, if asked, the ids. ``copy`` names a column
    that numbers the copies of a document from 1, each of which is varied anew.
    """

    def run(batches):
        enc = Encoder(model, dropout, seed, streams)
        for b in _small(batches):
            texts = b.column("t").to_pylist()
            got = enc.encode([k if c == 1 else f"{k}#{c}" for k, c in zip(b.column("k").to_pylist(), b.column("c").to_pylist(), strict=True)], texts)
            ids = [None if x is None else np.frombuffer(x, np.int32) for x in got]
            cols = [
                b.column("k"),
                pa.array([None if x is None else len(x) for x in ids], pa.int64()),
                pa.array([None if x is None else xxhash.xxh3_128_hexdigest(x) for x in got], pa.string()),
                pa.array([None if x is None else enc.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "ids_xxh128", "decodes"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, n_tokens bigint, ids_xxh128 string, decodes boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), (F.col(copy) if copy else F.lit(1)).alias("c")).mapInArrow(run, schema)
