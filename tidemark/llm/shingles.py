"""Word shingle sets of texts, as 64-bit hashes computed in numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes that are hashed at once; some 30 times as many are held.
SLICE = 1 << 18
WIDTH = 5
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE_BYTES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE_VALUES[SPACE_BYTES] = 0
WORD_FACTORS = mixed(np.arange(1001, 1001 + WIDTH, dtype=np.uint64)) | np.uint64(1)
SHORT_SALTS = mixed(np.arange(2001, 2001 + WIDTH, dtype=np.uint64))
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS:
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(SLICE + 1, b, dtype=np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of at most SLICE bytes."""
    a = np.frombuffer(data, dtype=np.uint8)
    word = ~SPACE_BYTES[a]
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if len(a) and word[0]:
        first = np.concatenate([[0], first])
    if not len(first):
        return np.empty(0, np.uint64), first
    up, down = _powers()
    s = BYTE_VALUES[a]
    s *= up[: len(a)]
    return mixed(np.add.reduceat(s, first) * down[first]), first


def _long_words(data: bytes) -> np.ndarray:
    """Word hashes of a text of any length; a word beyond SLICE bytes is hashed whole."""
    import xxhash

    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            cut = end
            while cut > at and not SPACE_BYTES[data[cut - 1]]:
                cut -= 1
            if cut == at:  # one word fills the slice
                while end < len(data) and not SPACE_BYTES[data[end]]:
                    end += 1
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], dtype=np.uint64))
                at = end
                continue
            end = cut
        out.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _set(w: np.ndarray, width: int) -> np.ndarray:
    n = len(w)
    if not n:
        return w
    if n < width:
        return mixed(np.array([int((w * WORD_FACTORS[:n]).sum(dtype=np.uint64))], dtype=np.uint64) ^ SHORT_SALTS[n])
    h = w[: n - width + 1] * WORD_FACTORS[0]
    for i in range(1, width):
        h = h + w[i : n - width + 1 + i] * WORD_FACTORS[i]
    return np.unique(mixed(h))


def sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words (WIDTH at most)."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        t = t.translate(LOWER)
        if group and size + len(t) + 1 > SLICE:
            yield from _grouped(group, width)
            group, size = [], 0
        if len(t) >= SLICE:
            yield _set(_long_words(t), width)
            continue
        group.append(t)
        size += len(t) + 1
    yield from _grouped(group, width)


def _grouped(group: list[bytes], width: int) -> Iterator[np.ndarray]:
    if not group:
        return
    w, first = word_hashes(b"\n".join(group))
    ends = np.cumsum([len(t) + 1 for t in group])
    at = 0
    for end in np.searchsorted(first, ends).tolist():
        yield _set(w[at:end], width)
        at = end


def text_batches(batches, column: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of about ``most`` bytes with their texts as UTF-8 bytes (null: empty)."""
    for b in batches:
        texts = [x or b"" for x in b.column(column).cast(pa.binary()).to_pylist()]
        at, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > most:
                yield b.slice(at, i - at), texts[at:i]
                at, held = i, 0
            held += len(t)
        if at < len(texts):
            yield b.slice(at), texts[at:]
