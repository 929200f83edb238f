"""Hashed words and word shingles of texts, in numpy on bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; bounds the memory of a long text or of a batch.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15 - 2  # odd, 3 modulo 8
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64 over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


def _powers() -> list[np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, up to a piece's length."""
    if not _POWERS:
        for r in (_RADIX, pow(_RADIX, -1, 1 << 64)):
            p = np.full(PIECE + 1, r, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def _piece_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a piece that holds whole words only."""
    up, down = _powers() if len(b) <= PIECE else _long_powers(len(b))
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_RANDOM[b] * up[: len(b)], out=run[1:])
    h = (run[ends] - run[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts


def _long_powers(n: int) -> list[np.ndarray]:
    """As _powers for the one word that is longer than a piece."""
    out = []
    for r in (_RADIX, pow(_RADIX, -1, 1 << 64)):
        p = np.full(n + 1, r, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte offset of every word of data, piece by piece; A-Z count as a-z if lower."""
    b = np.frombuffer(data, np.uint8)
    if lower:
        b = _LOWER[b]
    hashes, starts, at = [], [], 0
    while at < len(b):
        end = min(at + PIECE, len(b))
        if end < len(b):
            spaces = np.flatnonzero(_SPACE[b[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                more = np.flatnonzero(_SPACE[b[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(b)
        h, s = _piece_hashes(b[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; of the whole if there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h += words[i : n - width + 1 + i] * _WEIGHTS[i]
    return mix(h)


def texts_words(texts: list[str | None], lower: bool = True) -> Iterator[np.ndarray]:
    """Word hashes of each text in turn, hashed many texts at a time; null counts as empty."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in group])
        h, s = word_hashes(b"\n".join(group), lower)
        yield from np.split(h, np.searchsorted(s, ends)[:-1])

    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if group and size + len(raw) > PIECE:
            yield from flush()
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield from flush()


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(words, k))
