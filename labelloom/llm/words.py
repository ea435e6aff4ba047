"""Word and shingle hashes of whole texts, for a batch of texts at a time.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text. Its hash is the polynomial (Karp-Rabin) fingerprint of its
UTF-8 bytes modulo 2**64, mixed. Everything is arithmetic on flat numpy arrays,
so the cost is a few nanoseconds a byte whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# --- Fixed values: base of the fingerprint and multipliers of the mixer ---------
BASE = 0x100000001B3
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
# ------------------------------------------------------------------------------
CHUNK_BYTES = 1 << 20
SHINGLE = 5

_WORD_BYTE = np.zeros(256, dtype=bool)
for _first, _last in ((ord("0"), ord("9")), (ord("a"), ord("z")), (128, 255)):
    _WORD_BYTE[_first : _last + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as far as a chunk has needed them."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return cls.up[:n], cls.down[:n]


def encoded(text: str | None) -> bytes:
    """Lower-cased UTF-8; null counts as empty, lone surrogates become ``?``."""
    return (text or "").lower().encode("utf-8", "replace")


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """``(first, last, encoded texts)`` of about CHUNK_BYTES; a longer text is a chunk of its own."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append(encoded(text))
        size += len(held[-1])
        if size >= CHUNK_BYTES or i == len(texts) - 1:
            yield first, i + 1, held
            first, size, held = i + 1, 0, []


def chunk_words(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(word hashes, offsets)``: text i has the hashes ``offsets[i]:offsets[i + 1]``."""
    data = np.frombuffer(b" ".join([*held, b""]), dtype=np.uint8)
    ends = np.cumsum([len(x) + 1 for x in held])
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edge[0::2], edge[1::2]
    up, down = _Powers.reach(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(GOLDEN))
    return hashes, np.concatenate([[0], np.searchsorted(start, ends)])


def chunk_shingles(hashes: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes of k consecutive words, offsets)``.

    A text of 1 to k - 1 words has one shingle, of all its words; one without
    words has none.
    """
    n = np.diff(offsets)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(many)])
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(k):
        step = np.uint64((2 * j + 1) * GOLDEN & (2**64 - 1))
        rolled[: max(len(hashes) - j, 0)] += mix(hashes[j:] + step) * np.uint64(2 * j + 3)
    place = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], many)
    shingle = mix(rolled[place])
    for i in np.flatnonzero((n > 0) & (n < k)):
        own, h = hashes[offsets[i] : offsets[i + 1]], np.uint64(len(hashes[offsets[i] : offsets[i + 1]]))
        with np.errstate(over="ignore"):
            for w in own:
                h = mix(np.array([h * np.uint64(BASE) + w], dtype=np.uint64))[0]
        shingle[out[i]] = h
    return shingle, out
