"""Word shingles of texts as 64-bit hashes, by numpy over the bytes of a text."""

from __future__ import annotations

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Texts are hashed in pieces of about so many bytes, so that the tables of powers stay small.
PIECE = 1 << 20

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        ones = np.ones(1, np.uint64)
        _powers = tuple(np.concatenate([ones, np.cumprod(np.full(2 * n, b, np.uint64))]) for b in (BASE, UNBASE))
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word `[^\\x20\\x09-\\x0D]+` of a UTF-8 text with A-Z in lower case."""
    raw = np.frombuffer(text.translate(LOWER), np.uint8)
    if len(raw) <= PIECE:
        return piece_hashes(raw)
    blanks = np.nonzero(IS_BLANK[raw])[0]
    cuts = np.unique(np.append(blanks, len(raw))[np.minimum(np.searchsorted(blanks, np.arange(PIECE, len(raw), PIECE)), len(blanks))])
    return np.concatenate([piece_hashes(x) for x in np.split(raw, cuts)])


def piece_hashes(raw: np.ndarray) -> np.ndarray:
    blank = np.concatenate([[True], IS_BLANK[raw], [True]])
    edges = np.nonzero(blank[1:] != blank[:-1])[0]
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, unpower = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * power[: len(raw)])])
    return mix((sums[ends] - sums[starts]) * unpower[starts] + (ends - starts).astype(np.uint64))


def shingles(text: bytes | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter; none without words."""
    words = word_hashes(text or b"")
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - size + 1 + k])
    return np.unique(total)
