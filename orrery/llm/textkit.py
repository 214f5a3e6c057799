"""Vectorized words and shingles of byte strings (NumPy), shared by several operators."""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(BASE), -1, 1 << 64))
_K1, _K2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators: white space by the words' definition, and everything in ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
MARKS = np.ones(256, bool)
MARKS[128:] = False
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U), dtype=_U)]) for b in (BASE, _INV)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x *= _K1
    x ^= x >> _U(27)
    x *= _K2
    x ^= x >> _U(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: ``(p[j] - p[i]) * BASE**-i`` depends on data[i:j] only."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of data[start:end] for each pair of positions; the length counts."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U) * _K2)


def hash_words(blobs: list[bytes], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, bounds of each text's words); texts must be joined-safe bytes."""
    data = np.frombuffer(b" ".join([*blobs, b""]), np.uint8)
    gap = separators[data]
    word = ~gap
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(gap & before)
    sizes = np.array([len(b) + 1 for b in blobs], np.int64)
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return span_hash(prefix_hash(LOWER[data]), start, end), bounds


def shingle_sets(blobs: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's sorted set of 64-bit hashes of ``size``-word shingles (see the near-duplicate contract)."""
    words, bounds = hash_words(blobs)
    n = len(words)
    odd = [_U(0xD6E8FEB86659FD93 + 2 * k * 0x5851F42D4C957F2D & ((1 << 64) - 1)) for k in range(size)]
    grams = np.zeros(0, _U)
    if n >= size:
        grams = words[: n - size + 1] * odd[0]
        for k in range(1, size):
            grams = mix(grams + words[k : n - size + 1 + k] * odd[k])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            h = np.array([b - a], _U)
            for k in range(a, b):
                h = mix(h + words[k : k + 1] * odd[k - a])
            out.append(h)
        else:
            out.append(grams[:0])
    return out


def by_bytes(texts: list[str | None], most: int = 1 << 19):
    """Slices (start, blobs) of ``texts`` as UTF-8, of about ``most`` bytes or one text each."""
    blobs, at, size = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if blobs and size + len(b) > most:
            yield at, blobs
            blobs, at, size = [], i, 0
        blobs.append(b)
        size += len(b)
    if blobs:
        yield at, blobs
