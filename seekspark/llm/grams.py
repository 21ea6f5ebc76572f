"""Hashed word n-grams and MinHash signatures of many texts at once, in numpy.

Words are what white space (space, tab, line ends, form feed, vertical tab) separates in the
lower-case text. A text of 1 to n-1 words has one n-gram, of all its words; one without words
has none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(max(n, _CHUNK + 1), p, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of b[s:e] for each span, from one prefix sum over the bytes."""
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the number of words of each text."""
    data = [t.lower().encode() for t in texts]
    lengths = np.array([len(d) + 1 for d in data], np.int64)
    b = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    word = ~SPACE[b]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # by stretches between words, so that the tables of powers stay small
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _CHUNK, "right")))
        hashes[at:to] = span_hashes(b[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low)
        at = to
    bounds = np.searchsorted(starts, np.cumsum(lengths))
    return hashes, np.diff(bounds, prepend=0)


def gram_sets(texts: Sequence[str], n: int) -> list[np.ndarray]:
    """For each text its distinct n-gram hashes, ascending."""
    words, counts = word_hashes(texts)
    to = np.cumsum(counts)
    out: list[np.ndarray] = []
    if len(words):
        grams = np.zeros(len(words), np.uint64)
        for j in range(n):  # beyond the end a word counts as 0; such grams are used only for short texts, below
            grams[: len(words) - j] += words[j:] * (_Q ** np.uint64(j) if j else np.uint64(1)) + np.uint64(j)
        grams = mix(grams)
    for e, m in zip(to.tolist(), counts.tolist()):
        if m >= n:
            out.append(np.unique(grams[e - m : e - n + 1]))
        elif m:
            own = words[e - m : e]
            total = np.uint64(m)
            with np.errstate(over="ignore"):
                for j, w in enumerate(own):
                    total = total * _Q + w
            out.append(mix(np.array([total], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bands_and_rows(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """The most selective banding with at most `most` hashes that finds a pair at `threshold` with probability `recall`."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= recall else int(np.ceil(np.log1p(-recall) / np.log1p(-p)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches that recall with so few hashes")
    return best


def prints(sets: Sequence[np.ndarray], count: int, seed: int = 1) -> np.ndarray:
    """For each set a byte of each of `count` MinHash values; sets mustn't be empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1 << 31, size=count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    c = rng.integers(1 << 32, size=count, dtype=np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), count), np.uint8)
    v = np.empty_like(x)
    t = np.empty_like(x)
    for j in range(count):
        np.multiply(x, a[j], out=v)
        np.add(v, c[j], out=v)
        np.right_shift(v, 15, out=t)
        np.bitwise_xor(v, t, out=v)
        np.multiply(v, np.uint32(0x85EBCA6B), out=v)
        least = np.minimum.reduceat(v, at)
        out[:, j] = (least ^ (least >> np.uint32(8)) ^ (least >> np.uint32(16))).astype(np.uint8)
    return out
