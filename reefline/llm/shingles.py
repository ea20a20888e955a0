"""Sets of word shingles as 64-bit hashes, for whole batches of texts in NumPy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Characters that are worked on at once.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs other than of ASCII white space, A-Z as a-z) and words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    n = 1 << max(19, int(len(data) - 1).bit_length())
    power, inverse = powers(n)
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])])
    hashes = mix((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(r) + 1 for r in raw])
    counts = np.searchsorted(starts, bounds)
    return hashes, np.diff(np.concatenate([[0], counts]))


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words; one for the whole
    text if it has fewer words, none if it has no word."""
    words, counts = word_hashes(texts)
    n = len(words)
    whole = max(n - width + 1, 0)
    joined = np.zeros(whole, dtype=np.uint64)
    for j in range(width):
        joined += words[j : whole + j] * _PLACE[j]
    joined = mix(joined)
    at = 0
    for c in counts.tolist():
        if c >= width:
            s = np.sort(joined[at : at + c - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif c:
            short = words[at : at + c] * _PLACE[32 : 32 + c]
            yield mix(np.array([short.sum(dtype=np.uint64) ^ np.uint64(c)]))
        else:
            yield np.zeros(0, dtype=np.uint64)
        at += c


def chunks(texts: Iterable[str], size: int = CHUNK) -> Iterator[list[str]]:
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
