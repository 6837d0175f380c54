"""Word shingles of texts as 64-bit hashes, by array arithmetic over the bytes of a text."""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A fixed random odd number for every byte value."""
    return np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(room: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    base, inverse = np.full(room, _BASE), np.full(room, np.uint64(pow(int(_BASE), -1, 2**64)))
    base[0] = inverse[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


_kept = [_powers(1 << 16)]  # one table, the largest that was needed


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    if len(_kept[0][0]) < n:
        _kept[0] = _powers(1 << n.bit_length())
    return _kept[0]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of a byte array, from that of the empty one."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[raw] * powers(len(raw))[0][: len(raw)], out=out[1:])
    return out


def span_hashes(prefixes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``begin`` to ``end``, the same wherever a span stands."""
    return (prefixes[end] - prefixes[begin]) * powers(len(prefixes))[1][begin]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of a public generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of bytes other than ASCII white space."""
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    change = np.diff(solid)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct shingles of a text in ascending order.

    A-Z are lower-cased. A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    begin, end = word_spans(raw)
    if not len(begin):
        return np.empty(0, dtype=np.uint64)
    hashes = mixed(span_hashes(prefix_hashes(raw), begin, end))
    size = min(words, len(hashes))
    weights = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.full(len(hashes) - size + 1, np.uint64(size))
    for i in range(size):
        total += hashes[i : i + len(total)] * weights[i]
    return np.unique(mixed(total))


@functools.lru_cache(maxsize=4)
def _seeds(size: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(11)
    return random.integers(0, 2**32, size, dtype=np.uint32), random.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` minwise values of a set, 32 bits each; long sets are taken in parts."""
    flips, factors = _seeds(size)
    out = np.full(size, np.iinfo(np.uint32).max)
    short = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for i in range(0, len(short), 512):
        np.minimum(out, ((short[i : i + 512] ^ flips) * factors).min(axis=0), out=out)
    return out
