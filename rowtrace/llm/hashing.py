"""Vectorised hashes of pieces of arrays: one prefix pass, then any piece in constant time.

A piece x[s:e] has the hash sum(mix(x[j]) * m**(j - s)) modulo 2**64 with an odd m, so
it is a difference of prefix sums times a power of m's inverse. `mix` spreads the
items first, and results are spread again before use.
"""

from __future__ import annotations

import numpy as np

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # any odd numbers; two for 128 bits


def mix(values: np.ndarray, stream: int = 0) -> np.ndarray:
    """Bijective spreading of 64-bit values (xor-shift and multiply rounds); streams differ."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((0x632BE59BD9B4E019 * (stream + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count - 1) modulo 2**64, by doubling."""
    out = np.ones(max(count, 1), np.uint64)
    done, step = 1, np.uint64(base & (2**64 - 1))
    with np.errstate(over="ignore"):
        while done < count:
            more = min(done, count - done)
            out[done : done + more] = out[:more] * step
            step = step * step
            done += more
    return out[:count]


class Pieces:
    """Hashes of pieces of one array."""

    def __init__(self, mixed: np.ndarray, stream: int = 0) -> None:
        m = MULTIPLIERS[stream % len(MULTIPLIERS)]
        n = len(mixed)
        self.inverse = powers(pow(m, -1, 2**64), n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mixed * powers(m, n), out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])


def word_spans(data: np.ndarray, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes; words are runs of bytes other than 0x20 and 0x09-0x0D, and end at
    the borders of texts."""
    word = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    apart = np.zeros(len(data) + 1, bool)
    if borders is not None:
        apart[borders] = True
    none = np.zeros(1, bool)
    begins = word & (~np.concatenate((none, word[:-1])) | apart[:-1])
    stops = word & (~np.concatenate((word[1:], none)) | apart[1:])
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


_byte_values = {s: mix(np.arange(256, dtype=np.uint64), 100 + s) for s in (0, 1)}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stream: int = 0) -> np.ndarray:
    return Pieces(_byte_values[stream][data], stream).of(starts, ends)
