"""Whole columns of texts as numpy arrays: words, their hashes and those of word windows, without a Python step a word.

Words are runs of bytes other than the six ASCII white-space bytes, which in UTF-8 is exactly [^\\x20\\x09-\\x0D]+.
Hashes are polynomials modulo 2**64 over random byte values, read off running sums and mixed at the end; the seeds are
fixed, so all workers agree. Polynomials modulo a power of two have long strings (Thue-Morse words) that meet for every
base, so words above LONG_WORD bytes are hashed by BLAKE2b instead; windows have too few words for such strings.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, (2, 256), np.uint64)
#: Odd multipliers, 5 modulo 8, so that their powers have the full period.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_STRETCH = 1 << 20
#: Below this many bytes, words that differ by a Thue-Morse word keep different polynomials (2**44 divides, 2**64 does not).
LONG_WORD = 64


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers outlive their tasks, and idle ones add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known = _powers[base] = (np.cumprod(up), np.cumprod(down))
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (the public splitmix64 finaliser; its constants are fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the len + 1 offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(n_rows: int, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most`` bytes, one row at least."""
    low = 0
    while low < n_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, min(high, n_rows)
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of the first word at or after its start (len + 1)."""
    space = IS_SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = True
    after[offsets[1:][np.diff(offsets) > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; spans in rising order without overlap."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        if ends[low] - starts[low] > _STRETCH:
            low += 1
            continue
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _STRETCH, "right")))
        a, b = int(starts[low]), int(ends[high - 1])
        up, down = powers(_BASES[which], b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_RANDOM[which][data[a:b]] * up[: b - a], out=sums[1:])
        s = starts[low:high] - a
        out[low:high] = (sums[ends[low:high] - a] - sums[s]) * down[s]
        low = high
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([which])).digest(), "little")
    return mix(out + (ends - starts).astype(np.uint64))


def hash_windows(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` values (len - width + 1 of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_BASES[which], len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


def inside(first: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """For each word, whether a window of ``width`` words from there lies within its text (first as words() gives it)."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n_words)
    return left >= width
