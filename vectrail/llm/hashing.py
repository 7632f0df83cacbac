"""Hashes of many words or strings at once, in numpy."""

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An odd base for polynomial hashes and its inverse modulo 2^64.
BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at once.
STRETCH = 1 << 18
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64) + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        ones = np.full(size, BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        for array in ones:
            array[0] = 1
            np.multiply.accumulate(array, out=array)
        _powers[size] = ones
    return _powers[size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums S of byte times power up to each place; the string from a to b hashes to
    ``(S[b] - S[a]) * inverse power of a``."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words between ASCII white space, with A-Z lowered if asked.

    Bytes are read in stretches, and what two stretches hold of a word is put together, so that the
    memory for each byte does not depend on the length of the text or its words.
    """
    starts, values, lengths = [], [], []
    open_word = False
    for at in range(0, len(data), STRETCH):
        codes = np.frombuffer(data, dtype=np.uint8, count=min(STRETCH, len(data) - at), offset=at)
        codes = _LOWERED[codes] if lower else codes
        inside = ~_BLANK[codes]
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = prefix_sums(codes)
        _, down = powers(len(codes) + 1)
        value, length = (sums[end] - sums[first]) * down[first], (end - first).astype(np.uint64)
        if open_word and inside[0]:
            up = np.uint64(pow(BASE, int(lengths[-1][-1]), 1 << 64))
            values[-1][-1:] += value[:1] * up
            lengths[-1][-1:] += length[:1]
            first, value, length = first[1:], value[1:], length[1:]
        if len(first):
            starts.append(first + at)
            values.append(value)
            lengths.append(length)
        open_word = bool(inside[-1])
    if not starts:
        return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    values = [mix(value + length * _M2) for value, length in zip(values, lengths)]
    del lengths
    return np.concatenate(starts), np.concatenate(values)
