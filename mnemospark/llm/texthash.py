"""Hashes of words, shingles and lines of many texts at once, in numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Multipliers of the words of a shingle: powers of an odd number, between which no small sums are equal.
MULT = [np.uint64(pow(0xD1B54A32D192ED03, k + 1, 2**64)) for k in range(64)]
LOWER_LUT = np.arange(256, dtype=np.uint8)
LOWER_LUT[65:91] += 32
BLANK_LUT = np.zeros(256, bool)
BLANK_LUT[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64, up to n at least."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 20)
        base = 0x2545F4914F6CDD1D
        for key, b in (("p", base), ("q", pow(base, -1, 2**64))):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a)
    return _powers["p"], _powers["q"]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * _ODD)


def spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses a cut."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def words_of(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK_LUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words of lower-cased texts."""
    starts, ends = spans(~blank[raw], offsets)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of fewer words, of the whole sequence."""
    raw = LOWER_LUT[raw]
    starts, ends, of = words_of(raw, offsets)
    h = span_hashes(raw, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(of, np.arange(n + 1))
    if len(h) >= k:
        m = len(h) - k + 1
        s = h[:m] * MULT[0]
        for j in range(1, k):
            s += h[j : m + j] * MULT[j]
        s = mix(s)
    out = []
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix((h[a:b] * np.array(MULT[: b - a])).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
