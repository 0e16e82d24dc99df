"""Rolling hashes and sliding minima over numpy arrays."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no order of the input behind."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: A word for each byte value.
BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def prefix(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64 of 64-bit words; one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers("up", _BASE, len(values)), dtype=np.uint64, out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of what ``prefix`` has summed."""
    return mix((sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(sums))[starts])


def grams(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values."""
    m = max(0, len(sums) - n)
    return mix((sums[n:] - sums[:m]) * _powers("down", _INVERSE, m))


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` values the place of its least, the leftmost among equals.

    The low bits that hold the place are taken from the value, so equal runs still choose the same offset.
    """
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    low = np.uint64(max(1, n.bit_length()))
    packed = (values >> low << low) | np.arange(n, dtype=np.uint64)
    pad = -n % w
    blocks = np.concatenate([packed, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[: n - w + 1], left[w - 1 : n])
    return (best & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.concatenate([starts[1:], [len(keys)]])
