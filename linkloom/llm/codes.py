"""Whole texts as numpy arrays: code points, word spans, word hashes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next text."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        row = np.full(size, base, dtype=_U)
        row[0] = 1
        have = _powers[base] = np.multiply.accumulate(row)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lower_ascii(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + 32, points)


def blank(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def prefix_hash(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, the empty one first."""
    out = np.zeros(len(points) + 1, dtype=_U)
    np.cumsum(mix(points.astype(_U) + _U(1)) * _power(_BASE, len(points)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same 64 bits for equal substrings, wherever they stand."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    back = _power(_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * back[starts])


def word_hashes(points: np.ndarray) -> np.ndarray:
    """One hash for each run of characters that are not white space."""
    starts, ends = spans(~blank(points))
    return span_hash(prefix_hash(points), starts, ends)
