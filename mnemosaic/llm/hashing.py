"""Hashes of all words of a text at once: differences of a running polynomial modulo 2^64, mixed."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
_POWER = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if len(_POWER[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, PIECE + 4096), base, np.uint64)
            p[0] = 1
            _POWER[k] = np.multiply.accumulate(p)
    return _POWER[0], _POWER[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 text, in order; words are runs of characters other than ASCII blanks."""
    out, at = [], 0
    while at < len(raw):
        piece = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)
        blank = (piece == 32) | ((piece >= 9) & (piece <= 13))
        if at + len(piece) < len(raw) and not blank[-1]:  # a piece ends where a word ends
            last = int(np.flatnonzero(blank)[-1]) if blank.any() else -1
            if last < 0:
                rest = np.frombuffer(raw, np.uint8, len(raw) - at, at)
                gap = np.flatnonzero((rest == 32) | ((rest >= 9) & (rest <= 13)))
                piece = rest[: int(gap[0])] if len(gap) else rest
                blank = np.zeros(len(piece), bool)
            else:
                piece, blank = piece[: last + 1], blank[: last + 1]
        at += len(piece)
        edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=total[1:])
        out.append(mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
