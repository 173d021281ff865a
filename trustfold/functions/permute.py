"""Permutations of row positions that need no sort: any row computes its own place."""

from __future__ import annotations

import numpy as np

_ROUNDS = 6


def _mixed(v: np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers) of v and the key."""
    with np.errstate(over="ignore"):
        v = v + (key if isinstance(key, np.ndarray) else np.uint64(key & 0xFFFFFFFFFFFFFFFF))
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def shuffled(at: np.ndarray, n: int, key: int | np.ndarray) -> np.ndarray:
    """A bijection of 0 .. n-1, by a Feistel network on the next even number of bits; places outside walk on until they are inside.

    ``key`` is a number, or an array of unsigned 64-bit numbers with a bijection of its own for each place.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(_ROUNDS):
            with np.errstate(over="ignore"):
                round_key = key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r) if isinstance(key, np.ndarray) else key * 0x9E3779B97F4A7C15 + r
            left, right = right, left ^ (_mixed(right, round_key) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def drawn(many: int, n: int, key: int) -> np.ndarray:
    """``many`` draws with replacement from 0 .. n-1."""
    return (_mixed(np.arange(many, dtype=np.uint64), key * 0x9E3779B97F4A7C15) % np.uint64(n)).astype(np.int64)
