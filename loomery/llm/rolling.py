"""Hashes of stretches of an array of codes, all at once: polynomial in an odd number, modulo 2 ** 64."""

from __future__ import annotations

import numpy as np

HASH_STEP = 0x9E3779B97F4A7C15


class Powers:
    """Powers of HASH_STEP and of its inverse, as many as were ever asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = n + (n >> 2)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, HASH_STEP, np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(HASH_STEP, -1, 1 << 64), np.uint64)])
        return self.up, self.down

    def hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each stretch codes[start:end], wherever it stands; codes are unsigned 64-bit numbers or bytes."""
        up, down = self.upto(len(codes) + 1)
        with np.errstate(over="ignore"):
            upto = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=upto[1:])
            return (upto[ends] - upto[starts]) * down[starts] + (ends - starts).astype(np.uint64)
