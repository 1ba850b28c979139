"""Hashes of byte strings at given places of a byte array."""

from __future__ import annotations

import functools

import numpy as np

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Namer:
    """Polynomial hashes modulo 2**64 of randomly weighted bytes, from running sums."""

    def __init__(self, which: int):
        self.base = _MULTIPLIERS[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.bytes = np.random.default_rng(which).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.powers[: len(data)], out=out[1:])
        return out

    def names(self, sums: np.ndarray, at: np.ndarray, length) -> np.ndarray:
        """Hashes of ``length`` bytes (one number or one per place) from each place."""
        return mix((sums[at + length] - sums[at]) * self.inverses[at])


@functools.cache
def namer(which: int) -> Namer:
    return Namer(which)
