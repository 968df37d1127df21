"""A minimal perfect hash over distinct 64-bit keys, built and asked in whole arrays.

Level by level, each remaining key marks one cell of a bit array; keys alone in
their cell are placed, the others go on to the next level. A key's slot is the
number of set bits before its cell, so n keys fill the slots 0 .. n-1 exactly.
A key that was never put in may still get some slot: callers store a
fingerprint, or the key itself, per slot and compare.
"""

from __future__ import annotations

import io

import numpy as np

CELLS_PER_KEY = 2.0


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class MinimalPerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """levels: for each level one boolean per cell."""
        self.levels = levels
        self.ranks = []
        before = 0
        for cells in levels:
            self.ranks.append(before + np.cumsum(cells) - cells)
            before += int(cells.sum())
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        left = np.asarray(keys).astype(np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys of a minimal perfect hash must be distinct")
        levels = []
        while len(left):
            n = int(CELLS_PER_KEY * len(left)) + 1
            at = (mix(left, len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where the key is surely not among those put in."""
        keys = np.asarray(keys).astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (cells, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (mix(keys[left], level) % np.uint64(len(cells))).astype(np.int64)
            hit = cells[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(x) for x in self.levels], dtype=np.int64)
        bits = [np.packbits(x) for x in self.levels]
        held = io.BytesIO()
        np.save(held, sizes)
        np.save(held, np.concatenate(bits) if bits else np.zeros(0, np.uint8))
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        held = io.BytesIO(data)
        sizes, bits = np.load(held), np.load(held)
        levels, at = [], 0
        for n in sizes.tolist():
            k = (n + 7) // 8
            levels.append(np.unpackbits(bits[at : at + k], count=n).astype(bool))
            at += k
        return cls(levels)
