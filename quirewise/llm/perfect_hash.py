"""A minimal perfect hash over 64-bit keys, built and asked in numpy.

Levels of bit arrays: on each level every key left picks a position; keys alone at their position
set its bit and are done, the others go on to the next level.  A key's slot is the rank of its bit
over all levels.  It takes about 3 to 4 bits a key, and gives any slot for keys outside the set.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
LEVELS = 40


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads all bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(keys ^ salt) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """levels: packed bits of each level."""
        self.levels = levels
        self.bits = [np.unpackbits(x, bitorder="little") for x in levels]
        ends = np.cumsum([0, *(int(b.sum()) for b in self.bits)])
        self.ranks = [np.cumsum(b, dtype=np.int64) - 1 + e for b, e in zip(self.bits, ends, strict=False)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            if len(levels) >= LEVELS:
                raise ValueError("keys must be distinct")
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 only for keys outside the set."""
        keys = np.asarray(keys, np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (b, r) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = _place(keys[left], k, len(b))
            hit = b[at] == 1
            out[left[hit]] = r[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self, arrays: list[np.ndarray]) -> bytes:
        """The hash and arrays over its slots."""
        head = struct.pack("<2I", len(self.levels), len(arrays)) + struct.pack(f"<{len(self.levels)}Q", *map(len, self.levels))
        head += b"".join(a.dtype.str.encode().ljust(8) + struct.pack("<Q", a.nbytes) for a in arrays)
        return head + b"".join(x.tobytes() for x in self.levels) + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, list[np.ndarray]]:
        n, m = struct.unpack_from("<2I", data)
        sizes = struct.unpack_from(f"<{n}Q", data, 8)
        at = 8 + 8 * n
        kinds = [(data[at + 16 * i : at + 16 * i + 8].decode().strip(), struct.unpack_from("<Q", data, at + 16 * i + 8)[0]) for i in range(m)]
        at += 16 * m
        levels, arrays = [], []
        for s in sizes:
            levels.append(np.frombuffer(data, np.uint8, s, at))
            at += s
        for t, s in kinds:
            arrays.append(np.frombuffer(data, t, s // np.dtype(t).itemsize, at))
            at += s
        return cls(levels), arrays
