"""Directly addressable codes: ids in byte levels, a continuation bitmap and a
rank directory for each, so any id is read without decoding its neighbours.

Layout, little-endian: count u32, levels u32; for each level: entries u32, the
bytes, the bitmap (bit i set if entry i goes on), ranks u32 for each BLOCK bits.
"""

import struct

import numpy as np

BLOCK = 512


def pack(ids: np.ndarray) -> bytes:
    rest, levels = ids.astype("<u4"), []
    while len(rest):
        more = rest > 255
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK))
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
        levels.append(struct.pack("<I", len(rest)) + (rest & 255).astype("u1").tobytes() + np.packbits(more, bitorder="little").tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return struct.pack("<II", len(ids), len(levels)) + b"".join(levels)


class Reader:
    def __init__(self, data: bytes):
        self.n, k = struct.unpack_from("<II", data)
        self.levels, at = [], 8
        for _ in range(k):
            (m,) = struct.unpack_from("<I", data, at)
            bits, blocks = (m + 7) // 8, (m + BLOCK - 1) // BLOCK
            low = np.frombuffer(data, "u1", m, at + 4)
            bitmap = np.frombuffer(data, "u1", bits, at + 4 + m)
            self.levels.append((low, bitmap, np.frombuffer(data, "<u4", blocks, at + 4 + m + bits)))
            at += 4 + m + bits + 4 * blocks

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (low, bitmap, ranks) in enumerate(self.levels):
            value |= int(low[i]) << 8 * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * BLOCK
            ahead = np.unpackbits(bitmap[first // 8 : i // 8 + 1], bitorder="little")[: i - first]
            i = int(ranks[i // BLOCK]) + int(ahead.sum())
        return value

    def all(self) -> np.ndarray:
        out, here = np.zeros(self.n, "<u4"), np.arange(self.n)
        for k, (low, bitmap, _) in enumerate(self.levels):
            out[here] |= low.astype("<u4") << np.uint32(8 * k)
            here = here[np.unpackbits(bitmap, count=len(low), bitorder="little").astype(bool)]
        return out
