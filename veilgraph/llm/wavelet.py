"""Wavelet matrix over token ids: succinct bit-planes with rank and select, in one self-contained block of bytes."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"VWM1"
_HEAD = struct.Struct("<4sIQQII")  # magic, planes, tokens, documents, partition, sequence
SUPER = 512  # bits between two entries of a plane's rank directory


class WaveletMatrix:
    """planes[k] holds bit k (highest first) of every token in the order left by the planes before it."""

    def __init__(self, size: int, zeros: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.size, self.zeros, self.planes, self.ranks = size, zeros, planes, ranks
        self._bits: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, tokens: np.ndarray, depth: int) -> WaveletMatrix:
        now = np.ascontiguousarray(tokens, dtype=np.uint32 if depth > 16 else np.uint16)
        zeros, planes, ranks = np.zeros(depth, dtype=np.uint64), [], []
        for k in range(depth):
            bit = (now & (1 << (depth - 1 - k))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            padded = np.zeros((len(packed) + SUPER // 8 - 1) // (SUPER // 8) * (SUPER // 8), dtype=np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, SUPER // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32))))
            low = now[~bit]
            zeros[k] = len(low)
            now = np.concatenate((low, now[bit]))
        return cls(len(tokens), zeros, planes, ranks)

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position."""
        plane, out = self.planes[k], self.ranks[k][at // SUPER].astype(np.int64)
        byte = at // 8
        start = at // SUPER * (SUPER // 8)
        for step in range(SUPER // 8):
            here = start + step
            use = here < byte
            if not use.any():
                break
            out[use] += np.bitwise_count(plane[here[use]])
        rest = (at % 8).astype(np.uint8)
        last = np.where(rest > 0, plane[np.minimum(byte, len(plane) - 1)] if len(plane) else 0, 0).astype(np.uint8)
        return out + np.bitwise_count(last & ((np.uint8(1) << rest) - np.uint8(1)))

    def access(self, at) -> np.ndarray:
        """Tokens at the positions."""
        at = np.atleast_1d(np.asarray(at, dtype=np.int64)).copy()
        value = np.zeros(len(at), dtype=np.int64)
        for k, plane in enumerate(self.planes):
            bit = (plane[at // 8] >> (at % 8).astype(np.uint8)) & 1
            ones = self._rank1(k, at)
            at = np.where(bit == 1, int(self.zeros[k]) + ones, at - ones)
            value = value << 1 | bit
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        low, high = np.array([0]), np.array([upto])
        depth = len(self.planes)
        for k in range(depth):
            a, b = self._rank1(k, low), self._rank1(k, high)
            low, high = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if token >> (depth - 1 - k) & 1 else (low - a, high - b)
        return int(low[0]), int(high[0])

    def rank(self, token: int, upto: int) -> int:
        """Occurrences of token in the first `upto` positions."""
        if token >> len(self.planes) or not self.size:
            return 0
        low, high = self._range(token, min(upto, self.size))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, nth: int) -> int:
        """Position of the nth occurrence (from 0); -1 beyond the last."""
        if nth < 0 or nth >= self.count(token):
            return -1
        at = self._range(token, self.size)[0] + nth
        depth = len(self.planes)
        for k in range(depth - 1, -1, -1):
            bits = self.bits(k)
            one = token >> (depth - 1 - k) & 1
            at = self._nth(k, bool(one), at - (int(self.zeros[k]) if one else 0), bits)
        return at

    def _nth(self, k: int, one: bool, nth: int, bits: np.ndarray) -> int:
        before = self.ranks[k].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * SUPER - before
        block = int(np.searchsorted(before, nth, side="right")) - 1
        inside = np.flatnonzero(bits[block * SUPER : (block + 1) * SUPER] == one)
        return block * SUPER + int(inside[nth - before[block]])

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of token, ascending."""
        low, high = self._range(token, self.size) if self.size and not token >> len(self.planes) else (0, 0)
        at = np.arange(low, high)
        depth = len(self.planes)
        for k in range(depth - 1, -1, -1):
            one = token >> (depth - 1 - k) & 1
            at = np.flatnonzero(self.bits(k) == one)[at - (int(self.zeros[k]) if one else 0)]
        return at

    def bits(self, k: int) -> np.ndarray:
        if self._bits[k] is None:
            self._bits[k] = np.unpackbits(self.planes[k], count=self.size, bitorder="little").view(bool)
        return self._bits[k]

    def tokens(self) -> np.ndarray:
        """All tokens in order, by undoing the partitions from the last plane to the first."""
        depth = len(self.planes)
        now = np.zeros(self.size, dtype=np.uint32 if depth > 16 else np.uint16)
        for k in range(depth - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.size, bitorder="little").view(bool)
            zeros = int(self.zeros[k])
            back = np.empty_like(now)
            back[~bit] = now[:zeros]
            back[bit] = now[zeros:] | (1 << (depth - 1 - k))
            now = back
        return now


def pack(matrix: WaveletMatrix, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, partition: int, sequence: int) -> bytes:
    """One shard's bytes: header, document table, then each plane with its rank directory."""
    parts = [_HEAD.pack(MAGIC, len(matrix.planes), matrix.size, len(doc_ids), partition, sequence), doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), lengths.astype("<u8").tobytes(), matrix.zeros.astype("<u8").tobytes()]
    for plane, rank in zip(matrix.planes, matrix.ranks, strict=True):
        parts += [plane.tobytes(), rank.astype("<u4").tobytes()]
    return b"".join(parts)


def unpack(blob: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(matrix, doc ids, which ids are known, tokens of each document, partition, sequence)."""
    magic, depth, size, docs, partition, sequence = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a wavelet shard")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    ids, known, lengths, zeros = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u8", depth)
    planes, ranks = [], []
    for _ in range(depth):
        planes.append(take("u1", (size + 7) // 8))
        ranks.append(take("<u4", (size + SUPER - 1) // SUPER + 1))
    return WaveletMatrix(size, zeros, planes, ranks), ids, known.astype(bool), lengths.astype(np.int64), partition, sequence
