"""Segmentation lattices of many short units at once, and sampled paths through them, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from veilgraph.llm.textbatch import mix

BLANK = "▁"
_C1, _C2, _C3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_ALL = (1 << 64) - 1


def uniform(seed: np.ndarray, stream: int, at: np.ndarray, step: int = 0) -> np.ndarray:
    """Numbers in (0, 1) that depend on the arguments only."""
    key = at.astype(np.uint64) * np.uint64(_C2)
    key += seed
    key += np.uint64((stream * _C1 + step * _C3) & _ALL)
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform_one(seed: int, stream: int, at: int, step: int = 0) -> float:
    """uniform() of one place."""
    x = (seed + stream * _C1 + at * _C2 + step * _C3) & _ALL
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _ALL
    x ^= x >> 31
    return ((x >> 11) + 0.5) * 2.0**-53


@lru_cache(maxsize=4)
def pieces_of(path: str, alpha: float) -> Pieces:
    """One vocabulary for all tasks of a worker process."""
    return Pieces(path, alpha)


class Pieces:
    """A piece vocabulary as a trie in one hash table, with a log weight for each piece.

    The models here are of the merge kind: a piece's stored score is its rank, not a log
    probability.  Zipf's law turns rank into weight, -log(rank + ZIPF), times alpha.
    """

    ZIPF = 2.7

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.byte_id = np.zeros(256, dtype=np.int64)
        surface: list[bytes] = []
        nodes: dict[tuple[int, str], int] = {}
        piece_at = [-1]
        rank = 0
        weight = np.zeros(self.size)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
                continue
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
                continue
            surface.append(piece.replace(BLANK, " ").encode())
            weight[i] = -alpha * np.log(rank + self.ZIPF)
            rank += 1
            node = 0
            for c in piece:
                if (node, c) not in nodes:
                    nodes[node, c] = len(piece_at)
                    piece_at.append(-1)
                node = nodes[node, c]
            piece_at[node] = i
        self.weight, self.byte_weight = weight, -alpha * np.log(rank + self.ZIPF)
        self.piece_at = np.array(piece_at)
        self.longest = max(len(model.id_to_piece(i)) for i in range(self.size))
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_size = np.array([len(x) for x in surface])
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self._keys = np.full(1 << 19, -1, dtype=np.int64)
        self._next = np.zeros(1 << 19, dtype=np.int64)
        for (node, c), to in nodes.items():
            key = node << 21 | ord(c)
            slot = int(self._slot(np.array([key]))[0])
            while self._keys[slot] >= 0:
                slot = slot + 1 & (1 << 19) - 1
            self._keys[slot], self._next[slot] = key, to

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(_C1)) >> np.uint64(45)).view(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Trie node after one more character; -1 where there is none."""
        key = node << 21 | code
        slot = self._slot(key)
        found = self._keys[slot]
        out = np.where(found == key, self._next[slot], -1)
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):
            slot[again] = slot[again] + 1 & (1 << 19) - 1
            found = self._keys[slot[again]]
            hit = found == key[again]
            out[again[hit]] = self._next[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the id runs ids[offsets[i]:offsets[i+1]], with the leading blank of each run taken off."""
        size = self.surface_size[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.surface_at[ids] - (ends - size), size)
        data = self.surface[at]
        bounds = np.concatenate(([0], ends))[offsets]
        drop = bounds[:-1][np.diff(bounds) > 0]
        keep = np.ones(len(data), dtype=bool)
        keep[drop] = False
        return data[keep], bounds - np.searchsorted(drop, bounds)


class Lattice:
    """Edges of all units, with the probability of each edge given its start under the path distribution."""

    def __init__(self, pieces: Pieces, units: list[str]) -> None:
        size = np.fromiter(map(len, units), np.int64, len(units)) + 1
        code = np.frombuffer((BLANK + BLANK.join(units)).encode("utf-32-le"), dtype=np.uint32).astype(np.int64) if units else np.zeros(0, np.int64)
        code = np.where(code == 0x20, ord(BLANK), code)
        unit = np.repeat(np.arange(len(units)), size)
        stop = np.cumsum(size)[unit] if len(units) else np.zeros(0, np.int64)
        self.start = np.cumsum(size) - size + np.arange(len(units))
        self.stop = self.start + size
        source, length, piece = [], [], []
        at, state = np.arange(len(code)), np.zeros(len(code), dtype=np.int64)
        single = np.zeros(len(code), dtype=bool)
        for n in range(1, pieces.longest + 1):
            inside = at + n - 1 < stop[at]
            at, state = at[inside], state[inside]
            state = pieces.step(state, code[at + n - 1])
            at, state = at[state >= 0], state[state >= 0]
            if not len(at):
                break
            found = pieces.piece_at[state]
            hit = found >= 0
            source.append(at[hit])
            piece.append(found[hit])
            length.append(np.full(int(hit.sum()), n))
            if n == 1:
                single[at[hit]] = True
        lost = np.flatnonzero(~single)  # characters without a piece: their bytes
        width = 1 + (code[lost] >= 0x80) + (code[lost] >= 0x800) + (code[lost] >= 0x10000)
        source.append(lost)
        piece.append(-1 - code[lost])
        length.append(np.ones(len(lost), dtype=np.int64))
        src, num, ids = np.concatenate(source), np.concatenate(length), np.concatenate(piece)
        cost = np.concatenate((pieces.weight[ids[: len(ids) - len(lost)]], width * pieces.byte_weight))
        order = np.argsort(src, kind="stable")
        src, num, self.piece, cost = src[order], num[order], ids[order], cost[order]
        self.source, self.target = src + unit[src], src + num + unit[src]
        #: token of each edge; characters of several bytes without a piece keep -1 - code
        self.token = np.where((self.piece < 0) & (self.piece >= -0x80), pieces.byte_id[np.clip(-1 - self.piece, 0, 0x7F)], self.piece)
        total = len(code) + len(units)
        degree = np.bincount(self.source, minlength=total)
        self.first = np.cumsum(degree) - degree
        self.last = self.first + degree - 1
        # log sums towards each unit's end, all units at once by distance from it
        beta = np.zeros(total)
        away = stop[src] - src
        turn = np.argsort(away.astype(np.uint16) if len(away) and away.max() < 1 << 16 else away, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(away)))) if len(away) else np.zeros(1, np.int64)
        for d in range(1, len(cuts) - 1):
            use = turn[cuts[d] : cuts[d + 1]]
            value, node = cost[use] + beta[self.target[use]], self.source[use]
            new = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            top = np.maximum.reduceat(value, new)
            each = np.diff(np.concatenate((new, [len(use)])))
            beta[node[new]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, each)), new))
        self.logp = np.minimum(cost + beta[self.target] - beta[self.source], 0.0)
        p = np.exp(self.logp)
        total_p = np.cumsum(p)
        base = (total_p - p)[self.first[self.source]]
        self.upto = total_p - base

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge out of each node that u picks."""
        edge, last = self.first[node], self.last[node]
        go = np.flatnonzero((u > self.upto[edge]) & (edge < last))
        while len(go):
            edge[go] += 1
            go = go[(u[go] > self.upto[edge[go]]) & (edge[go] < last[go])]
        return edge

    def sample(self, unit: np.ndarray, seed: np.ndarray, place: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
        """One path for every occurrence of a unit: (edges, offsets by occurrence)."""
        node, stop, live = self.start[unit], self.stop[unit], np.arange(len(unit))
        who, edges, step = [], [], 0
        while len(live):
            edge = self.choose(node, uniform(seed, stream, place, step))
            who.append(live)
            edges.append(edge)
            node = self.target[edge]
            more = node != stop
            live, node, stop, seed, place = live[more], node[more], stop[more], seed[more], place[more]
            step += 1
        size = np.zeros(len(unit), dtype=np.int64)
        for rows in who:
            size[rows] += 1
        offsets = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(offsets[-1], dtype=np.int64)
        for k, (rows, edge) in enumerate(zip(who, edges, strict=True)):
            out[offsets[rows] + k] = edge
        return out, offsets
