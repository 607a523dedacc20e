"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text's lattice is the chain of its units' lattices (pieces never cross a blank).  A perturbed
A-star search runs over it: every partial path carries a Gumbel-perturbed log probability that
bounds all its completions.  The best child inherits its parent's bound; all other children of a
node together get one bound below it.  Taking entries off the agenda by bound emits distinct
segmentations in order of perturbed score, a sample without replacement.  Only the first nodes of
a path can hold the next bounds, so the agenda stays small for texts of any length.

The inclusion score of a segmentation is the log of 1 - exp(-exp(log_prob - kappa)), kappa being
the next bound on the agenda.  All random numbers come from the row's doc_id and the seed, so
results do not depend on partitioning.

Rules for odd input: a null or empty text has one, empty, segmentation; texts with fewer than k
segmentations give them all, with inclusion 0; rows of one doc_id draw the same numbers; a null
doc_id draws as 0; a very long text is searched whole, in memory of its own lattice; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.encoding import units_by_blank
from veilgraph.llm.lattice import Lattice, Pieces, pieces_of, uniform, uniform_one
from veilgraph.llm.shared import small_batches, table
from veilgraph.llm.textbatch import mix, slices

SAMPLES = 2
ALPHA = 0.5
SEED = 20_260
SLICE = 1 << 20
#: Nodes of a path whose untaken children get a bound each; those of all later nodes share one.
NEAR = 16

_KINDS = {"ids": pa.list_(pa.int32()), "text": pa.string(), "ids_crc32": pa.int64(), "same": pa.bool_()}
_BASE = "doc_id long, sample int, n_tokens long, log_prob double, perturbed double, inclusion double"


class _Paths:
    """One segmentation for each text of a slice: edges, text and unit offsets, log probabilities before each edge."""

    def __init__(self, lattice: Lattice, edges: np.ndarray, units: np.ndarray, texts: np.ndarray) -> None:
        self.edges, self.units, self.texts = edges, units, texts
        self.logp = lattice.logp[edges]
        self.total = np.concatenate(([0.0], np.cumsum(self.logp)))

    def over(self, first: np.ndarray) -> _Paths:
        """With each text's first unit."""
        self.first = first.tolist()
        return self

    def unit_range(self, text: int) -> tuple[int, int]:
        return self.first[text], self.first[text + 1]

    def before(self, text: int, t: int) -> float:
        return float(self.total[self.texts[text] + t] - self.total[self.texts[text]])

    def log_prob(self) -> np.ndarray:
        return self.total[self.texts[1:]] - self.total[self.texts[:-1]]


def _other(logp: np.ndarray) -> np.ndarray:
    """Log of one minus a probability."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(logp))


def _below(top: np.ndarray, loc: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel draw at loc, given that it lies below top."""
    return np.where(np.isfinite(loc), -np.logaddexp(-top, np.log(-np.log(u)) - np.where(np.isfinite(loc), loc, 0.0)), -np.inf)


def _bounds(paths: _Paths, number: int, rows: np.ndarray, top: np.ndarray, frm: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Bounds of the untaken children at the NEAR nodes from `frm` on, and in the last column of all nodes after them."""
    begin, end = paths.texts[rows], paths.texts[rows + 1]
    at = frm[:, None] + np.arange(NEAR + 1)
    node = begin[:, None] + at
    live = node < end[:, None]
    safe = np.where(live, node, 0)
    loc = paths.total[safe] - paths.total[begin][:, None]
    own = paths.logp[safe] if len(paths.logp) else np.zeros(safe.shape)
    own[:, NEAR] = (paths.total[end] - paths.total[np.minimum(begin + frm + NEAR, end)])  # the rest of the path itself
    loc = np.where(live, loc + _other(np.minimum(own, 0.0)), -np.inf)
    return _below(top[:, None], loc, uniform(seeds[:, None], 1_000 + number, at))


class _Search:
    """The agendas of a slice's texts; entries are (-bound, path, node, children gone), node < 0: all nodes from -1 - node on."""

    def __init__(self, lattice: Lattice, seeds: np.ndarray, texts: int) -> None:
        self.lattice, self.seeds, self.ints = lattice, seeds, seeds.tolist()
        self.agenda: list[list] = [[] for _ in range(texts)]
        self.paths: list[_Paths] = []

    def add(self, paths: _Paths, rows: np.ndarray, top: np.ndarray, frm: np.ndarray, keep: int) -> None:
        number = len(self.paths)
        self.paths.append(paths)
        found = _bounds(paths, number, rows, top, frm, self.seeds[rows])
        best = np.argsort(-found, axis=1, kind="stable")[:, :keep]
        values, starts = np.take_along_axis(found, best, axis=1).tolist(), frm.tolist()
        for i, cells, bounds, low in zip(rows.tolist(), best.tolist(), values, starts, strict=True):
            for cell, bound in zip(cells, bounds, strict=True):
                if bound > -math.inf:
                    heapq.heappush(self.agenda[i], (-bound, number, low + cell if cell < NEAR else -1 - low - NEAR, ()))

    def _taken(self, number: int, i: int, t: int) -> int:
        paths = self.paths[number]
        return int(paths.edges[paths.texts[i] + t])

    def pop(self, i: int) -> tuple[float, int, int, tuple[int, ...]]:
        """The best entry, with a group of nodes resolved into the one node that holds the bound."""
        bound, number, t, gone = heapq.heappop(self.agenda[i])
        while t < 0:
            paths, low = self.paths[number], -1 - t
            one = np.array([i])
            begin, end = int(paths.texts[i]), int(paths.texts[i + 1])
            at = np.arange(low, min(low + NEAR, end - begin))
            loc = paths.total[begin + at] - paths.total[begin] + _other(paths.logp[begin + at])
            after = low + NEAR
            rest = paths.before(i, after) + float(_other(np.array(min(float(paths.total[end] - paths.total[begin + after]), 0.0)))) if begin + after < end else -math.inf
            every = np.append(loc, rest)
            p = np.exp(every - every.max())
            win = min(int(np.searchsorted(np.cumsum(p), uniform_one(self.ints[i], 5_000 + number, low) * p.sum())), len(p) - 1)
            others = _below(np.full(len(every), -bound), every, uniform(np.full(len(every), self.seeds[one[0]]), 6_000 + number, low + np.arange(len(every))))
            for k, value in enumerate(others.tolist()):
                if k != win and value > -math.inf:
                    heapq.heappush(self.agenda[i], (-value, number, low + k if k < len(at) else -1 - after, ()))
            t = low + win if win < len(at) else -1 - after
        return bound, number, t, gone

    def branch(self, i: int, entry: tuple[float, int, int, tuple[int, ...]], number: int) -> tuple[list[int], int]:
        """(edges from the chosen child to the end of its unit, that unit's number in the text); the other children go back."""
        bound, parent, t, gone = entry
        lattice, seed, paths = self.lattice, self.ints[i], self.paths[parent]
        taken = self._taken(parent, i, t)
        gone = gone or (taken,)
        node = int(lattice.source[taken])
        children = [c for c in range(int(lattice.first[node]), int(lattice.last[node]) + 1) if c not in gone]
        p = [math.exp(lattice.logp[c]) for c in children]
        u, edge = uniform_one(seed, 2_000 + number, t) * sum(p), children[-1]
        for c, x in zip(children, p, strict=True):
            u -= x
            if u <= 0:
                edge = c
                break
        if len(children) > 1:
            left = sum(x for c, x in zip(children, p, strict=True) if c != edge)
            if left > 0:
                value = float(_below(np.array(-bound), np.array(paths.before(i, t) + math.log(left)), np.array(uniform_one(seed, 4_000 + number, t))))
                heapq.heappush(self.agenda[i], (-value, parent, t, (*gone, edge)))
        low, high = paths.unit_range(i)
        unit = bisect_right(paths.units, paths.texts[i] + t, low, high) - 1
        end = int(lattice.target[paths.edges[paths.units[unit + 1] - 1]])
        middle = [edge]
        while (here := int(lattice.target[middle[-1]])) != end:
            u, c, last = uniform_one(seed, 3_000 + number, t, len(middle)), int(lattice.first[here]), int(lattice.last[here])
            while c < last and u > lattice.upto[c]:
                c += 1
            middle.append(c)
        return middle, unit


def _expanded(pieces: Pieces, tokens: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of several bytes without a piece become the ids of their bytes."""
    wide = np.flatnonzero(tokens < 0)
    if not len(wide):
        return tokens, texts
    bodies = [pieces.byte_id[np.frombuffer(chr(-1 - c).encode(), dtype=np.uint8)] for c in tokens[wide].tolist()]
    size = np.ones(len(tokens), dtype=np.int64)
    size[wide] = [len(x) for x in bodies]
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.repeat(tokens, size)
    for at, body in zip(ends[wide].tolist(), bodies, strict=True):
        out[at : at + len(body)] = body
    return out, ends[texts]


def _inclusion(log_prob: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(log_prob - kappa)))."""
    gap = np.where(np.isfinite(kappa), log_prob - np.where(np.isfinite(kappa), kappa, 0.0), np.inf)
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(gap < -25, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 100.0)))))


def _sampler(path: str, k: int, alpha: float, base: int, wanted: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path, alpha)
        for batch in batches:
            for rows, data, offsets in slices(batch, limit=SLICE):
                yield from _slice(pieces, rows, data, offsets)

    def _slice(pieces: Pieces, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        units, first = units_by_blank(data, offsets)
        coded = units.dictionary_encode()
        index = np.asarray(coded.indices).astype(np.int64)
        lattice = Lattice(pieces, coded.dictionary.to_pylist())
        n = len(rows)
        seeds = mix(np.asarray(rows.column(0).fill_null(0)).astype(np.int64).view(np.uint64) + np.uint64(base))
        count = np.diff(first)
        place = np.arange(len(index)) - np.repeat(first[:-1], count)
        word_seed = np.repeat(seeds, count)
        search = _Search(lattice, seeds, n)
        alive = np.arange(n)
        top = -np.log(-np.log(uniform(seeds, 999, np.zeros(n, dtype=np.int64))))
        done: list[tuple[np.ndarray, np.ndarray]] = []  # rows and perturbed scores of each sample
        edges, at = lattice.sample(index, word_seed, place, 0)
        search.add(_Paths(lattice, edges, at, at[first]).over(first), alive, top, np.zeros(n, dtype=np.int64), k)
        done.append((alive, top))
        for number in range(1, k):
            fresh, at = lattice.sample(index, word_seed, place, number)
            alive = np.array([i for i in alive.tolist() if search.agenda[i]], dtype=np.int64)
            parts, begins, sizes, scores, turns = [], [], np.zeros(n, dtype=np.int64), [], []
            length = 0
            for i in alive.tolist():
                entry = search.pop(i)
                bound, parent, t, _ = entry
                middle, unit = search.branch(i, entry, number)
                old = search.paths[parent]
                lead = int(old.texts[i])
                own = unit - int(old.unit_range(i)[0]) + int(first[i])  # the unit's number in the slice
                head, tail = old.edges[lead : lead + t], fresh[at[own + 1] : at[first[i + 1]]]
                parts += [head, np.array(middle), tail]
                shift = length + len(head) + len(middle) - at[own + 1]
                low = old.unit_range(i)[0]
                begins += [old.units[low : unit + 1] - lead + length, at[own + 1 : first[i + 1]] + shift]
                sizes[i] = len(head) + len(middle) + len(tail)
                length += int(sizes[i])
                scores.append(-bound)
                turns.append(t + 1)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            whole = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            unit_count = np.where(np.isin(np.arange(n), alive), count, 0)
            paths = _Paths(lattice, whole, np.concatenate([*begins, [length]]).astype(np.int64), ends).over(np.concatenate(([0], np.cumsum(unit_count))))
            top = np.array(scores, dtype=np.float64)
            search.add(paths, alive, top, np.array(turns, dtype=np.int64), k)
            done.append((alive, top))
        kappa = np.array([-x[0][0] if x else -np.inf for x in search.agenda])
        for number, (mine, score) in enumerate(done):
            yield _rows(pieces, lattice, search.paths[number], mine, score, kappa, number, rows, data, offsets)

    def _rows(pieces: Pieces, lattice: Lattice, paths: _Paths, mine: np.ndarray, score: np.ndarray, kappa: np.ndarray, number: int, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids, at = _expanded(pieces, lattice.token[paths.edges], paths.texts)
        total = paths.log_prob()
        out = {"doc_id": rows.column(0).take(pa.array(mine)), "sample": pa.array(np.full(len(mine), number, np.int32)), "n_tokens": pa.array(np.diff(at)[mine]), "log_prob": pa.array(total[mine]), "perturbed": pa.array(score), "inclusion": pa.array(_inclusion(total, kappa)[mine])}
        spans = list(zip(at[mine].tolist(), at[mine + 1].tolist(), strict=True))
        if "text" in wanted or "same" in wanted:
            decoded, bounds = pieces.decode(ids, at)
        for name in wanted:
            if name == "ids":
                values = [ids[s:e].astype(np.int32) for s, e in spans]
            elif name == "ids_crc32":
                flat = ids.astype("<u4")
                values = [zlib.crc32(flat[s:e]) for s, e in spans]
            elif name == "text":
                body = decoded.tobytes()
                values = [body[s:e].decode(errors="replace") for s, e in zip(bounds[mine].tolist(), bounds[mine + 1].tolist(), strict=True)]
            elif len(mine) == len(rows) and np.array_equal(bounds, offsets) and np.array_equal(decoded, data):
                values = np.ones(len(mine), dtype=bool)
            else:
                values = [np.array_equal(decoded[bounds[i] : bounds[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in mine.tolist()]
            out[name] = pa.array(values, _KINDS[name])
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def sample_encode(documents: DataFrame, model: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, wanted: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, sample, n_tokens, log_prob, perturbed, inclusion and the wanted of ids, text (decoded), ids_crc32, same (decoding gives the text back).

    A narrow map: each task holds one slice of SLICE bytes or one longer text at a time.
    """
    small_batches(documents.sparkSession)
    names = {"ids": "ids array<int>", "text": "text string", "ids_crc32": "ids_crc32 long", "same": "same boolean"}
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_sampler(model, k, alpha, seed, wanted), ", ".join([_BASE, *(names[x] for x in wanted)]))


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """The rows with text decoded from ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, 1.0)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = [None if x is None else pieces.decode(np.array(x, dtype=np.int64), np.array([0, len(x)]))[0].tobytes().decode(errors="replace") for x in ids.to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.drop("text").schema)
    return encoded.drop("text").mapInArrow(run, f"{fields}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    found = sample_encode(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"), wanted=("ids_crc32", "same"))
    return found.select("doc_id", "sample", "n_tokens", F.round("log_prob", 6).alias("log_prob"), F.round("perturbed", 6).alias("perturbed"), F.round("inclusion", 6).alias("inclusion"), "ids_crc32", F.col("same").alias("decodes_back"))
