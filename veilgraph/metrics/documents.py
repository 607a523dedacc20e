"""Scores of whole documents inside tasks: loops over the facts of one document after the other.

A fact is (fact_id, its folded slots in role order); documents of more than GROUP facts are left to `scoring`'s joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.text import fold_py
from veilgraph.model import SLOTS
from veilgraph.sources.held import held

#: Facts of a document, of both sides, that one task compares.
GROUP = 400

MISSING, EXTRA = "missing", "extra"
Fact = tuple[str, tuple[str | None, ...]]
Score = Callable[[list[Fact], list[Fact]], Iterable[tuple]]


def agree(a: str | None, b: str | None) -> str | None:
    if a is None or b is None:
        return None
    return "exact" if a == b else "loose" if a in b or b in a else None


def match_slots(gold: tuple[str | None, ...], pred: tuple[str | None, ...]) -> list[tuple[int, int, str]]:
    """`scoring.slot_matches` of one pair: (place in gold, place in pred, kind)."""
    kinds = [agree(g, p) for g, p in zip(gold, pred, strict=True)]
    hits = [(i, i, kind) for i, kind in enumerate(kinds) if kind]
    golds = [i for i, g in enumerate(gold) if g is not None and not kinds[i]]
    preds = [j for j, p in enumerate(pred) if p is not None and not kinds[j]]
    for kind in ("exact", "loose"):
        left = []
        for i in golds:
            j = next((j for j in preds if agree(gold[i], pred[j]) == kind), None)
            if j is None:
                left.append(i)
            else:
                preds.remove(j)
                hits.append((i, j, kind))
        golds = left
    return hits


def _candidates(golds: list[Fact], preds: list[Fact]) -> Iterator[tuple[Fact, Fact, list[tuple[int, int, str]]]]:
    for g in golds:
        for p in preds:
            if agree(g[1][0], p[1][0]):
                yield g, p, match_slots(g[1], p[1])


def scored_candidates(golds: list[Fact], preds: list[Fact]) -> Iterator[tuple]:
    for g, p, hits in _candidates(golds, preds):
        yield g[0], p[0], sum(i == j for i, j, _ in hits), len(hits)


def _rest(fact: Fact, used: set[int]) -> Iterator[str]:
    return (SLOTS[i] for i, v in enumerate(fact[1]) if v is not None and i not in used)


def pair_level(golds: list[Fact], preds: list[Fact]) -> Iterator[tuple]:
    order = sorted(_candidates(golds, preds), key=lambda c: (-sum(i == j for i, j, _ in c[2]), -len(c[2]), c[1][0], c[0][0]))
    taken_g, taken_p = {}, {}
    for g, p, hits in order:
        if g[0] not in taken_g and p[0] not in taken_p:
            taken_g[g[0]], taken_p[p[0]] = {i for i, _, _ in hits}, {j for _, j, _ in hits}
            for i, j, kind in hits:
                yield SLOTS[i], SLOTS[j], kind
    for g in golds:
        for role in _rest(g, taken_g.get(g[0], set())):
            yield role, MISSING, MISSING
    for p in preds:
        for role in _rest(p, taken_p.get(p[0], set())):
            yield EXTRA, role, EXTRA


def document_level(golds: list[Fact], preds: list[Fact]) -> Iterator[tuple]:
    gold = [sorted((f[0], f[1][i]) for f in golds if f[1][i] is not None) for i in range(len(SLOTS))]
    pred = [sorted((f[0], f[1][i]) for f in preds if f[1][i] is not None) for i in range(len(SLOTS))]
    lost, more = [], []
    for i, role in enumerate(SLOTS):
        by_value: dict[str, list[str]] = {}
        for name, value in reversed(pred[i]):
            by_value.setdefault(value, []).append(name)
        left_g, used = [], set()
        for name, value in gold[i]:
            if by_value.get(value):
                used.add(by_value[value].pop())  # the smallest id still free
                yield role, role, "exact"
            else:
                left_g.append((name, value))
        left_p = [x for x in pred[i] if x[0] not in used]
        for _, value in left_g:
            j = next((j for j, x in enumerate(left_p) if agree(value, x[1]) == "loose"), None)
            if j is None:
                lost.append((i, value))
            else:
                del left_p[j]
                yield role, role, "loose"
        more += [(i, name) for name, _ in left_p]
    blamed = set()
    for i, value in lost:
        kinds = [(kind, j, name) for j, cells in enumerate(pred) for name, v in cells if (kind := agree(value, v))]
        far, near = min((k for k in kinds if k[1] != i), default=None), min((k[0] for k in kinds if k[1] == i), default=None)
        if far:
            blamed.add(far[1:])
            yield SLOTS[i], SLOTS[far[1]], "confused"
        else:
            yield SLOTS[i], MISSING, {"exact": "repeated", "loose": "used", None: MISSING}[near]
    for i, name in more:
        if (i, name) not in blamed:
            yield EXTRA, SLOTS[i], EXTRA


def folded(column: pa.Array, empty: str | None = None) -> list[str | None]:
    coded = column.dictionary_encode()  # each distinct value of a batch is folded once
    values = [fold_py(v) or empty for v in coded.dictionary.to_pylist()]
    return [None if c is None else values[c] for c in coded.indices.to_pylist()]


def _facts(batch: pa.RecordBatch) -> Iterator[tuple]:
    slots = zip(*(folded(batch.column(i)) for i in range(3, batch.num_columns)), strict=True)
    ids = (batch.column(i).to_pylist() for i in range(3))
    return ((doc, side, (name, values)) for doc, side, name, values in zip(*ids, slots, strict=True))


def plain_facts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Facts with their values as they are, not folded."""
    doc, side, name, *slots = (column.to_pylist() for column in batch.columns)
    return ((d, s, (n, v)) for d, s, n, v in zip(doc, side, name, zip(*slots, strict=True), strict=True))


def by_shared_values(golds: list[Fact], preds: list[Fact]) -> Iterator[tuple]:
    """(gold_id, pred_id, score): pairs by falling number of equal values in a role, then ids, each fact once."""
    pairs = ((sum(a is not None and a == b for a, b in zip(g[1], p[1], strict=True)), g[0], p[0]) for g in golds for p in preds)
    left, right = set(), set()
    for n, gold, pred in sorted((x for x in pairs if x[0]), key=lambda x: (-x[0], x[1], x[2])):
        if gold not in left and pred not in right:
            left.add(gold)
            right.add(pred)
            yield gold, pred, float(n)


def stream(read: Callable[[pa.RecordBatch], Iterable[tuple]], score: Callable[[list, list], Iterable[tuple]], schema: pa.Schema):
    """For mapInArrow over rows sorted by document: read(batch) gives (document, side, item), score(items of side 0, items of side 1) a document's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, ([], []), []

        def close() -> None:
            if sides[0] or sides[1]:
                out.extend((key, *row) for row in score(*sides))

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, side, item in read(batch):
                if doc != key or doc is None:  # rows without a document meet nothing
                    close()
                    key, sides = doc, ([], [])
                sides[side].append(item)
            yield flush()
            out = []
        close()
        yield flush()

    return run


def _codes(*sides: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The distinct folded values of all sides, and each side as places in them; -1 is no value."""
    coded = pa.chunked_array([x.cast(pa.string()) for x in sides]).dictionary_encode().unify_dictionaries()
    place: dict[str, int] = {}
    known = [place.setdefault(v, len(place)) if (v := fold_py(x)) else -1 for x in coded.chunk(0).dictionary.to_pylist()]
    lookup = np.array([*known, -1], dtype=np.int64)
    return list(place), [lookup[pc.fill_null(c.indices, len(known)).to_numpy(zero_copy_only=False)] for c in coded.chunks]


def _agreeing(values: list[str], gold: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Whether values at these places agree: each distinct pair is compared once."""
    fits = (gold == pred) & (gold >= 0)
    open_ = np.flatnonzero(~fits & (gold >= 0) & (pred >= 0))
    pairs, where = np.unique(gold[open_] * len(values) + pred[open_], return_inverse=True)
    each = ((values[p // len(values)], values[p % len(values)]) for p in pairs.tolist())
    fits[open_] = np.fromiter((a in b or b in a for a, b in each), bool, len(pairs))[where]
    return fits


def _same_roles(rows: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
    """The candidates of whole documents, one after the other of these sizes, and how many slots of one role agree."""
    key, *sides = rows.columns
    (gold_id, *golds), (pred_id, *preds) = sides[: len(sides) // 2], sides[len(sides) // 2 :]
    many = np.repeat(sizes, sizes)  # each row meets the rows of its document
    gold = np.repeat(np.arange(rows.num_rows), many)
    pred = np.arange(len(gold)) + np.repeat(np.repeat(np.cumsum(sizes) - sizes, sizes) - (np.cumsum(many) - many), many)
    n_same = 0
    for i, (g, p) in enumerate(zip(golds, preds, strict=True)):
        values, (g_codes, p_codes) = _codes(g, p)
        fits = _agreeing(values, g_codes[gold], p_codes[pred])
        if i == 0:  # subjects decide which pairs there are
            gold, pred, fits = gold[fits], pred[fits], fits[fits]
        n_same = n_same + fits.astype(np.int64)
    columns = {rows.schema.names[0]: key.take(pa.array(gold)), "gold_id": gold_id.take(pa.array(gold)), "pred_id": pred_id.take(pa.array(pred)), "n_same": pa.array(n_same)}
    return pa.RecordBatch.from_pydict(columns)


#: Pairs of rows that are compared at once, but for those of one document.
PAIRS = 1 << 20


def same_roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over document, gold id and slots, pred id and slots, sorted by document: `scored_candidates` with n_same alone, for many documents at once."""

    def scored(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(starts, append=rows.num_rows)
        for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes**2) // PAIRS)) + 1):
            if len(some):
                yield _same_roles(rows.slice(starts[some[0]], sizes[some].sum()), sizes[some])

    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        starts = np.flatnonzero(np.diff(rows.column(0).dictionary_encode().indices.to_numpy(), prepend=-1))
        if len(starts):
            rest = rows.slice(starts[-1])  # its document may go on
            yield from scored(rows.slice(0, starts[-1]), starts[:-1])
    if rest is not None:
        yield from scored(rest, np.zeros(1, dtype=np.int64))


def large_documents(one: DataFrame, two: DataFrame | None = None) -> DataFrame:
    """(doc_key): documents with more than GROUP rows on both sides together; without two, rows of one stand for both sides."""
    every = (one.select("doc_key") if two is None else one.select("doc_key").union(two.select("doc_key"))).where("doc_key is not null")
    n = F.count("*") * (2 if two is None else 1)
    return held(every.groupBy("doc_key").agg(n.alias("n")).where(F.col("n") > GROUP).select("doc_key"), "large-documents")


def by_document(gold: DataFrame, pred: DataFrame, score: Score, fields: str, joined: Callable[[DataFrame, DataFrame], DataFrame], read: Callable[[pa.RecordBatch], Iterable[tuple]] = _facts) -> DataFrame:
    """(doc_key, fields): score of every document; both sides are shuffled once, by document.  joined(gold, pred) gives the same rows of documents larger than GROUP."""
    large = large_documents(gold, pred)
    rest = None
    if not large.isEmpty():
        rest = joined(gold.join(large, "doc_key", "left_semi"), pred.join(large, "doc_key", "left_semi"))
        gold, pred = gold.join(large, "doc_key", "left_anti"), pred.join(large, "doc_key", "left_anti")
    rows = gold.select("doc_key", F.lit(0).alias("side"), "fact_id", *SLOTS).union(pred.select("doc_key", F.lit(1).alias("side"), "fact_id", *SLOTS))
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(name, types[kind]) for name, kind in (f.split() for f in f"doc_key string, {fields}".split(", "))])
    out = rows.repartition("doc_key").sortWithinPartitions("doc_key").mapInArrow(stream(read, score, schema), f"doc_key string, {fields}")
    return out if rest is None else out.union(rest)
