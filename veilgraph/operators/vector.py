"""Exact cosine top-k behind the permission filter, and hybrid retrieval on top of it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.plans.context import Context, secure
from veilgraph.sources.held import held

TOP_K, THRESHOLD = 5, 0.2


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors for tests and offline runs: signed counts of hashed words."""

    def __init__(self, size: int = 32) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                row[code % self.size] += 1.0 if code >> 31 else -1.0
        return out.tolist()


def embed(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """Adds embedding, batch by batch in the order of rows."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(embedding=[np.asarray(v, dtype="float32") for v in embedder.embed(batch[text].tolist())])

    return rows.mapInPandas(run, ", ".join([*names, "embedding array<float>"]))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(vectors: DataFrame, query: list[float], context: Context, namespace: str, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, score): readable vectors only are scored; ties go to the smaller id."""
    own = secure(vectors.where(F.col("namespace") == namespace), context, namespace)
    target = F.array(*[F.lit(float(x)) for x in query])
    norm = float(np.sqrt(sum(float(x) * float(x) for x in query)))
    v = F.col("embedding").cast("array<double>")
    dot = F.aggregate(F.zip_with(v, target, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return own.select("vec_id", (dot / (size * norm)).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "vec_id").limit(k)


#: Probes that are scored at once: their matrix goes to every task.
PROBES = 1_024


def _normal(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size == 0, np.nan, size)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the rows of a list column that have the width and no null."""
    at = np.flatnonzero(pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == width)
    flat = column.take(pa.array(at)).flatten()
    whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), width).any(axis=1)
    return at[whole], flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)[whole]


#: Rows that are scored at once against a block of probes, and decimals that scores have: equal vectors tie, however they are multiplied.
ROWS, DECIMALS = 2_048, 12


def _scored(probe_ids: list, probes: np.ndarray, k: int, threshold: float, cells: dict[int, np.ndarray] | None = None):
    """Best k rows of a task for each probe, over batches (vec_id, embedding) or, with the places of the probes that look into each cell, (vec_id, embedding, cell)."""
    owner, every = np.array(probe_ids, np.int64), np.arange(len(probe_ids))

    def first(pool: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        of, ids, score = map(np.concatenate, zip(*pool, strict=True))
        order = np.lexsort((ids, -score, of))
        of, ids, score = of[order], ids[order], score[order]
        kept = np.arange(len(of)) - np.searchsorted(of, of) < k
        return of[kept], ids[kept], score[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what is below a probe's k-th best so far is left out at once
        least, limit = np.full(len(owner), threshold), max(1 << 17, 4 * k * len(owner))
        pool, held_rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for batch in batches:
            at, rows = _matrix(batch.column(1), probes.shape[1])
            ids, unit = np.asarray(batch.column(0))[at], _normal(rows)
            if cells is None:
                runs = [(np.arange(len(ids)), every)]
            else:
                cell = np.asarray(batch.column(2))[at]
                runs = [(np.flatnonzero(cell == c), cells[c]) for c in np.unique(cell).tolist() if c in cells]
            for mine, asked in runs:
                for begin in range(0, len(mine), ROWS):
                    part = mine[begin : begin + ROWS]
                    scores = unit[part] @ probes[asked].T
                    r, c = np.nonzero((scores >= threshold) & (scores >= least[asked] - 10.0**-DECIMALS))
                    pool.append((asked[c], ids[part[r]], scores[r, c].round(DECIMALS)))
                    held_rows += len(r)
                    if held_rows > limit:
                        of, _, score = best = first(pool)
                        ends = np.flatnonzero(np.bincount(of, minlength=len(owner)) == k)
                        least[ends] = score[np.searchsorted(of, ends, "right") - 1]
                        pool, held_rows = [best], len(of)
        of, ids, score = first(pool)
        yield pa.RecordBatch.from_arrays([pa.array(owner[of]), pa.array(ids), pa.array(score)], names=["probe_id", "vec_id", "score"])

    return run


def blocks_of(probes: DataFrame, width: int | None = None) -> Iterator[tuple[list[int], np.ndarray]]:
    """(ids, unit vectors) of probes(probe_id, embedding) in blocks of about PROBES; vectors have the width given or that of the block's first."""
    asked = held(probes.where("embedding is not null").select(F.col("probe_id").cast("long").alias("probe_id"), "embedding"), "probes")
    blocks = -(-asked.count() // PROBES)
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("probe_id"), F.lit(blocks)) == block).orderBy("probe_id").collect()  # about PROBES rows
        size = width or (len(rows[0]["embedding"]) if rows else 0)
        rows = [r for r in rows if len(r["embedding"]) == size and None not in r["embedding"]]
        if rows:
            yield [r["probe_id"] for r in rows], _normal(np.array([r["embedding"] for r in rows], dtype=np.float64))


def top_k_many(vectors: DataFrame, probes: DataFrame, context: Context, namespace: str, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """(probe_id, vec_id, score, rank): top_k() of every row of probes(probe_id, embedding), exactly.

    Probes go to the tasks in blocks of about PROBES; every task keeps k rows a probe, and the rest is a windowed
    limit.  Vectors and probes that are null, hold a null or have another length than a block's first match nothing.
    """
    own = secure(vectors.where(F.col("namespace") == namespace), context, namespace).select("vec_id", "embedding")
    parts = vectors.sparkSession.createDataFrame([], "probe_id long, vec_id long, score double")
    for ids, matrix in blocks_of(probes):
        parts = parts.union(own.mapInArrow(_scored(ids, matrix, k, threshold), "probe_id long, vec_id long, score double"))
    return _first(parts, k)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def upsert(old: DataFrame, new: DataFrame, order: str = "written") -> DataFrame:
    """vectors after a write: keys of touched ids merged with the stored ones; ids that merge to no key go.

    The embedding and namespace kept are those of the id's last row in new by `order`, a column of new; rows
    written at one time are told apart by their key.
    """
    from veilgraph.functions.keys import merged_key

    touched = new.select("vec_id").distinct()
    keys = old.select("vec_id", "filter_key").union(new.select("vec_id", "filter_key")).join(touched, "vec_id", "left_semi")
    merged = keys.groupBy("vec_id").agg(merged_key(F.col("filter_key")).alias("filter_key")).where("filter_key is not null")
    kept = old.join(touched, "vec_id", "left_anti")
    last = new.groupBy("vec_id").agg(F.max_by(F.struct("namespace", "embedding"), F.struct(order, "filter_key")).alias("last"))
    latest = last.select("vec_id", "last.namespace", "last.embedding").join(merged, "vec_id")
    columns = ("vec_id", "namespace", "filter_key", "embedding")
    return kept.select(*columns).union(latest.select(*columns))


def check_size(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, size): stored vectors that are null or not of the configured size."""
    return vectors.select("vec_id", F.size("embedding").cast("long").alias("size")).where(~F.col("size").eqNullSafe(F.lit(size)))


def unkeyed(rows: DataFrame) -> DataFrame:
    """vec_ids whose keys merge to none: kept as a ledger, since the store holds no row of them; rows(vec_id, filter_key)."""
    from veilgraph.functions.keys import merge_by

    return merge_by(rows, "vec_id").where("filter_key is null").select("vec_id")


def hybrid_context(entity_hits: DataFrame, edge_hits: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """(he_id, score, degree, rank): hyperedges hit themselves or through an entity, by score, then degree, then id.

    entity_hits(entity_id, score), edge_hits(he_id, score); edges are the visible ones.  The list is
    a report of `budget` rows.
    """
    links = edges.select("he_id", "entity_id").distinct()
    through = links.join(entity_hits, "entity_id").select("he_id", "score")
    best = edge_hits.select("he_id", "score").union(through).groupBy("he_id").agg(F.max("score").alias("score"))
    degree = links.join(best.select("he_id"), "he_id", "left_semi").groupBy("he_id").agg(F.count("*").alias("degree"))
    return best.join(degree, "he_id").orderBy(F.desc("score"), F.desc("degree"), "he_id").limit(budget)
