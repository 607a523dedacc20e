"""Vector code compression: product codebooks trained by Lloyd rounds with partition-local bound heaps.

Vectors are cut into PARTS equal parts, each coded by the nearest of up to ENTRIES codebook entries.
Kept vectors are packed into blocks of BLOCK rows, written once.  A block keeps, for every part and
entry, a binary heap of the parts assigned to that entry, keyed by slack: the distance to the second
nearest entry less the distance to the nearest, raised by the drift that the entry had already
gathered when the part was put in.  When entries move, an entry's drift grows by its own move and the
greatest move of the others.  A part whose key exceeds the drift still has its entry strictly nearest;
only the top of the heap, down to the drift, is popped and compared with all entries exactly (integers,
ties to the lower index).  Sums for the next round are kept up with what was reassigned.  A round is
one pass over blocks and one small aggregation (PARTS x ENTRIES x part length numbers).

Rules for odd input: a row whose vector is null, empty or holds null or non-finite components is
dropped; so is a vector of another length than the kept one of the smallest vec_id, or of a length that
PARTS does not divide.  Rows of equal vec_id are coded each by itself; for the starting entries rows are
ordered by vec_id, null ones last, then by vector.  Fewer than ENTRIES kept rows give as many entries.
Components saturate at 65,536 either way, so that all sums are exact.  Null labels form one group.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.shared import small_batches, table, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Greatest absolute value of a scaled component.
BOUND = 1 << 24
#: Vectors of a block: its matrix and heaps are the memory of a task, a few MB at 64 components.
BLOCK = 4_096
#: Room for rounding of distances of up to 2**27: a part within it of the drift is compared anew.
SLOP = 1e-3

_ITEM = "vec_id long, label long, parts array<int>"
_BLOCK = "vec_ids array<long>, labels array<long>, vectors binary, codes binary, sizes array<int>, keys binary, members binary, sums array<long>, counts array<long>"


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, parts): kept rows with components floor(SCALE * x)."""
    small_batches(embeddings.sparkSession)
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    bounded = F.transform("x", lambda v: F.greatest(F.least(F.floor(v * SCALE), F.lit(BOUND)), F.lit(-BOUND)).cast("int"))
    kept = x.where(F.col("x").isNotNull() & fine).where(F.size("x") > 0).where(F.size("x") % PARTS == 0)
    return kept.select("vec_id", "label", bounded.alias("parts"))


def _first_entries(kept: DataFrame) -> np.ndarray | None:
    """Starting codebooks (PARTS, entries, length) from the ENTRIES smallest vec_ids; None without rows."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("parts")]
    first = kept.orderBy(*order).select("parts").first()
    if first is None:
        return None
    rows = kept.where(F.size("parts") == len(first[0])).orderBy(*order).limit(ENTRIES).select("parts").collect()
    found = np.array([r[0] for r in rows], dtype=np.int64)
    return np.ascontiguousarray(found.reshape(len(found), PARTS, -1).transpose(1, 0, 2))


def _nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each point (lowest index among ties), its squared distance, and the slack to the second nearest."""
    code, error, slack = np.zeros(len(points), np.uint8), np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    for at in range(0, len(points), 1024):
        here = points[at : at + 1024]
        squared = np.zeros((len(here), len(book)), np.int64)
        for k in range(book.shape[1]):
            squared += (here[:, k, None] - book[None, :, k]) ** 2
        best = squared.argmin(axis=1)
        low = squared[np.arange(len(here)), best]
        code[at : at + 1024], error[at : at + 1024] = best, low
        if len(book) > 1:
            slack[at : at + 1024] = np.sqrt(np.partition(squared, 1, axis=1)[:, 1].astype(np.float64)) - np.sqrt(low.astype(np.float64))
    return code, error, slack


def pop_violated(keys: np.ndarray, drift: float) -> np.ndarray:
    """Places in a binary heap whose key does not exceed drift: from the root down, only below places that are popped themselves."""
    popped, frontier = [], np.zeros(min(len(keys), 1), dtype=np.int64)
    while len(frontier):
        out = frontier[keys[frontier] <= drift]
        popped.append(out)
        below = np.concatenate((2 * out + 1, 2 * out + 2))
        frontier = below[below < len(keys)]
    return np.concatenate(popped) if popped else frontier


class _Block:
    """Vectors of a block with codes, heaps and sums, between its stored row and the work on it."""

    def __init__(self, vectors: np.ndarray, entries: int) -> None:
        self.vectors = vectors  # (rows, PARTS, length)
        n, _, length = vectors.shape
        self.codes = np.zeros((PARTS, n), np.uint8)
        self.heaps = [[(np.zeros(0), np.zeros(0, np.int32)) for _ in range(entries)] for _ in range(PARTS)]
        self.sums, self.counts = np.zeros((PARTS, entries, length), np.int64), np.zeros((PARTS, entries), np.int64)

    @classmethod
    def stored(cls, row: dict, length: int) -> _Block:
        vectors = np.frombuffer(row["vectors"], "<i4").reshape(-1, PARTS, length).astype(np.int64)
        entries = len(row["sizes"]) // PARTS
        self = cls(vectors, entries)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(PARTS, -1).copy()
        keys, members, at = np.frombuffer(row["keys"], "<f8"), np.frombuffer(row["members"], "<i4"), np.concatenate(([0], np.cumsum(row["sizes"])))
        self.heaps = [[(keys[at[i] : at[i + 1]], members[at[i] : at[i + 1]]) for i in range(p * entries, (p + 1) * entries)] for p in range(PARTS)]
        self.sums, self.counts = np.array(row["sums"], np.int64).reshape(PARTS, entries, length), np.array(row["counts"], np.int64).reshape(PARTS, entries)
        return self

    def assign(self, books: np.ndarray, drift: np.ndarray, fresh: bool) -> None:
        """Pop what drift has violated (all, if fresh), rescan it against all entries and push it where it belongs."""
        for p in range(PARTS):
            if fresh:
                rescan, rest = np.arange(len(self.vectors)), self.heaps[p]
            else:
                gone = [pop_violated(keys, drift[p, e] + SLOP) for e, (keys, _) in enumerate(self.heaps[p])]
                rescan = np.concatenate([members[g] for g, (_, members) in zip(gone, self.heaps[p], strict=True)])
                rest = [(np.delete(k, g), np.delete(m, g)) if len(g) else (k, m) for g, (k, m) in zip(gone, self.heaps[p], strict=True)]
            if not len(rescan):
                continue
            points = self.vectors[rescan, p]
            code, _, slack = _nearest(points, books[p])
            if not fresh:
                old = self.codes[p, rescan]
                np.subtract.at(self.sums[p], old, points)
                np.subtract.at(self.counts[p], old, 1)
            np.add.at(self.sums[p], code, points)
            np.add.at(self.counts[p], code, 1)
            self.codes[p, rescan] = code
            key = slack + drift[p, code]
            touched = {e for e, g in enumerate(gone) if len(g)} if not fresh else set()
            order = np.lexsort((key, code))
            edges = np.searchsorted(code[order], np.arange(len(rest) + 1))
            for e in touched | set(np.unique(code).tolist()):
                new = order[edges[e] : edges[e + 1]]
                keys, members = np.concatenate((rest[e][0], key[new])), np.concatenate((rest[e][1], rescan[new].astype(np.int32)))
                up = np.argsort(keys, kind="stable")  # an ascending array is a heap
                rest[e] = keys[up], members[up]
            self.heaps[p] = rest

    def row(self) -> dict:
        flat = [h for heaps in self.heaps for h in heaps]
        return {
            "vectors": self.vectors.astype("<i4").tobytes(), "codes": self.codes.tobytes(), "sizes": [len(k) for k, _ in flat],
            "keys": np.concatenate([k for k, _ in flat]).astype("<f8").tobytes(), "members": np.concatenate([m for _, m in flat]).astype("<i4").tobytes(),
            "sums": self.sums.ravel().tolist(), "counts": self.counts.ravel().tolist(),
        }


def _schema() -> pa.Schema:
    long = pa.list_(pa.int64())
    return pa.schema([("vec_ids", long), ("labels", long), ("vectors", pa.binary()), ("codes", pa.binary()), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("members", pa.binary()), ("sums", long), ("counts", long)])


def _build(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            ids, labels, column = rows.column(0), rows.column(1), rows.column(2)
            vectors = np.asarray(column.flatten()).astype(np.int64).reshape(len(rows), PARTS, -1)
            block = _Block(vectors, books.shape[1])
            block.assign(books, np.zeros(books.shape[:2]), fresh=True)
            yield pa.RecordBatch.from_pylist([{"vec_ids": ids.to_pylist(), "labels": labels.to_pylist()} | block.row()], _schema())

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to BLOCK rows; the last of a task may be shorter."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) >= BLOCK:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield whole.slice(0, BLOCK).to_batches()[0]
            held = whole.slice(BLOCK).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _again(books: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block.stored(row, books.shape[2])
                block.assign(books, drift, fresh=False)
                yield pa.RecordBatch.from_pylist([{"vec_ids": row["vec_ids"], "labels": row["labels"]} | block.row()], _schema())

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["codes"], np.uint8).reshape(PARTS, -1)
                vectors = np.frombuffer(row["vectors"], "<i4").reshape(-1, PARTS, books.shape[2])
                error = np.zeros(len(vectors), np.int64)
                for p in range(PARTS):
                    error += ((vectors[:, p].astype(np.int64) - books[p][codes[p]]) ** 2).sum(axis=1)
                text = np.ascontiguousarray(codes.T).tobytes().hex()
                code = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each used entry at the floored mean of its parts; sums come to the driver as at most books.size numbers."""
    total = np.zeros(books.size, np.int64)
    for r in blocks.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r["i"]] = r["v"]
    count = np.zeros(books.shape[0] * books.shape[1], np.int64)
    for r in blocks.select(F.posexplode("counts").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        count[r["i"]] = r["v"]
    total, count = total.reshape(books.shape), count.reshape(books.shape[:2])[..., None]
    return np.where(count > 0, total // np.maximum(count, 1), books)


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much each entry's slack may have shrunk: its own move and the greatest move of the part's other entries."""
    move = np.sqrt(((new - old) ** 2).sum(axis=2).astype(np.float64))
    if move.shape[1] == 1:
        return move
    top = np.sort(move, axis=1)[:, -2:]
    return move + np.where(np.arange(move.shape[1]) == move.argmax(axis=1)[:, None], top[:, :1], top[:, 1:])


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error), codebooks (PARTS, entries, length)); codebooks None without kept rows."""
    kept = written(scaled(embeddings), "scaled")
    books = _first_entries(kept)
    if books is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    width = books.shape[0] * books.shape[2]
    blocks = written(kept.where(F.size("parts") == width).mapInArrow(_build(books), _BLOCK), "blocks")
    drift = np.zeros(books.shape[:2])
    for _ in range(rounds):
        now = _moved(blocks, books)
        drift, books = drift + _drift(books, now), now
        blocks = written(blocks.mapInArrow(_again(books, drift), _BLOCK), "blocks")
    return blocks.mapInArrow(_codes(books), "vec_id long, label long, code string, error long"), books


def op11_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = written(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest() if books is not None else None
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
