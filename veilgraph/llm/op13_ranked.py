"""Ranked lexical search: document-at-a-time over compressed postings, one index shard at a time.

An index is one row a shard: a run of whole documents, their ids in ascending order with their lengths,
the sorted hashes of their terms, and for each term its postings in blocks of up to POSTINGS entries, gaps
and frequencies as variable-length bytes, with the first document of every block beside them.  Nothing
is shuffled to build or to search it.  A query term's document count, the number of documents and their
length are summed over all shards first.  Then every shard is searched for every item by itself: a heap
holds the next block of each of the item's terms by its first document; blocks are taken in that order and
decoded, and when no block left starts within the window of SPAN documents, all documents of the window
are complete and scored together.  A result heap of the K best by score, then smaller doc_id, goes on from
shard to shard within a task; Spark's windowed limit merges the tasks.

Items are searched in blocks of about BLOCK_CHARS characters: only a block's terms go to the tasks.

Rules for odd input: a null text has no terms and is no document; rows of equal doc_id rank each by
itself; a null doc_id comes after all others of its score; an item without terms has no rows; items are
ranked row by row, so repeated ones give repeated rows; other columns are ignored; an empty table gives no
rows; a very long text is indexed whole, in memory of its own size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.shared import small_batches, table, work_path, written
from veilgraph.llm.textbatch import ALNUM_WORDS, LOWER, raw, slices, strings, words_of

TOP = 20
SHARD_CHARS = 8 << 20
POSTINGS = 512
SPAN = 4_096
BLOCK_CHARS = 2_000_000
TERM_BITS = 100, 25  # saturation: 100 - 25 + 25 * length over mean length

_INDEX = "ids array<long>, sizes array<long>, terms binary, dfs binary, firsts binary, body_ends binary, body binary"
_LAST = np.iinfo(np.int64).max


# ---- compressed postings


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian base-128 bytes of non-negative integers, and the number of bytes of each."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << (7 * k)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[(end - size)[has] + k] = (values[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, size


def from_bytes(body: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(body < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out, size = np.zeros(len(last), np.int64), last - first + 1
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[has] |= (body[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def shard(ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, docs: np.ndarray, hashes: np.ndarray) -> dict:
    """Index row of some documents: docs and hashes give each word's document and term."""
    order = np.lexsort((ids, ~known))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.lexsort((place[docs], hashes))
    term, doc = hashes[by], place[docs][by]
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))) if len(term) else np.zeros(0, np.int64)
    tf, term, doc = np.diff(np.concatenate((new, [len(term)]))), term[new], doc[new]
    head = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else new
    df = np.diff(np.concatenate((head, [len(term)])))
    within = np.arange(len(term)) - np.repeat(head, df)
    start = within % POSTINGS == 0
    gap = np.where(start, 0, np.concatenate(([0], np.diff(doc)))) if len(doc) else doc
    body, size = to_bytes(np.stack((gap, tf), axis=1).ravel())
    ends = np.cumsum(size)[1::2]
    block = np.flatnonzero(start)
    block_last = np.concatenate((block[1:], [len(doc)])) - 1 if len(block) else block
    return {
        "ids": [int(i) if k else None for i, k in zip(ids[order].tolist(), known[order].tolist(), strict=True)], "sizes": lengths[order].tolist(), "terms": term[head].tobytes(), "dfs": df.astype("<i4").tobytes(),
        "firsts": doc[block].astype("<i4").tobytes(), "body_ends": ends[block_last].astype("<i8").tobytes(), "body": body.tobytes(),
    }


def _schema() -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))] + [(k, pa.binary()) for k in ("terms", "dfs", "firsts", "body_ends", "body")])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple] = []
    held = docs = 0

    def emit() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_pylist([shard(*columns)], _schema())

    for batch in batches:
        for rows, data, offsets in slices(batch):
            words = words_of(LOWER[data], offsets, ALNUM_WORDS)
            lengths = np.diff(words.first)
            some = lengths > 0
            number = np.cumsum(some) - 1 + docs
            key = rows.column(0)
            parts.append((np.asarray(key.fill_null(0))[some], np.asarray(key.is_valid())[some], lengths[some], number[words.row()], words.hash))
            docs, held = docs + int(some.sum()), held + len(data)
            if held >= SHARD_CHARS:
                yield emit()
                parts, held, docs = [], 0, 0
    if docs:
        yield emit()


def write_index(documents: DataFrame, path: str) -> DataFrame:
    """Index all documents into path, a shard for every SHARD_CHARS bytes of text of a task; returns it as read back."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows.mapInArrow(_index, _INDEX).write.parquet(path)
    return documents.sparkSession.read.schema(_INDEX).parquet(path)


# ---- search


def _frequencies(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                have, df = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["dfs"], "<i4")
                at = np.searchsorted(have, terms)
                at[at == len(have)] = 0
                found = have[at] == terms
                total[found] += df[at[found]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["term", "df"])

    return run


class Shard:
    """A shard opened for search: block boundaries of each term and decoded blocks of the terms in use."""

    def __init__(self, row: dict, documents: int, words: int) -> None:
        self.ids = row["ids"]
        self.terms, df = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["dfs"], "<i4").astype(np.int64)
        blocks = np.concatenate(([0], np.cumsum(-(-df // POSTINGS))))
        self.low, self.high = blocks[:-1], blocks[1:]
        self.firsts, self.ends = np.frombuffer(row["firsts"], "<i4").tolist(), np.concatenate(([0], np.frombuffer(row["body_ends"], "<i8"))).tolist()
        self.body = np.frombuffer(row["body"], np.uint8)
        sizes = np.array(row["sizes"], np.int64)
        base, share = TERM_BITS
        self.norm = 12 * (base - share + share * sizes * documents // words)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what a term of weight one adds to each."""
        if b not in self.open:
            pairs = from_bytes(self.body[self.ends[b] : self.ends[b + 1]])
            docs, tf = np.cumsum(pairs[::2]) + self.firsts[b], pairs[1::2]
            self.open[b] = docs, 1_000_000_000 * tf // (1000 * tf + self.norm[docs])
        return self.open[b]

    def scored(self, terms: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, scores) of each window of SPAN documents, for (place in self.terms, weight) of an item."""
        cursors = [(self.firsts[self.low[t]], self.low[t], self.high[t], w) for t, w in terms]
        heapq.heapify(cursors)
        over: list[tuple[np.ndarray, np.ndarray]] = []  # postings decoded but past their window
        while cursors or over:
            start = min([c[0] for c in cursors[:1]] + [int(docs[0]) for docs, _ in over]) // SPAN * SPAN
            end = start + SPAN
            while cursors and cursors[0][0] < end:
                _, at, high, weight = cursors[0]
                docs, part = self.block(at)
                over.append((docs, part * weight))
                if at + 1 < high:
                    heapq.heapreplace(cursors, (self.firsts[at + 1], at + 1, high, weight))
                else:
                    heapq.heappop(cursors)
            scores, later = np.zeros(min(SPAN, len(self.ids) - start), np.int64), []
            inside: list[tuple[np.ndarray, np.ndarray]] = []
            for docs, part in over:
                cut = len(docs) if docs[-1] < end else int(np.searchsorted(docs, end))
                if cut:
                    inside.append((docs[:cut], part[:cut]))
                if cut < len(docs):
                    later.append((docs[cut:], part[cut:]))
            # exact: sums stay far below 2**53
            total = np.bincount(np.concatenate([d for d, _ in inside]) - start, weights=np.concatenate([p for _, p in inside]), minlength=len(scores))
            yield start, total.astype(np.int64)
            over = later


def _search(terms: np.ndarray, weights: np.ndarray, items: list[tuple[int, list[tuple[int, int]]]], documents: int, words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int, int]]] = {number: [] for number, _ in items}  # (score, smaller id first, null ids last)
        for batch in batches:
            for row in batch.to_pylist():
                here = Shard(row, documents, words)
                at = np.searchsorted(here.terms, terms)
                at[at == len(here.terms)] = 0
                place = np.where((here.terms[at] == terms) & (weights > 0), at, -1).tolist()
                for number, own in items:
                    have = [(place[t], int(weights[t]) * n) for t, n in own if place[t] >= 0]
                    heap = best[number]
                    for start, scores in here.scored(have) if have else ():
                        bar = heap[0][0] if len(heap) == k else 1
                        good = np.flatnonzero(scores >= bar)
                        if len(good) > k:  # only the k best of a window can stay; equal scores keep their order
                            cut = np.partition(scores[good], len(good) - k)[len(good) - k]
                            sure, tied = good[scores[good] > cut], good[scores[good] == cut]
                            good = np.concatenate((sure, tied[: k - len(sure)]))
                        for d, score in zip((good + start).tolist(), scores[good].tolist(), strict=True):
                            key = here.ids[d]
                            entry = (score, -key if key is not None else -_LAST - 1, key is not None)
                            if len(heap) < k:
                                heapq.heappush(heap, entry)
                            elif entry > heap[0]:
                                heapq.heapreplace(heap, entry)
        found = [(number, -key if real else None, score) for number, heap in best.items() for score, key, real in heap]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["item_no", "doc_id", "score"])

    return run


def _query(texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Distinct term hashes of some short texts, and for each text its (term number, occurrences)."""
    data, offsets = raw(strings(pa.array(texts, pa.large_string())))
    words = words_of(LOWER[data], offsets, ALNUM_WORDS)
    terms, number = np.unique(words.hash, return_inverse=True)
    own = []
    for low, high in zip(words.first[:-1], words.first[1:], strict=True):
        which, n = np.unique(number[low:high], return_counts=True)
        own.append(list(zip(which.tolist(), n.tolist(), strict=True)))
    return terms, own


def ranked(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of index for each row of items (item_id, text)."""
    spark = index.sparkSession
    kept = written(items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    size = kept.agg(F.sum(F.char_length("text") + 32)).first()[0] or 0
    whole = index.select(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    blocks, parts = -(-size // BLOCK_CHARS), []
    rows = "item_no int, doc_id long, score long"
    for block in range(blocks if whole["n"] else 0):
        texts = kept.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()  # about BLOCK_CHARS characters
        terms, own = _query([r["text"] for r in texts])
        df = np.zeros(len(terms), np.int64)
        for r in index.select("terms", "dfs").mapInArrow(_frequencies(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * whole["n"] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        found = index.mapInArrow(_search(terms, weights, list(enumerate(own)), whole["n"], whole["l"], k), rows)
        names = spark.createDataFrame(pd.DataFrame({"item_no": np.arange(len(texts), dtype=np.int32), "row": [r["row"] for r in texts]}), "item_no int, row long")
        parts.append(written(found.join(F.broadcast(names), "item_no").drop("item_no"), "found"))  # names: the block's items
    if not parts:
        return kept.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(kept.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_index(table(spark, sf_dir, "documents"), work_path(spark, "ranked-index"))
    return ranked(index, table(spark, sf_dir, "benchmark"))
