"""Substring dedup: winnowed anchors joined across documents, extended both ways, merged to maximal repeats.

A window is LENGTH consecutive words.  Every window has one winnowed anchor: the leftmost smallest
ANCHOR-word hash inside it, which depends on the window's words only.  The windows of one anchor
occurrence are consecutive, so an occurrence extended both ways to its outermost windows is a
segment; equal segments share all their windows.  Segments of one anchor that differ are compared
window by window, which finds the part of the extension that does match.  Consecutive matched
windows merge into maximal repeats of at least LENGTH words.

Rules for odd input: a null or word-less text has no words and nothing removed; texts under LENGTH
words lose nothing (tk, a hash of the text, tells rows of one doc_id apart); repeats inside one document are no reason to remove; rows with equal doc_id are
kept apart but never remove each other; a null doc_id is kept whole; a very long text is cut into
segments whole, in memory of its own size; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.shared import small_batches, table, written
from veilgraph.llm.textbatch import SPACE_WORDS, Words, gram_hash, lists, slices, span_hash, words_of

LENGTH = 50
ANCHOR = 8


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest entry in each run of `width` entries, by doubling."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        first = left <= right
        best, at = np.where(first, left, right), np.where(first, at[:-step], at[step:])
        span += step
    return at


def _windows(words: Words, length: int) -> np.ndarray:
    """Starts of all windows that lie in one text."""
    starts = np.arange(max(len(words.start) - length + 1, 0))
    return starts[words.row()[starts] == words.row()[starts + length - 1]] if len(starts) else starts


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                words = words_of(data, offsets, SPACE_WORDS)
                window = _windows(words, length)
                if not len(window):
                    continue
                grams = gram_hash(words, ANCHOR)
                anchor = _leftmost_min(grams, length - ANCHOR + 1)[window]
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)))
                first = np.flatnonzero(new)
                begin, last = window[first], window[np.concatenate((first[1:] - 1, [len(window) - 1]))]
                at = anchor[first]
                row = words.row()[begin]
                # the segment's hash also tells where its anchor lies
                seg = span_hash(words.hash, begin, last + length, second=True) + (at - begin).astype(np.uint64)
                base = words.first[row]
                keys = [rows.column(k).take(pa.array(row)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(grams[at].view(np.int64)), pa.array(seg.view(np.int64)), pa.array((begin - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], names=["doc_id", "tk", "anchor", "seg", "a", "b"])

    return run


def _expand(length: int):
    """One row per window of the listed segments: their hash, with the anchor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                words = words_of(data, offsets, SPACE_WORDS)
                todo = rows.column(rows.schema.get_field_index("todo"))
                if isinstance(todo, pa.ChunkedArray):
                    todo = todo.combine_chunks()
                flat = todo.flatten()
                row = np.repeat(np.arange(len(rows)), np.asarray(todo.value_lengths()))
                a, b = np.asarray(flat.field("a")).astype(np.int64), np.asarray(flat.field("b")).astype(np.int64)
                each = b - a + 1
                start = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(a, each)
                at = start + np.repeat(words.first[row], each)
                key = span_hash(words.hash, at, at + length)
                yield pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(np.repeat(row, each))) for k in (0, 1)), pa.array(np.repeat(np.asarray(flat.field("anchor")), each)), pa.array(key.view(np.int64)), pa.array(start.astype(np.int32))], names=["doc_id", "tk", "anchor", "win", "a"])

    return run


def _covered(words: Words, hits: pa.Array, length: int) -> np.ndarray:
    """Words covered by the hit windows a..b (in words of their text)."""
    delta = np.zeros(len(words.start) + 1, dtype=np.int64)
    flat = hits.flatten()
    row = np.repeat(np.arange(len(hits)), np.asarray(hits.value_lengths().fill_null(0)))
    base = words.first[row]
    np.add.at(delta, base + np.asarray(flat.field("a")), 1)
    np.add.at(delta, base + np.asarray(flat.field("b")) + length, -1)
    return np.cumsum(delta[:-1]) > 0


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                words = words_of(data, offsets, SPACE_WORDS, hashed=False)
                gone = _covered(words, rows.column(rows.schema.get_field_index("hits")), length)
                body, counts, removed, kept, spans = data.tobytes(), np.diff(words.first), [], [], []
                for i in range(len(rows)):
                    low, high = words.first[i], words.first[i + 1]
                    out = gone[low:high]
                    parts = body[offsets[i] : offsets[i + 1]].split()
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
                    spans.append(edges.astype(np.int32))
                    removed.append(int(out.sum()))
                    kept.append(b" ".join(parts if not len(edges) else [parts[j] for j in np.flatnonzero(~out)]))
                offset = np.concatenate(([0], np.cumsum([len(x) for x in spans])))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), lists(np.concatenate(spans), offset, pa.int32())], names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return run


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tk, a, b): starts a..b of windows whose words also start a window of a smaller doc_id.

    Hot segments are pre-aggregated (min doc_id) before any shuffle by anchor; the joins back are
    plain equi-joins whose skewed side Spark can split.  No pair of occurrences is ever formed.
    """
    known = texts.where("doc_id is not null")
    segments = written(known.mapInArrow(_segments(length), "doc_id long, tk long, anchor long, seg long, a int, b int"), "segments")
    classes = segments.groupBy("anchor", "seg").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    anchors = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("first_doc").alias("low"), F.max("last_doc").alias("high")).where("low < high")
    shared = classes.join(anchors, "anchor").select("anchor", "seg", "first_doc", (F.col("kinds") > 1).alias("mixed"))
    marked = written(segments.join(shared, ["anchor", "seg"]).where("doc_id > first_doc or mixed"), "shared-segments")
    whole = marked.where("doc_id > first_doc").select("doc_id", "tk", "a", "b")
    todo = marked.where("doc_id = first_doc").groupBy("doc_id", "tk").agg(F.collect_list(F.struct("anchor", "a", "b")).alias("todo"))
    windows = written(known.join(todo, ["doc_id", "tk"]).select("doc_id", "tk", "text", "todo").mapInArrow(_expand(length), "doc_id long, tk long, anchor long, win long, a int"), "windows")
    first = windows.groupBy("anchor", "win").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor", "win", "low")
    partly = windows.join(first, ["anchor", "win"]).where("doc_id > low").select("doc_id", "tk", "a", F.col("a").alias("b"))
    return whole.union(partly)


def drop_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans): spans holds start and end words of each maximal repeat."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("tk"), "text")
    hits = repeated_windows(texts, length).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("a", "b")).alias("hits"))
    return texts.join(hits, ["doc_id", "tk"], "left").select("doc_id", "text", "hits").mapInArrow(_finish(length), "doc_id long, n_words long, n_removed long, kept_text string, spans array<int>")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
