"""Token-ID output as one wavelet-matrix file per shard, and per-document reads from those files.

Rules for odd input: a null text is empty (only the end id is stored); rows with equal doc_id all
stay, ordered by text; null doc_ids come first and read back as null; other columns are ignored; an
empty table gives no files and no rows; a very long text is encoded whole, and its shard grows by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.encoding import word_bpe
from veilgraph.llm.shared import cut, small_batches, table, work_path
from veilgraph.llm.textbatch import slices
from veilgraph.llm.wavelet import WaveletMatrix, pack, unpack

END_ID = 1
PLANES = 16
SHARD_TOKENS = 1 << 20
SLICE = 4 << 20

_ROW = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(path)
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        known: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal ids, docs, known, sizes, held, seq
            tokens = np.concatenate(ids)
            blob = pack(WaveletMatrix.build(tokens, PLANES), np.concatenate(docs), np.concatenate(known), np.concatenate(sizes), part, seq)
            ids, docs, known, sizes, held, seq = [], [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

        for batch in batches:
            for rows, data, offsets in slices(batch, limit=SLICE):
                found, at = encode(data, offsets)
                ids.append(np.insert(found, at[1:], END_ID))
                key = rows.column(0)
                docs.append(np.asarray(key.fill_null(0)))
                known.append(np.asarray(key.is_valid()))
                sizes.append(np.diff(at) + 1)
                held += len(ids[-1])
                if held >= SHARD_TOKENS:
                    yield emit()
        if docs:
            yield emit()

    return run


def write_shards(documents: DataFrame, tokenizer: str, path: str) -> None:
    """Encode whole texts in ascending doc_id order, append END_ID to each and write one file per shard.

    Rows are range-partitioned by doc_id, so a shard holds a run of consecutive documents and any
    number of tasks writes at once; a shard's memory is bounded by SHARD_TOKENS and its last text.
    The bytes go through Spark's own writer (with its commit protocol), one shard a file.
    """
    small_batches(documents.sparkSession)
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blobs = ordered.mapInArrow(_shards(tokenizer), "blob binary")
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            matrix, ids, known, lengths, part, seq = unpack(blob.as_py())
            body = matrix.tokens().astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(body[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(ids, mask=~known), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: (doc_id, start, n_tokens, ids_crc32)."""
    files = spark.read.format("binaryFile").load(path).where("length > 1").select("content")
    rows = cut(files.mapInArrow(_read, _ROW))
    totals = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one small row a file
    bases = totals.select("part", "seq", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _lookup(token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                matrix, ids, known, lengths, _, _ = unpack(blob.as_py())
                at = matrix.occurrences(token)
                ends = np.cumsum(lengths)
                row = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], mask=~known[row]), pa.array(at - (ends - lengths)[row])], names=["doc_id", "offset"])

    return run


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, offset) of every occurrence of a token id, by select on the stored planes."""
    return spark.read.format("binaryFile").load(path).where("length > 1").select("content").mapInArrow(_lookup(token), "doc_id long, offset long")


def op4_wavelet(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), path)
    return read_shards(spark, path)
