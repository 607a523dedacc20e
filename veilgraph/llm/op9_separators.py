"""Token counts by separator scan over flat, unindexed token files.

The token files hold nothing but little-endian unsigned 16-bit ids, one END after each document; a file
ends after the document that reaches FILE_TOKENS.  Beside each, written by the same task, lies a file of
its documents' ids in the same order, without sizes or places.  A scan cuts each token file into blocks,
finds END in a block with one vector comparison and keeps, per block, its length, its number of ENDs and
where the first and last lie.  A prefix scan over the blocks of a file, the files of a task and the tasks
then gives each block its first document number and the tokens carried in from before it, so a document
that spans blocks gets its full length.

Rules for odd input: a null text is an empty document with no tokens of its own; rows of one
doc_id, or of none, each count, in the order of documents; a file is as large as FILE_TOKENS and its
last text, so a very long text is one file and one value of its size; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.encoding import piece_bpe
from veilgraph.llm.shared import cut, small_batches, table, work_path
from veilgraph.llm.textbatch import lists, slices

END = 2  # the model's end-of-text id, which no text encodes to
SEPARATOR = "\x02\x00"  # END as bytes
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 23

_NAME = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("separator", "<u2")])
_BLOCK = "part int, piece int, block int, size long, ends long, first_end long, last_end long, inner array<long>"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_bpe(path)
        piece, held, seq = 0, 0, 0
        for batch in batches:
            for rows, data, offsets in slices(batch):
                ids, at = encode(data, offsets)
                body = ids.astype("<u2").tobytes()
                pieces = []
                for size in (np.diff(at) + 1).tolist():
                    pieces.append(piece)
                    held += size
                    if held >= FILE_TOKENS:
                        piece, held = piece + 1, 0
                n, doc_ids = len(rows), rows.column(0)
                names = np.zeros(n, dtype=_NAME)
                names["known"], names["doc_id"] = np.asarray(doc_ids.is_valid()), np.asarray(doc_ids.fill_null(0))
                named = names.view(np.uint8).reshape(n, -1)[:, :-2]
                values = [body[2 * s : 2 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] + [x.tobytes() for x in named]
                order = np.arange(seq, seq + n)
                seq += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["tokens"] * n + ["names"] * n), pa.array(pieces * 2, pa.int32()), pa.array(np.concatenate((order, order))), pa.array(values, pa.binary())],
                    names=["kind", "piece", "seq", "value"],
                )

    return run


def write_flat(documents: DataFrame, tokenizer: str, path: str) -> None:
    """Flat token files in the order of documents, by Spark's own writer: each row's bytes, then END; and the names beside them.

    No text moves between tasks; a task sorts its own rows by file, in the order they came.
    """
    small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_encode(tokenizer), "kind string, piece int, seq long, value binary")
    ordered = rows.sortWithinPartitions("kind", "piece", "seq").select("kind", "piece", F.col("value").cast("string").alias("value"))
    ordered.write.partitionBy("kind", "piece").option("lineSep", SEPARATOR).text(path)


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(part, piece, content) of the files of a kind; part is the task that wrote them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    place = F.regexp_extract("path", r"kind=(\w+)/piece=\d+/part-\d+", 1)
    number = lambda which: F.regexp_extract("path", r"/piece=(\d+)/part-(\d+)", which).cast("int")
    return files.where(place == kind).select(number(2).alias("part"), number(1).alias("piece"), "content")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            tokens = np.frombuffer(batch.column(2)[k].as_buffer(), dtype="<u2")
            for block, at in enumerate(range(0, len(tokens), BLOCK_TOKENS)):
                part = tokens[at : at + BLOCK_TOKENS]
                ends = np.flatnonzero(part == END)
                edges = [pa.array([int(ends[i]) if len(ends) else None], pa.int64()) for i in (0, -1)]
                inner = lists(np.diff(ends), np.array([0, max(len(ends) - 1, 0)]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([block], pa.int32()), pa.array([len(part)]), pa.array([len(ends)]), *edges, inner],
                    names=["part", "piece", "block", "size", "ends", "first_end", "last_end", "inner"],
                )


def _before(rows: DataFrame, within: tuple[str, ...], by: str) -> DataFrame:
    """rows(size, ends, last_end) with t0, d0, e0: tokens, ENDs and the last END's place before each row in its group."""
    window = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    added = rows.withColumn("t0", F.coalesce(F.sum("size").over(window), F.lit(0))).withColumn("d0", F.coalesce(F.sum("ends").over(window), F.lit(0)))
    return added.withColumn("e0", F.max(F.col("t0") + F.col("last_end")).over(window))


def _totals(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("size").alias("size"), F.sum("ends").alias("ends"), F.max(F.col("t0") + F.col("last_end")).alias("last_end"))


def _based(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks with tb, db, eb (tokens, ENDs, last END before each over all files), and (part, piece, ends, db) of each file."""
    blocks = _before(cut(_files(spark, path, "tokens").mapInArrow(_scan, _BLOCK)), ("part", "piece"), "block")
    files = _before(_totals(blocks, "part", "piece"), ("part",), "piece")
    # one small row a writing task
    tasks = _before(_totals(files, "part"), (), "part").select("part", F.col("t0").alias("tt"), F.col("d0").alias("dt"), F.col("e0").alias("et"))
    placed = files.join(tasks, "part").select(
        "part", "piece", "ends", (F.col("tt") + F.col("t0")).alias("tf"), (F.col("dt") + F.col("d0")).alias("df"), F.coalesce(F.col("tt") + F.col("e0"), "et").alias("ef")
    )
    inside = blocks.join(placed.drop("ends"), ["part", "piece"])
    tb, db = F.col("tf") + F.col("t0"), F.col("df") + F.col("d0")
    based = inside.withColumn("tb", tb).withColumn("db", db).withColumn("eb", F.coalesce(F.col("tf") + F.col("e0"), "ef", F.lit(-1)))
    return based, placed.select("part", "piece", "ends", F.col("df").alias("db"))


def _located(based: DataFrame) -> DataFrame:
    """(doc_no, start, n_tokens); the first document of a block starts after the last END anywhere before it."""
    placed = based.where("ends > 0").select(F.col("tb").alias("base"), F.col("db").alias("doc0"), F.col("eb").alias("prior_end"), "first_end", "inner")
    return placed.mapInArrow(_spread, "doc_no long, start long, n_tokens long")


def scan_flat(spark: SparkSession, path: str) -> DataFrame:
    """(doc_no, start, n_tokens) of every document in the files; n_tokens counts the END."""
    return _located(_based(spark, path)[0])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            base, doc0, prior, first = (batch.column(c)[k].as_py() for c in range(4))
            sizes = np.concatenate(([base + first - prior], np.asarray(batch.column(4)[k].values))).astype(np.int64)
            starts = prior + 1 + np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([pa.array(doc0 + np.arange(len(sizes))), pa.array(starts), pa.array(sizes)], names=["doc_no", "start", "n_tokens"])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            names = np.frombuffer(batch.column(2)[k].as_buffer(), dtype=_NAME)
            place = [pa.array(np.full(len(names), batch.column(c)[k].as_py(), np.int32)) for c in (0, 1)]
            doc_ids = pa.array(names["doc_id"].astype(np.int64), mask=names["known"] == 0)
            yield pa.RecordBatch.from_arrays([*place, pa.array(np.arange(len(names))), doc_ids], names=["part", "piece", "k", "doc_id"])


def token_counts(documents: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """(doc_id, doc_no, start, n_tokens): writes the files, scans them, and names what was found.

    A file's names are as many as its ENDs; anything else is an error, never a wrong name.
    """
    write_flat(documents, tokenizer, path)
    spark = documents.sparkSession
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content").where("length > 0").head(1):
        return spark.createDataFrame([], "doc_id long, doc_no long, start long, n_tokens long")
    names = cut(_files(spark, path, "names").mapInArrow(_names, "part int, piece int, k long, doc_id long"))
    based, files = _based(spark, path)
    files = cut(files)
    counted = names.groupBy("part", "piece").agg(F.count("*").alias("names"))
    if not files.join(counted, ["part", "piece"], "full").where("not ends <=> names").isEmpty():
        raise RuntimeError("a token file and its names do not agree")
    numbered = names.join(files, ["part", "piece"]).select("doc_id", (F.col("db") + F.col("k")).alias("doc_no"))
    return _located(based).join(numbered, "doc_no").select("doc_id", "doc_no", "start", "n_tokens")


def op9_separators(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    documents, path = table(spark, sf_dir, "documents"), work_path(spark, "flat-tokens")
    return token_counts(documents, tokenizer or public_tokenizers.path("piece_bpe_32k.model"), path)
