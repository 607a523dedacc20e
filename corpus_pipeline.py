"""Corpus pipeline: classify, dedup lines, dedup documents, decontaminate, sample token ids.

Every stage takes (spark, docs, sf_dir) and reads all of docs; run() writes each stage's rows as
Parquet into the shared folder and reads them again for the next.  All stages but the last return
the columns of documents.  Empty inputs give empty outputs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.op1_line_dedup import drop_lines
from veilgraph.llm.op3_sentencepiece import sample_encode
from veilgraph.llm.op6_decontaminate import decontaminate
from veilgraph.llm.op7_kneser_ney import classify
from veilgraph.llm.op10_simhash import later_copies
from veilgraph.llm.shared import table, written


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and text hash are in gone (doc_id, tk)."""
    keys = gone.select(F.col("doc_id").alias("__vg_id"), F.col("tk").alias("__vg_tk"))
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(F.col("__vg_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__vg_tk")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside their language's perplexity bounds go; texts without a byte go too."""
    return _without(docs, classify(docs, table(spark, sf_dir, "labels")).where("not kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines aligned with an earlier document go; so do documents that lose their last line."""
    left = drop_lines(docs).where("n_removed = 0 or text rlike '[^ \\\\s]'")
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row of the smallest doc_id and text hash stays, rows without doc_id last."""
    key, tk = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    gone = later_copies(docs).select(F.col("doc_id").alias("__vg_id"), F.col("tk").alias("__vg_tk"))
    left = docs.join(gone, key.eqNullSafe(F.col("__vg_id")) & (tk == F.col("__vg_tk")), "left_anti")
    again = written(docs.groupBy(key.alias("__vg_id"), tk.alias("__vg_tk")).count().where("count > 1").drop("count"), "repeated-rows")
    if again.isEmpty():
        return left
    # rows equal in doc_id and text: one of them stays
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__vg_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__vg_tk"))
    return left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text, with inclusion scores; decodes_back says that the ids give the text."""
    found = sample_encode(docs, public_tokenizers.path("piece_bpe_32k.model"), wanted=("ids", "same"))
    return found.select("doc_id", "sample", "n_tokens", F.round("log_prob", 6).alias("log_prob"), F.round("inclusion", 6).alias("inclusion"), "ids", F.col("same").alias("decodes_back"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("encode", encode)]

#: The model scores, alignments and sampled paths have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
