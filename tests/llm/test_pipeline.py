"""The pipeline's stages against their operators and brute force, on the smallest tables and on odd rows."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import all_pairs_lines, brute_hits, fingerprint, groups  # noqa: E402


def _docs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect()]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    clean = stages["quality"](spark, docs, small)
    marks = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1 and toxic = 0").join(docs, "doc_id", "left_semi")
    assert clean.columns == columns and clean.join(marks, "doc_id", "left_semi").count() >= 0.97 * marks.count()
    fewer = stages["lines"](spark, docs, small)
    expected = sorted((d, t) for d, n, t in all_pairs_lines(_docs(docs)) if not n or t.strip())
    assert fewer.columns == columns and sorted(_docs(fewer)) == expected
    assert fewer.where("n_chars <> char_length(text)").count() == 0
    alone = stages["near_copies"](spark, docs, small)
    assert sorted(d for d, _ in _docs(alone)) == sorted({c for _, _, c in groups([(d, fingerprint(t)) for d, t in _docs(docs)])})
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    free = stages["benchmark"](spark, docs, small)
    assert sorted(d for d, _ in _docs(free)) == sorted(d for d, _, n, _ in brute_hits(_docs(docs), items) if not n)
    coded = stages["encode"](spark, docs, small)
    assert coded.where("not decodes_back").count() == 0 and coded.select("doc_id").distinct().count() == docs.count()


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    ids = [r["doc_id"] for r in out.select("doc_id").distinct().collect()]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 0 < len(ids) < docs.count() and out.where("sample = 0").count() == len(ids)


def test_odd_rows_pass_every_stage(spark, odd, small):
    for frame in (odd, odd.limit(0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, small)
            assert name == "encode" or found.columns == docs.columns
            found.count()


def test_near_copies_of_repeated_and_missing_ids(spark, small):
    words = [f"w{i}" for i in range(400)]
    one, two, three = " ".join(words[:120]), " ".join(words[150:280]), " ".join(words[300:])
    rows = [(1, one), (2, one), (2, two), (3, three), (3, three.upper()), (3, three), (None, one), (None, " ".join(words[100:200])), (None, " ".join(words[100:200]).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, small)
    kept = [(r["doc_id"], r["text"].lower()) for r in found.collect()]
    assert sorted(kept, key=repr) == sorted([(1, one), (2, two), (3, three), (None, " ".join(words[100:200]))], key=repr)
