"""Drop counters, label resolution, vector index and context blocks on small and odd rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilgraph.functions import answers
from veilgraph.metrics import ratios
from veilgraph.operators import lookup, vector, vector_index
from veilgraph.plans import policy as pol
from veilgraph.plans.context import NoContext, dropped_rows, secure_counted, system_context, user_context


def test_drops_are_counted_in_the_same_pass(spark, tmp_path):
    keys = ["internal:faq", "internal:incident_report", "customer_a:postmortem", "elsewhere:faq", None, "internal:secret_infra"]
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i, keys[i % 6]) for i in range(60)], "id int, filter_key string").write.parquet(path)
    ctx = user_context(pol.DEFAULT, "engineer", "s0")
    rows, seen = secure_counted(spark.read.parquet(path), ctx, "chunks")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    kept = rows.count()
    found = {r["dropped"]: r["n"] for r in dropped_rows(spark, [("r", "chunks", ctx, seen)]).collect()}
    readable, shown = ctx.keys["chunks"], ctx.keys["hyperedges"]
    assert kept == 10 * sum(k in readable for k in keys) and found == {"L0": 10 * sum(k not in shown for k in keys), "L1": 10 * sum(k in shown and k not in readable for k in keys)}
    every, none = secure_counted(spark.read.parquet(path), system_context("s0"), "chunks")
    assert every.count() == 60 and dropped_rows(spark, [("r", "chunks", system_context("s0"), none)]).count() == 0
    with pytest.raises(NoContext):
        secure_counted(spark.read.parquet(path), None, "chunks")


def test_labels_resolve_as_a_scan_does(spark):
    rng = random.Random(5)
    words = ["App01", "payment page of App01", "DB", "db-2", "the  Gateway", "naïve NODE", "a", ""]
    values = [(f"he{h}", f"d{h % 4}", slot, rng.choice(words)) for h in range(24) for slot in ("subject", "cause", "owner")]
    asked = [(i, f"he{i % 30}", f"d{i % 30 % 4 if i % 3 else 4 - i % 5}", rng.choice(["app01", "APP01", "gateway", "DB", "payment page", "a", "node", "", None, "the gateway"]), rng.choice([None, None, "db", "App01", "a", "", "page of app"])) for i in range(240)]
    fold = lambda x: None if x is None else " ".join(x.casefold().split())
    want = {}
    for i, he, doc, anchor, second in asked:
        a, b = fold(anchor), fold(second)
        subjects = {h: {fold(v) for g, d, s, v in values if g == h and d == doc and s == "subject"} for h, d, _, _ in values if d == doc}
        equal = [h for h, t in subjects.items() if a and a in t]
        near = equal or [h for h, t in subjects.items() if a and any(a in x for x in t)]
        if second is not None:
            near = [h for h in near if b and any(b in fold(v) for g, d, _, v in values if g == h and d == doc)]
        there = any(h == he for h, *_ in values)
        status = "AMBIGUOUS" if len(near) > 1 else ("STALE" if there else "LOST") if not near else "OK" if near[0] == he else "MOVED" if there else "DRIFTED"
        want[i] = (len(near), near[0] if len(near) == 1 else None, status)
    labels = spark.createDataFrame(asked, "label_id int, he_id string, doc_key string, anchor string, second string")
    frame = spark.createDataFrame(values, "he_id string, doc_key string, slot string, value string")
    found = {r["label_id"]: (r["n"], r["found"], r["status"]) for r in lookup.resolve_labels(labels, frame).collect()}
    assert found == want
    assert {s for _, _, s in want.values()} == {"AMBIGUOUS", "STALE", "LOST", "OK", "MOVED", "DRIFTED"}


def test_reasons(spark):
    groups = {"App01": ("s", ["App01", "app01"], ["case"]), "host": ("s", ["host1", "host1.corp.vn"], ["domain"]), "joint": ("s", ["a b", "a-b", "a_b"], ["joints"]), "two": ("s", ["Web01", "web01.corp.vn"], ["case", "domain"]), "all": ("s", ["My App", "myapp.x.vn"], ["case", "domain", "joints"])}
    rows = [(scope, name) for scope, names, _ in groups.values() for name in names] + [("t", "app01"), ("t", "APP01"), ("s", "alone"), ("s", "v1.4")]
    found = {(r["scope"], r["group_key"]): (r["reasons"], r["n_scopes"]) for r in ratios.alias_reasons(spark.createDataFrame(rows, "scope string, name string")).collect()}
    assert found == {("s", "app01"): (["case"], 2), ("t", "app01"): (["case"], 2), ("s", "host1"): (["domain"], 1), ("s", "ab"): (["joints"], 1), ("s", "web01"): (["case", "domain"], 1), ("s", "myapp"): (["case", "domain", "joints"], 1)}


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6))
    rows = [(i, "chunks" if i % 4 else "entities", ("internal:faq", "internal:runbook", "internal:secret_infra")[i % 3], [float(x) for x in centres[i % 8] + 0.15 * rng.normal(size=6)]) for i in range(400)]
    odd = [(500, "chunks", "internal:faq", None), (501, "chunks", "internal:faq", [1.0]), (502, "chunks", "internal:faq", [0.0] * 6), (503, "chunks", None, [1.0] * 6), (504, "chunks", "internal:faq", rows[7][3]), (505, "chunks", "internal:faq", [None] * 6)]
    return spark.createDataFrame(rows + odd, "vec_id long, namespace string, filter_key string, embedding array<float>")


def test_index_prunes_and_finds(spark, vectors, tmp_path, monkeypatch):
    ctx = user_context(pol.DEFAULT, "staff", "s0")
    probes = vectors.where("vec_id % 10 = 0 or vec_id >= 500").select(F.col("vec_id").alias("probe_id"), "embedding")
    exact = vector.top_k_many(vectors, probes, ctx, "chunks", 10)
    one = vectors.where("vec_id = 20").first()["embedding"]
    assert [(r["vec_id"], round(r["score"], 9)) for r in exact.where("probe_id = 20").orderBy("rank").collect()] == [(r["vec_id"], round(r["score"], 9)) for r in vector.top_k(vectors.where("vec_id not in (500, 501, 502, 505)"), list(one), ctx, "chunks", 10).collect()]
    monkeypatch.setattr(vector, "PROBES", 7)
    rounded = lambda f: sorted((r["probe_id"], r["rank"], r["vec_id"], round(r["score"], 5)) for r in f.collect())
    assert rounded(vector.top_k_many(vectors, probes, ctx, "chunks", 10)) == rounded(exact)
    centroids = vector_index.fit(vectors, 8)
    index = vector_index.write(vectors, centroids, str(tmp_path / "index"))
    assert index.count() == vectors.count()
    found = vector_index.search(index, centroids, probes, ctx, "chunks", 10, 5, vector.THRESHOLD)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "internal:faq" in plan.split("PartitionFilters: [")[1].split("]")[0]
    total = vector_index.recall(found, exact).agg(F.sum("n_found").alias("f"), F.sum("n_exact").alias("e")).first()
    assert total["f"] >= 0.9 * total["e"] > 0
    whole = vector_index.search(index, centroids, probes, ctx, "chunks", 10, 8, vector.THRESHOLD)
    assert rounded(whole) == rounded(exact)
    none = vectors.limit(0)
    empty = vector_index.fit(none)
    assert vector_index.search(vector_index.write(none, empty, str(tmp_path / "none")), empty, probes, ctx, "chunks", 5, 2, 0.2).count() == 0


def test_search_joins_no_pairs(spark, vectors, tmp_path):
    ctx, probes = user_context(pol.DEFAULT, "staff", "s0"), vectors.select(F.col("vec_id").alias("probe_id"), "embedding")
    centroids = vector_index.fit(vectors, 8)
    found = vector_index.search(vector_index.write(vectors, centroids, str(tmp_path / "index")), centroids, probes, ctx, "chunks", 10, 8, vector.THRESHOLD)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_best_rows_across_batches(monkeypatch):
    monkeypatch.setattr(vector, "ROWS", 3)
    rng = np.random.default_rng(4)
    rows, probes = rng.integers(-2, 3, (300, 2)).astype(float), vector._normal(rng.integers(1, 3, (70, 2)).astype(float))  # many equal directions
    batches = [pa.RecordBatch.from_arrays([pa.array(range(b, b + 60)), pa.array(rows[b : b + 60].tolist(), pa.list_(pa.float32()))], names=["vec_id", "embedding"]) for b in (240, 0, 60, 180, 120)]
    monkeypatch.setattr(vector, "max", lambda *_: 40, raising=False)  # so that the pool is cut often
    (out,) = vector._scored(list(range(70)), probes, 4, 0.2)(iter(batches))
    scores = (vector._normal(rows) @ probes.T).round(vector.DECIMALS)
    want = {(p, v) for p in range(70) for v in sorted((v for v in range(300) if scores[v, p] >= 0.2), key=lambda v: (-scores[v, p], v))[:4]}
    assert set(zip(out["probe_id"].to_pylist(), out["vec_id"].to_pylist(), strict=True)) == want and out.num_rows == len(want)


def test_records_round_trip(spark):
    cells = ['a "quoted" one', "comma, and\nbreak", "", " plain ", '"', 'x""y', "end\n\n"]
    rows = [(i // 9, i % 9, a, b, f"he-{i}") for i, (a, b) in enumerate(itertools.product(cells, cells[:5]))]
    frame = spark.createDataFrame(rows, "request int, rank int, a string, b string, hyperedge string")
    blocks = lookup.context_csv(frame, "rank", "a", "b", "hyperedge").select("request", F.concat(F.lit("id,a,b,hyperedge\n"), "block").alias("block"))
    found = sorted((r["request"], r["ordinal"], r["value"]) for r in answers.block_rows(blocks, "request", "block").collect())
    assert found == sorted((q, n, h) for q, n, _, _, h in rows)
    again = answers.block_rows(blocks, "request", "block", "a").collect()
    assert {(r["request"], r["ordinal"], r["value"]) for r in again} == {(q, n, a.strip()) for q, n, a, _, _ in rows if a.strip()}


def test_records_of_unquoted_tables(spark):
    block = 'id,\thyperedge,\trelated\n0,\the-1,\t"open name\n1,\the-2,\tx\n\nno,\the-3,y\n2,\t\n'
    assert [r[:2] for r in answers.csv_records(block)] == [["id", "hyperedge"], ["0", "he-1"], ["1", "he-2"], ["no", "he-3"], ["2", ""]]
    frame = spark.createDataFrame([(1, block), (2, None), (3, "a,b\n1,2"), (4, "")], "request int, block string")
    found = answers.block_rows(frame, "request", "block")
    assert sorted((r["request"], r["row_no"], r["ordinal"], r["value"]) for r in found.collect()) == [(1, 1, 0, "he-1"), (1, 2, 1, "he-2"), (1, 3, -1, "he-3")]
    said = spark.createDataFrame([(1, [0, 0, -1, 7])], "key int, sources array<int>")
    assert [r["value"] for r in answers.cited(found.withColumnRenamed("request", "key"), said).collect()] == ["he-1"]
    long = "id,hyperedge\n" + '0,"open\n' * 3000
    assert len(answers.csv_records(long)) >= 1
