"""Work that must grow with the input and no faster."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from veilgraph import model
from veilgraph.functions import facts, keys
from veilgraph.metrics import documents, matching, ratios, scoring
from veilgraph.model import COARSE, RANKS, SCOPES, SLOTS
from veilgraph.operators import audit, graph, lookup
from veilgraph.plans import policy
from veilgraph.plans.context import user_context
from veilgraph.sources import ingest, versions
from veilgraph.sources.held import shared_dir
from veilgraph.plans import features, measures, queries  # noqa: F401  register their queries


def test_cost_by_interval_meets_sums(spark):
    rng, t0 = random.Random(3), datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(seconds=rng.randrange(4 * 3600))
    events = [(at(), float(rng.randrange(100))) for _ in range(300)] + [(t0 + timedelta(hours=1), None), (None, 1.0)]
    starts = [at() for _ in range(9)] + [t0, t0 + timedelta(hours=1)]
    spans = [(f"d{i}", s, s + timedelta(seconds=rng.choice((0, 1, 1800, 3600, 7000)))) for i, s in enumerate(starts * 3)] + [("d0", starts[3], starts[3] + timedelta(hours=1)), ("none", None, t0)]
    frame = spark.createDataFrame(events, "ts timestamp, cost double")
    found = {r["doc_key"]: (r["n"], r["cost"]) for r in audit.cost_by_interval(frame, spark.createDataFrame(spans, "doc_key string, start timestamp, end timestamp")).collect()}
    wanted = {}
    for key, start, end in spans:
        hits = [c for ts, c in events if start and ts and start <= ts < end]
        if hits:
            n, cost = wanted.get(key, (0, 0.0))
            wanted[key] = (n + len(hits), cost + sum(c for c in hits if c is not None))
    assert found == wanted
    # what a span meets is bounded by the bounds, however many events lie between them
    bounds = spark.createDataFrame([(s,) for s in starts], "at timestamp").select(F.unix_micros("at").alias("at"))
    assert audit.sums_between(frame, bounds).count() <= len(starts) + 5


SCHEMA = "doc_key string, fact_id string, " + ", ".join(f"`{s}` string" for s in SLOTS)


@pytest.mark.parametrize("call", [scoring.scored_candidates, scoring.pair_level, scoring.document_level])
def test_documents_as_by_joins(spark, monkeypatch, call):
    rng = random.Random(5)
    words = ["ab", "ABC", "abcd", "x", "xy", "Đà", "đà nẵng", "q", "  ", "", None, None]
    fact = lambda doc, side, n: (doc, f"{side}{rng.randrange(10)}{n}", rng.choice(words), *[rng.choice(words) for _ in SLOTS[1:]])
    gold, pred = (spark.createDataFrame([fact(f"d{d}" if d else None, side, n) for d in range(40) for n in range(d % 5 + more)], SCHEMA) for side, more in (("g", 1), ("p", 0)))
    own, some, none = [], [], []
    for size, rows in ((400, own), (4, some), (0, none)):
        monkeypatch.setattr(documents, "GROUP", size)
        rows += sorted(map(repr, call(gold, pred).collect()))
    assert own == some == none and own


def test_documents_are_shuffled_once(spark):
    frame = spark.createDataFrame([], SCHEMA)
    for call in (scoring.scored_candidates, scoring.pair_level, scoring.document_level):
        plan = call(frame, frame)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 0 and plan.count("RepartitionByExpression") == 1


def test_same_roles_of_many_documents_at_once(spark, monkeypatch):
    rng = random.Random(6)
    words = ["ab", "ABC", "abcd", "x", "xy", "Đà", "đà  nẵng", "q", "  ", "", None, None]
    fact = lambda name: (name, *[rng.choice(words) for _ in COARSE]) if rng.randrange(6) else (None,) * 6
    rows = [(d, *fact(f"g{n}"), *fact(f"p{n}")) for d in range(70) for n in range(1 + rng.randrange(9) * (d % 11 > 0))]
    wanted = []
    for d in range(70):
        golds, preds = ([(r[i], tuple(documents.folded(pa.array(r[i + 1 : i + 6], pa.string())))) for r in rows if r[0] == d] for i in (1, 7))
        wanted += [(d, *row[:3]) for row in documents.scored_candidates(golds, preds)]
    fields = ["d", *[f"{side}_{n}" for side in ("gold", "pred") for n in ("fact_id", *COARSE)]]
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], fields)
    for most in (1, 30, 1 << 20):
        monkeypatch.setattr(documents, "PAIRS", most)
        for size in (1, 7, 1000):
            parts = [whole.slice(i, size) for i in range(0, len(rows), size)]
            found = [tuple(r.values()) for part in documents.same_roles(iter([*parts, whole.slice(0, 0)])) for r in part.to_pylist()]
            assert sorted(found) == sorted(wanted) and wanted
    frame = spark.createDataFrame([*rows, (None, *rows[0][1:])], f"d long, {' string, '.join(fields[1:])} string").repartition("d").sortWithinPartitions("d")
    assert sorted(map(tuple, scoring.same_role_candidates(frame, "d").collect())) == sorted(wanted)
    assert scoring.same_role_candidates(frame.limit(0), "d").count() == 0


def test_candidates_write_narrow_lines_alone(spark, small):
    held = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if not p.name.startswith("large-documents-")}
    before = held()
    plan = measures.subject_candidates(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert held() == before  # no gold set is written
    # lines by part and by order, parts, orders; ids and preds are made after the last of them
    assert plan.count("Exchange hashpartitioning") == 4 and plan.count("FileScan") == 4
    assert plan.rindex("sha2") < plan.index("Exchange hashpartitioning")


def test_orders_of_many_lines(spark, small, monkeypatch):
    found = []
    for size in (400, 12):  # twelve lines with their preds, then six
        monkeypatch.setattr(documents, "GROUP", size)
        found.append(sorted(map(tuple, measures.subject_candidates(spark, small).collect())))
    assert found[0] == found[1] and found[0]
    spark.conf.set("spark.sql.requireAllClusterKeysForDistribution", "true")
    monkeypatch.setattr(model, "SUPPLIER_KEYS", 0)
    try:
        assert sorted(map(tuple, measures.subject_candidates(spark, small).collect())) == found[0]
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForDistribution")


def test_labels_as_by_grams(spark, monkeypatch):
    rng = random.Random(8)
    words = ["alpha beta", "Alpha", "beta gamma delta", "gamma", "Đà nẵng", "", None, "delta alpha beta"]
    values = [(f"h{rng.randrange(60)}", f"d{d}", rng.choice(SLOTS[:3]), rng.choice(words)) for d in range(25) for _ in range(d % 9)]
    parts = ["alpha", "ALPHA BETA", "a", "gamma d", "nẵng", "", None, "zzz"]
    labels = [(n, f"h{rng.randrange(80)}", f"d{n % 27}" if n % 10 else None, rng.choice(parts), rng.choice([None, *parts])) for n in range(200)]
    frames = spark.createDataFrame(labels, "label_id long, he_id string, doc_key string, anchor string, second string"), spark.createDataFrame(values, "he_id string, doc_key string, slot string, value string")
    own, some, none = [], [], []
    for size, rows in ((400, own), (9, some), (0, none)):
        monkeypatch.setattr(documents, "GROUP", size)
        rows += sorted(map(repr, lookup.resolve_labels(*frames).collect()))
    assert own == some == none and len(own) == 200
    monkeypatch.setattr(documents, "GROUP", 400)
    plan = lookup.resolve_labels(*frames)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 1


def test_anchor_links_lose_no_pair(spark):
    rng = random.Random(2)
    words = ["gateway one", "gateway", "gate", "one", "payment page", "page", "x", "đà nẵng"]
    anchors = spark.createDataFrame([(i, rng.choice([*words, "nowhere", "teway o"])) for i in range(90)], "anchor_id long, anchor string")
    facts = spark.createDataFrame([(f"h{rng.randrange(70)}", rng.choice([*words[:2], *words[3:], None, ""])) for _ in range(150)], "he_id string, subject string")
    rows = lookup.anchor_links(anchors, facts).collect()
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    expanded = {(a["anchor_id"], f["he_id"]) for a in of("anchor") for p in of("pair") for f in of("fact") if a["anchor"] == p["anchor"] and p["subject"] == f["subject"]}
    assert expanded == {tuple(r) for r in lookup.by_anchor(anchors, facts).collect()}
    assert len(of("pair")) == len({(p["anchor"], p["subject"]) for p in of("pair")}) < 90


def test_restriction_and_risk_shuffle_little(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", None), ("b", 1)], "he_id string, doc_no long")
    kept = spark.createDataFrame([(1,), (1,), (None,)], "doc_no long")
    found = ratios.restrict(rows, kept)
    assert sorted(r["he_id"] for r in found.collect()) == ["b"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    slots = spark.createDataFrame([("a", "subject"), ("a", "subject"), ("a", "owner"), ("b", "cause")], "he_id string, slot string")
    assert {tuple(r) for r in slots.groupBy("he_id").agg(ratios.n_roles(F.col("slot"))).collect()} == {("a", 2), ("b", 1)}
    ranks = spark.createDataFrame([("hot", 24), ("two", 24), ("low", 2)], "he_id string, rank int")
    cells = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("hot", "y"), ("two", "x"), ("low", "x")], "he_id string, entity_id string")
    scopes = spark.createDataFrame([("hot", "s"), ("hot", "t"), ("low", "t"), ("two", "s"), ("two", None)], "he_id string, scope string")
    risk = ratios.composition_risk(ranks, cells, scopes)
    assert {tuple(r) for r in risk.collect()} == {("hot", 2, 1, False), ("two", 1, 0, False)}
    assert risk._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_matching_by_values_as_by_joins(spark, monkeypatch):
    rng = random.Random(7)
    fact = lambda d, side, n: (f"d{d}", f"{side}{rng.randrange(10)}{n}", *[rng.choice(["a", "A", "b", "", None]) for _ in SLOTS])
    gold, pred = (spark.createDataFrame([fact(d, side, n) for d in range(20) for n in range(d % 6)], SCHEMA) for side in "gp")
    found = []
    for size in (400, 5, 0):
        monkeypatch.setattr(documents, "GROUP", size)
        found.append(sorted(map(tuple, matching.match_by_values(gold, pred).collect())))
    assert found[0] == found[1] == found[2] and found[0]


def test_keys_as_bits_merge_alike_and_are_hashed(spark):
    rng = random.Random(6)
    known = [f"{s}:{t}" for s in SCOPES for t in RANKS]
    rows = [(n, rng.choice(known[:13]) if n % 3 else rng.choice(known)) for n in range(60) for _ in range(n % 5)] + [(1, None), (99, None)] + [(100 + i, k) for i, k in enumerate(known)]
    frame = spark.createDataFrame(rows, "id int, filter_key string")
    merged = keys.merge_bits_by(frame.withColumn("key_bit", keys.key_bit(F.col("filter_key"))), "id")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, keys.merge_by(frame, "id").collect()))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    with pytest.raises(Exception, match="no key of a declared scope"):
        frame.select(keys.key_bit(F.lit("elsewhere:faq"))).collect()


def test_drop_counters_keep_no_read(spark, small, monkeypatch):
    wrote = []
    for module in (features, queries):
        monkeypatch.setattr(module, "held", lambda frame, what, f=module.held: wrote.append(what) or f(frame, what))
    features.drop_counters(spark, small)
    assert sorted(wrote) == ["entities", "facts", "hyperedges"]


def test_fact_ids_are_counted_where_orders_were_joined(spark, small):
    plan = queries.fact_ids(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(he_id" not in plan and "ShuffledHashJoin" in plan


def test_responses_are_parsed_once(spark, monkeypatch):
    bodies = ['{"facts": [{"subject": "s"}, 5]}', '{"facts": []}', "no", None, '{"facts": [{"subject": "a", "cause": "b"}]}']
    frame = spark.createDataFrame([(i, bodies[i % 7 % 5]) for i in range(200)], "id int, t string")
    wrote = {}
    monkeypatch.setattr(facts, "held", lambda rows, what, f=facts.held: wrote.setdefault(what, f(rows, what)) if what not in wrote else f(rows, what))
    found = facts.reject_counts(frame, "t")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, facts.parse_responses(frame, "id", "t").groupBy("code", "broken").agg(F.count("*").alias("n")).collect()))
    assert wrote["opened"].count() == 5 and "_open" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_entities_of_several_documents(spark):
    rng = random.Random(9)
    rows = [(f"e{rng.randrange(40)}", rng.choice([None, *range(4)]), rng.choice([None, "a", "b", "c"]), rng.choice([None, *SLOTS])) for _ in range(150)]
    frame = spark.createDataFrame(rows, "entity_id string, doc_no long, he_id string, slot string")
    want = set()
    for e in {r[0] for r in rows}:
        docs, edges, slots = ({r[i] for r in rows if r[0] == e} - {None} for i in (1, 2, 3))
        want |= {(e, len(docs), len(edges), tuple(sorted(slots)))} if len(docs) > 1 else set()
    out = ratios.multi_source(frame)
    assert {(r["entity_id"], r["n_docs"], r["n_edges"], tuple(r["roles"])) for r in out.collect()} == want and want
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == len(want)


@pytest.mark.parametrize("name", ["pii_redact", "gold_integrity"])
def test_texts_go_to_python_in_small_batches(spark, small, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for size, want in (("64m", str(4 << 20)), ("1m", "1m"), ("2147483647", str(4 << 20))):
            spark.conf.set(key, size)
            queries.QUERIES[name](spark, small)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def _walk(rows, keys_of, open_keys, roots, steps):
    """zone() in plain loops: rows (he_id, entity_id, key)."""
    shown = {x for x, k in keys_of.items() if k in open_keys}
    links = {(h, e) for h, e, _ in rows if h in shown and e in shown}
    found = set()
    for root in roots:
        seen, front = {root: 0}, {root}
        for step in range(1, steps + 1):
            met = {e for h, e in links if h in front}
            front = {h for h, e in links if e in met} - set(seen)
            seen |= dict.fromkeys(front, step)
        found |= {(root, h, n, keys_of[h] if h in shown else None) for h, n in seen.items()}
    return found


def test_zone_writes_and_merges_what_it_meets(spark, monkeypatch):
    rng, context = random.Random(4), user_context(policy.DEFAULT, "support", "s0")
    known = [f"{s}:{t}" for s in SCOPES for t in RANKS]
    open_keys = {k for k in known if k in context.keys["hyperedges"]}
    rows = [(f"h{rng.randrange(25)}", f"e{rng.randrange(30)}", rng.choice(sorted(open_keys)[:3]) if rng.random() < 0.9 else rng.choice(known)) for _ in range(90)]
    rows += [(f"h{n}", "everywhere", "customer_a:faq") for n in range(9)] + [(f"far{n}", f"x{n // 2}", "customer_a:faq") for n in range(400)]
    frame = spark.createDataFrame(rows, "he_id string, entity_id string, filter_key string")
    merged = {r["id"]: r["filter_key"] for x in ("he_id", "entity_id") for r in keys.merge_by(frame.select(F.col(x).alias("id"), "filter_key"), "id").collect()}
    wrote = []
    monkeypatch.setattr(graph, "held", lambda rows, what, f=graph.held: wrote.append((what, f(rows, what))) or wrote[-1][1])
    roots = ["h0", "h1", "h2", "h3", "nowhere"]
    incidence = frame.select("he_id", "entity_id", keys.key_bit(F.col("filter_key")).alias("key_bit"))
    for steps in (1, 2, 3):
        found = graph.zone(incidence, spark.createDataFrame([(r,) for r in roots], "he_id string"), steps, context)
        want = _walk(rows, merged | {"nowhere": None}, open_keys, roots, steps)
        assert found.columns == ["root", "he_id", "step", "filter_key"] and len(want) > len(roots)
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    # hyperedges that no step meets are written nowhere
    assert all(t.where("he_id like 'far%'").isEmpty() for _, t in wrote if "he_id" in t.columns)
    assert max(t.count() for _, t in wrote) < 200


@pytest.mark.parametrize("name", ["adjacent_1step", "zone_kstep"])
def test_traversals_join_no_whole_incidence(spark, small, monkeypatch, name):
    wrote = {}
    for module in (graph, queries):
        monkeypatch.setattr(module, "held", lambda rows, what, f=module.held: wrote.setdefault(what, f(rows, what)))
    queries.QUERIES[name](spark, small).collect()
    every = wrote["facts"].count()
    assert wrote["fact-slots"].count() == wrote["facts"].select("he_id").distinct().count() < every
    assert all(t.count() < every / 10 for what, t in wrote.items() if what.startswith("zone"))


def test_lifecycle_shuffles_no_facts_for_keys_and_lists_no_sources(spark, small, monkeypatch):
    wrote = {}
    for module in (ingest, queries):
        monkeypatch.setattr(module, "held", lambda rows, what, f=module.held: wrote.setdefault(what, []).append(rows) or f(rows, what))
    found = queries.ingest_lifecycle(spark, small)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and set(wrote["ingest-facts"][0].columns) == {"art_id", "n", "filled"}
    assert all("body" not in rows.columns for each in wrote.values() for rows in each)


def test_provenance_merges_alike(spark):
    rng = random.Random(12)
    keyed = [None, "elsewhere:faq", "internal:unheard", *[f"{s}:{t}" for s in SCOPES[:2] for t in list(RANKS)[:3]]]
    rows = [(f"a{n}", f"d{rng.randrange(8)}", rng.choice(keyed[: 3 + n % 7] if n % 3 else keyed[4:6])) for n in range(60) for _ in range(n % 5)]
    gone = {"d0", "d3"}
    frame = spark.createDataFrame(rows, "art_id string, doc_key string, filter_key string")
    key = lambda of: dict(map(tuple, of.groupBy("art_id").agg(keys.merged_key(F.col("filter_key")).alias("k")).collect()))
    left, every = key(frame.where(~F.col("doc_key").isin(*gone))), key(frame)
    touched = {a for a, d, _ in rows if d in gone}
    want = {(a, "shared" if a in left else "private", left.get(a)) for a in touched}
    fates = ingest.artifacts_on_delete(frame, spark.createDataFrame([(d,) for d in gone], "doc_key string"))
    assert {tuple(r) for r in fates.collect()} == want and {w[1] for w in want} == {"shared", "private"}
    # one join, that with the keys that go; strings are merged after equal keys were hashed together
    assert fates._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert dict(map(tuple, keys.merge_by(frame, "art_id").collect())) == every


def test_artifact_sizes_count_each_document_once(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = spark.createDataFrame([("a", "internal", "faq", "one"), ("b", "internal", "faq", "two")], "doc_key string, scope string, ctype string, body string")
    held = spark.createDataFrame([("a", "h1", "internal:faq"), ("a", "h1", "internal:runbook"), ("b", "h1", "internal:faq"), ("b", "h2", "customer_a:faq"), ("b", "h2", "internal:faq")], "doc_key string, art_id string, filter_key string")
    ingest.ingest(batch, held, path, "s")
    version = versions.latest(spark, path, "s")
    found = {tuple(r) for r in ingest.artifact_sizes(spark, version).collect()}
    assert found == {("h1", "internal:runbook", 2), ("h2", None, 1)} == {(r["art_id"], r["filter_key"], len(r["sources"])) for r in ingest.stored_artifacts(spark, version).collect()}
