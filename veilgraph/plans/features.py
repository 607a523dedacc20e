"""Queries of request states, drop counters, label drift, alias reasons, vector index and context blocks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph import model as m
from veilgraph.functions import answers
from veilgraph.metrics import ratios
from veilgraph.operators import completion, lookup, vector, vector_index
from veilgraph.plans import policy as pol
from veilgraph.plans.context import dropped_rows, secure_counted, user_context
from veilgraph.plans.queries import _FOLDED, _HOST, _NAMES, _NEIGHBOURS, _ROWS, _coarse, _ent, _he, _probes, _requests, query
from veilgraph.sources import catalogue
from veilgraph.sources.held import held, shared_dir
from veilgraph.streaming import requests

# ---- request states

_STATES = """SELECT event_id, outcome, pending, CAST(expires AS TIMESTAMP) AS expires_at FROM (WITH RECURSIVE e AS (SELECT space, act, 'he-' || (event_id % 3) AS he_id, event_id, ts, CASE event WHEN 'signup' THEN 'create' WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'cancel' ELSE CASE WHEN event_id % 5 = 0 THEN 'grant' ELSE 'create' END END AS action,
  row_number() OVER (PARTITION BY space, act, event_id % 3 ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT space, act, he_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS pending, CAST(NULL AS TIMESTAMP) AS expires FROM e WHERE n = 1
UNION ALL SELECT e.space, e.act, e.he_id, e.n, e.event_id,
  CASE WHEN action IN ('create', 'grant') AND expires > ts THEN 'GRANT_ACTIVE' WHEN action = 'create' AND pending IS NOT NULL THEN 'PENDING_EXISTS' WHEN action IN ('create', 'grant') THEN 'OK' WHEN pending IS NULL THEN 'NOT_PENDING' WHEN action = 'approve' AND expires > ts THEN 'GRANT_ACTIVE' ELSE 'OK' END,
  CASE WHEN action = 'create' AND NOT coalesce(expires > ts, false) THEN coalesce(pending, e.event_id) WHEN action IN ('reject', 'cancel') OR (action = 'approve' AND NOT coalesce(expires > ts, false)) THEN NULL ELSE pending END,
  CASE WHEN expires > ts THEN expires WHEN action = 'grant' OR (action = 'approve' AND pending IS NOT NULL) THEN ts + INTERVAL 60 MINUTES END
  FROM f JOIN e ON e.space = f.space AND e.act = f.act AND e.he_id = f.he_id AND e.n = f.n + 1)
SELECT * FROM f WHERE n > 0)"""


@query(_STATES)
def request_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("event"), F.col("event_id")
    action = F.when(e == "signup", "create").when(e == "click", "approve").when(e == "error", "reject").when(e == "purchase", "cancel").when(k % 5 == 0, "grant").otherwise("create")
    commands = m.audit_events(spark, d).select("space", "act", F.concat(F.lit("he-"), k % 3).alias("he_id"), "event_id", "ts", action.alias("action"))
    return requests.outcomes(commands).select("event_id", "outcome", "pending", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


# ---- drop counters

_DROPPED = """, nk AS (SELECT role, n AS namespace, filter_key FROM policy, (VALUES ('chunks', 'L2'), ('entities', 'L2'), ('hyperedges', 'L1')) v(n, least) WHERE level >= least),
r AS (SELECT 'chunks' AS namespace, filter_key FROM docs UNION ALL SELECT 'entities', filter_key FROM ent UNION ALL SELECT 'hyperedges', filter_key FROM he),
o AS (SELECT role, namespace, filter_key FROM r, (VALUES ('staff'), ('support')) v(role) WHERE NOT EXISTS (SELECT 1 FROM nk WHERE nk.role = v.role AND nk.namespace = r.namespace AND nk.filter_key = r.filter_key))
SELECT 'ask-' || role AS request_id, role, 's0' AS space, namespace, CASE WHEN EXISTS (SELECT 1 FROM nk WHERE nk.role = o.role AND nk.namespace = 'hyperedges' AND nk.filter_key = o.filter_key) THEN 'L1' ELSE 'L0' END AS dropped, count(*) AS n FROM o GROUP BY ALL"""


@query(_DROPPED)
def drop_counters(spark: SparkSession, d: str) -> DataFrame:
    """What two requests' reads of three namespaces leave out, counted by the reads themselves."""
    namespaces = {"chunks": m.documents(spark, d).select("doc_id", "filter_key"), "entities": held(_ent(spark, d), "entities"), "hyperedges": held(_he(spark, d), "hyperedges")}
    counters = []
    for role in ("staff", "support"):
        context = user_context(pol.DEFAULT, role, "s0")
        for namespace, rows in namespaces.items():
            seen, counts = secure_counted(rows, context, namespace)
            seen.write.format("noop").mode("overwrite").save()  # the read, for which nothing needs to be kept
            counters.append((f"ask-{role}", namespace, context, counts))
    return dropped_rows(spark, counters)


# ---- labels and their anchors

_DRIFT = """, v AS (SELECT DISTINCT order_ref, he_id, slot, lower(entity_id) AS text FROM (SELECT he_id, order_ref, unnest([{'slot': 'subject', 'entity_id': subject}, {'slot': 'symptom', 'entity_id': symptom}, {'slot': 'cause', 'entity_id': cause}, {'slot': 'condition', 'entity_id': condition}, {'slot': 'remediation', 'entity_id': remediation}], recursive := true) FROM coarse) WHERE entity_id IS NOT NULL),
o AS (SELECT CAST(substr(order_ref, 7) AS BIGINT) AS label_id, order_ref, min(he_id) AS low, max(he_id) AS high, arg_min(subject, he_id) AS subject, arg_min(condition, he_id) AS condition FROM coarse GROUP BY order_ref),
l AS (SELECT label_id, order_ref, CASE label_id % 5 WHEN 0 THEN 'he-gone' WHEN 1 THEN high ELSE low END AS he_id, lower(CASE label_id % 4 WHEN 0 THEN upper(subject) WHEN 1 THEN substr(subject, 1, 4) WHEN 2 THEN subject ELSE substr(subject, 3, 7) END) AS anchor,
  CASE label_id % 3 WHEN 0 THEN NULL WHEN 1 THEN lower(condition) ELSE CASE WHEN label_id % 2 = 0 THEN 'zzz' ELSE lower(substr(condition, 1, 1)) END END AS second FROM o),
s AS (SELECT label_id, l.order_ref, second, v.he_id, bool_or(v.text = anchor) AS eq FROM l JOIN v ON v.order_ref = l.order_ref AND v.slot = 'subject' AND contains(v.text, anchor) WHERE anchor <> '' GROUP BY ALL),
b AS (SELECT *, bool_or(eq) OVER (PARTITION BY label_id) AS any_eq FROM s),
k AS (SELECT label_id, count(*) AS n, min(he_id) AS least, bool_or(eq) AS eq FROM b WHERE (eq OR NOT any_eq) AND (second IS NULL OR EXISTS (SELECT 1 FROM v WHERE v.he_id = b.he_id AND v.order_ref = b.order_ref AND contains(v.text, b.second))) GROUP BY label_id)
SELECT l.label_id, CASE WHEN n IS NULL THEN 'none' WHEN eq THEN 'equal' ELSE 'contains' END AS tier, coalesce(n, 0) AS n, l.he_id, CASE WHEN n = 1 THEN least END AS found,
  CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN n IS NULL AND l.he_id <> 'he-gone' THEN 'STALE' WHEN n IS NULL THEN 'LOST' WHEN least = l.he_id THEN 'OK' WHEN l.he_id <> 'he-gone' THEN 'MOVED' ELSE 'DRIFTED' END AS status FROM l LEFT JOIN k USING (label_id)"""


@query(_DRIFT)
def label_drift(spark: SparkSession, d: str) -> DataFrame:
    """A label for every order: some ids gone or another's, anchors whole, in pieces or in other case, second anchors that fit or do not."""
    rows = _coarse(spark, d)
    orders = rows.groupBy("order_ref").agg(F.min("he_id").alias("low"), F.max("he_id").alias("high"), F.min_by("subject", "he_id").alias("subject"), F.min_by("condition", "he_id").alias("condition"))
    k, s, c = F.substring("order_ref", 7, 20).cast("long"), F.col("subject"), F.col("condition")
    labels = orders.select(
        k.alias("label_id"), F.when(k % 5 == 0, "he-gone").when(k % 5 == 1, F.col("high")).otherwise(F.col("low")).alias("he_id"), F.col("order_ref").alias("doc_key"),
        F.when(k % 4 == 0, F.upper(s)).when(k % 4 == 1, F.substring(s, 1, 4)).when(k % 4 == 2, s).otherwise(F.substring(s, 3, 7)).alias("anchor"),
        F.when(k % 3 == 1, c).when(k % 3 == 2, F.when(k % 2 == 0, "zzz").otherwise(F.substring(c, 1, 1))).alias("second"),
    )
    others = F.array_compact(F.array(*[x for x in m.SLOTS if x != "subject"]))
    values = rows.select("he_id", F.col("order_ref").alias("doc_key"), "subject", others.alias("others"))
    return lookup.resolve_labels(labels, values)


# ---- reasons of alias groups


def _group_key(case: bool = True, domain: bool = True, joints: bool = True) -> str:
    base = _FOLDED if case else "trim(nfc_normalize(name))"
    host = _HOST.replace("a-z", "A-Za-z")
    short = f"CASE WHEN regexp_matches({base}, '{host}') THEN split_part({base}, '.', 1) ELSE {base} END" if domain else base
    return f"regexp_replace({short}, '[\\s_-]+', '', 'g')" if joints else short


@query(
    f""", g AS (SELECT scope, name, {_group_key()} AS group_key, {_group_key(case=False)} AS c, {_group_key(domain=False)} AS h, {_group_key(joints=False)} AS j FROM {_NAMES}),
z AS (SELECT scope, group_key, concat_ws(',', CASE WHEN count(DISTINCT c) > 1 THEN 'case' END, CASE WHEN count(DISTINCT h) > 1 THEN 'domain' END, CASE WHEN count(DISTINCT j) > 1 THEN 'joints' END) AS reasons FROM g GROUP BY ALL HAVING count(DISTINCT name) > 1)
SELECT *, count(*) OVER (PARTITION BY group_key) AS n_scopes FROM z"""
)
def alias_reasons(spark: SparkSession, d: str) -> DataFrame:
    k, seg = F.col("c_custkey") % 4, F.col("c_mktsegment")
    name = F.when(k == 0, F.upper(seg)).when(k == 1, F.concat(F.lower(seg), F.lit(".corp.example"))).when(k == 2, F.replace(seg, F.lit("U"), F.lit("u-"))).otherwise(seg)
    names = m.table(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey") % 3).alias("scope"), name.alias("name")).distinct()
    return ratios.alias_reasons(names).withColumn("reasons", F.array_join("reasons", ","))


# ---- vector index


@query(_NEIGHBOURS + "SELECT probe_id, count(*) AS n_exact, true AS enough FROM k WHERE rank <= 10 GROUP BY probe_id")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours of every probe, and whether the index finds nine of ten of them over all probes."""
    rows, context = m.vectors(spark, d), user_context(pol.DEFAULT, "admin", "s0")
    centroids = vector_index.fit(rows)
    index = vector_index.write(rows, centroids, f"{shared_dir(spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}")
    exact = held(vector.top_k_many(rows, _probes(spark, d), context, "chunks", 10), "exact")
    found = vector_index.search(index, centroids, _probes(spark, d), context, "chunks", 10, probed=3 * vector_index.CELLS // 4, threshold=vector.THRESHOLD)
    each = held(vector_index.recall(found, exact), "recall")
    total = each.agg(F.sum("n_found").alias("f"), F.sum("n_exact").alias("e")).first()
    return each.select("probe_id", "n_exact", F.lit(10 * (total["f"] or 0) >= 9 * (total["e"] or 0)).alias("enough"))


# ---- context blocks


@query(f"SELECT request, CAST(rank AS INTEGER) AS row_no, CAST(rank AS INTEGER) AS ordinal, he_id AS value FROM {_ROWS}")
def block_rows(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every request, with cells of quotes, commas and line breaks, read back."""
    rows = _requests(spark, d).select("request", "rank", F.col("rank").alias("id"), F.concat(F.lit('say "'), "text", F.lit('",\n, and "more')).alias("note"), "he_id")
    blocks = lookup.context_csv(rows, "id", "note", "he_id")
    headed = blocks.select("request", F.concat(F.lit("id,note,hyperedge\n"), "block").alias("block"))
    return answers.block_rows(headed, "request", "block")


# ---- policies as stored


@query("SELECT CASE variant WHEN 'full' THEN 1 ELSE 2 END AS since, CASE variant WHEN 'full' THEN 2 END AS until, p.role, count(*) AS n_docs FROM docs d JOIN allpolicy p USING (filter_key) WHERE variant IN ('full', 'binary') AND level = 'L2' GROUP BY variant, p.role")
def policy_swaps(spark: SparkSession, d: str) -> DataFrame:
    """Documents that each role reads whole before and after a swap, from one table of all policies the space had."""
    path = f"{shared_dir(spark).rstrip('/')}/policies-{uuid.uuid4().hex}"
    for policy in (pol.DEFAULT, pol.variant(pol.DEFAULT, "binary")):
        version = catalogue.swap(spark, path, "s0", catalogue.document(policy, m.RANKS, m.GROUPS), "owner")
    per_key = m.documents(spark, d).groupBy("filter_key").agg(F.count("*").alias("n"))
    dim = catalogue.dimensions(spark, version).where("level = 'L2'")
    out = per_key.join(F.broadcast(dim), "filter_key").groupBy("since", "until", "role").agg(F.sum("n").alias("n_docs"))  # dim: swaps x roles x scopes x types
    return out.select(F.col("since").cast("int").alias("since"), F.col("until").cast("int").alias("until"), "role", "n_docs")


# ---- metered completions

_WORDS_OF = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))"


@query(f"SELECT 'echo' AS model, count(*) AS calls, CAST(0 AS BIGINT) AS failed, CAST(sum({_WORDS_OF}) AS BIGINT) AS prompt_tokens, CAST(sum({_WORDS_OF}) AS BIGINT) AS completion_tokens FROM benchmark WHERE {_WORDS_OF} > 0")
def completion_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage rows of one pass over the benchmark items with the offline provider."""
    done = held(completion.complete(m.table(spark, d, "benchmark"), "item_id", "text", completion.EchoProvider(), real=True), "completions")
    return completion.usage(done)
