"""Data model: slot roles, sensitivity ranks, and the projection of relational tables onto it.

The projection gives every operator real rows to work on: labelled documents, n-ary facts drawn
from orders and parts, the bipartite incidence of facts and slot values, vectors, audit events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Slot roles in canonical order.
SLOTS = ("subject", "symptom", "cause", "condition", "remediation", "source", "time", "owner")
OWNER = "owner"
MASKABLE = SLOTS[:-1]
COARSE = SLOTS[:5]

LEVELS = ("L0", "L1", "L2")
#: Lowest level at which a namespace shows a key.
NAMESPACE_LEVEL = {"chunks": "L2", "entities": "L2", "hyperedges": "L1"}

SCOPES = ("internal", "customer_a", "customer_b")
RANKS = {
    "announcement": 2, "faq": 4, "runbook": 6, "change_plan": 8, "inventory": 10, "architecture": 12, "training": 14,
    "vendor_contract": 16, "access_log": 18, "incident_report": 20, "postmortem": 24, "audit_finding": 27, "secret_infra": 30,
}
TYPES = tuple(RANKS)
GROUPS = {t: ("helpdesk", "platform", "security")[i % 3] for i, t in enumerate(TYPES) if t != "training"}
SENSITIVE_RANK = 20
NARY_ROLES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def scope_of(number: Column) -> Column:
    return _pick(SCOPES, number)


def type_of(number: Column) -> Column:
    return _pick(TYPES, number)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc_key, scope, ctype, filter_key, text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("doc_key"), scope_of(F.col("doc_id")).alias("scope"), type_of(F.col("doc_id")).alias("ctype"), "text")
    return docs.withColumn("filter_key", F.concat_ws(":", "scope", "ctype"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One n-ary fact a line item: line columns, doc_no, and the eight slots (null: not filled)."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    # orders are hashed, so line items are not sorted by them; narrow rows are shuffled, and lie by l_orderkey where parts can be broadcast
    joined = line.join(order.hint("shuffle_hash"), line["l_orderkey"] == order["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    return joined.select(
        "l_orderkey",
        (F.col("l_orderkey") % 200).alias("doc_no"),
        F.col("p_name").alias("subject"),
        F.when(F.col("l_quantity") > 25, F.col("p_type")).alias("symptom"),
        F.when(F.col("l_discount") > 0.05, F.col("o_orderpriority")).alias("cause"),
        F.concat("l_returnflag", "l_linestatus").alias("condition"),
        F.when(F.col("l_tax") > 0.04, F.col("p_brand")).alias("remediation"),
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("source"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("time"),
        F.col("s_name").alias("owner"),
    )


def coarse_only(rows: DataFrame) -> DataFrame:
    """rows with the slots that are not in COARSE set to null."""
    return rows.withColumns({s: F.lit(None).cast("string") for s in SLOTS[5:]})


def coarse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts() without source, time and owner, so that ids repeat across documents."""
    own = facts(spark, sf_dir).select("doc_no", F.col("source").alias("order_ref"), *COARSE)
    return coarse_only(own).withColumn("filter_key", F.concat_ws(":", scope_of(F.col("doc_no")), type_of(F.col("doc_no"))))


#: Keys of suppliers that are broadcast; more are joined as Spark decides.
SUPPLIER_KEYS = 2_000_000


def order_facts(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """(order_no, the COARSE slots): the facts of coarse_facts() that the given line items make, one or more times in their order.

    Lines are shuffled by part while they are keys and marks, then by order, and nothing else is written; suppliers only filter.
    """
    order, part, known = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier").select("s_suppkey")
    if known.count() <= SUPPLIER_KEYS:
        known = F.broadcast(known)
    marks = sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate((F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04)))
    line = lines.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_orderkey", "l_partkey", marks.alias("marks"), F.concat("l_returnflag", "l_linestatus").alias("condition"))
    marked = lambda i: F.col("marks").bitwiseAND(1 << i) > 0
    made = line.join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    made = made.select("l_orderkey", marked(1).alias("cut"), F.col("p_name").alias("subject"), F.when(marked(0), F.col("p_type")).alias("symptom"), "condition", F.when(marked(2), F.col("p_brand")).alias("remediation"))
    rows = made.join(order.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_orderkey").alias("order_no"), "subject", "symptom", F.when(F.col("cut"), F.col("o_orderpriority")).alias("cause"), "condition", "remediation")


def once_in_order(rows: DataFrame) -> DataFrame:
    """order_facts() without repeats; rows lie sorted by order_no.  The window needs an order's rows in one partition, so they are whatever the joins become."""
    slots = F.struct(*COARSE)
    last = F.lag(slots).over(Window.partitionBy("order_no").orderBy(*COARSE))
    return rows.withColumn("_last", last).where(~F.col("_last").eqNullSafe(slots)).drop("_last")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, namespace, filter_key, embedding)."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", _pick(("chunks", "entities", "hyperedges"), F.col("vec_id")).alias("namespace"), F.concat_ws(":", scope_of(F.col("vec_id")), type_of(F.col("label"))).alias("filter_key"), "embedding")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, tier, event, act, space, tokens, cost, model, details)."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id",
        "ts",
        F.when(F.col("event_type").isin("purchase", "error"), "mutation").otherwise("observation").alias("tier"),
        F.col("event_type").alias("event"),
        F.concat(F.lit("u"), "user_id").alias("act"),
        F.concat(F.lit("s"), F.col("user_id") % 3).alias("space"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        F.col("value").alias("cost"),
        F.concat(F.lit("model-"), F.col("user_id") % 4).alias("model"),
        F.col("props").alias("details"),
    )
