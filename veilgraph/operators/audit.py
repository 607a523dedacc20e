"""Audit aggregations and grant resolution.  Times are explicit: windows are half-open, validity takes as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRANT_MINUTES = 60

# The catalogue of audit events.
EVENTS = (
    "llm_cost", "embedding_cost", "ingest_doc", "delete_doc", "delete_space", "extract_doc", "policy_swap", "query", "refusal", "filter",
    "auth_login", "startup", "permission_mismatch", "breakglass_request", "breakglass_cancel", "breakglass_approve", "breakglass_reject",
    "breakglass_grant", "role_swap",
)
TIERS = ("mutation", "observation")


def in_window(ts: Column, start: str, end: str) -> Column:
    return (ts >= F.to_timestamp(F.lit(start))) & (ts < F.to_timestamp(F.lit(end)))


def cost_by_model(events: DataFrame, space: str, start: str, end: str, kinds: tuple[str, ...]) -> DataFrame:
    """(model, n, tokens, cost) of one space and window; missing numbers count as zero."""
    own = events.where((F.col("space") == space) & F.col("event").isin(*kinds) & in_window(F.col("ts"), start, end))
    return own.groupBy(F.coalesce("model", F.lit("")).alias("model")).agg(F.count("*").alias("n"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"))


def count_by(events: DataFrame, key: str) -> DataFrame:
    """(key, n, n_observed): by one JSON key; a missing key is a group of its own."""
    return events.groupBy(F.get_json_object("details", f"$.{key}").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("tier") != "mutation").alias("n_observed"))


def tail(events: DataFrame, space: str, limit: int) -> DataFrame:
    """The newest events of a space: a report of `limit` rows."""
    return events.where(F.col("space") == space).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def sums_between(events: DataFrame, bounds: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """(bucket, at, n, cost): events summed from each bound to the next one in its time bucket; at is null before the first.

    events(ts, cost), bounds(at) in microseconds.
    """
    bucket = F.floor(F.col("at") / (bucket_seconds * 1_000_000)).alias("bucket")
    own = events.select(_micros(F.col("ts")).alias("at"), "cost", F.lit(True).alias("event")).where("at is not null")
    marks = bounds.distinct().select("at", F.lit(None).alias("cost"), F.lit(False).alias("event"))
    placed = own.union(marks).select(bucket, "*")
    last = F.max(F.when(~F.col("event"), F.col("at"))).over(Window.partitionBy("bucket").orderBy("at", "event"))
    return placed.withColumn("last", last).where("event").groupBy("bucket", F.col("last").alias("at")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def cost_by_interval(events: DataFrame, intervals: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """(doc_key, n, cost): events in each document's [start, end), by one equi-join on time buckets.

    Equal intervals are summed once.  They meet sums of the events between neighbouring bounds, not the events: a
    bound lies inside none of these, so each is in an interval as a whole or not at all.
    """
    own = intervals.select("doc_key", _micros(F.col("start")).alias("start"), _micros(F.col("end")).alias("end")).where("start < end")
    spans = own.select("start", "end").distinct()
    sums = sums_between(events, spans.select(F.explode(F.array("start", "end")).alias("at")), bucket_seconds)
    size = bucket_seconds * 1_000_000
    epoch = lambda c: F.floor(F.col(c) / size)
    wide = spans.select("start", "end", F.explode(F.sequence(epoch("start"), epoch("end"))).alias("bucket"))
    at = F.coalesce("at", F.col("bucket") * size)
    each = wide.join(sums, "bucket").where((at >= F.col("start")) & (at < F.col("end"))).groupBy("start", "end").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    return own.join(each, ["start", "end"]).groupBy("doc_key").agg(F.sum("n").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


def latest(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The newest row of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def grants(requests: DataFrame) -> DataFrame:
    """Adds expires_at to approved requests."""
    return requests.withColumn("expires_at", F.col("ts") + F.expr(f"INTERVAL {GRANT_MINUTES} MINUTES"))


def unknown_events(events: DataFrame, catalogue: tuple[str, ...] = EVENTS) -> DataFrame:
    """(event, tier, n): rows that the closed catalogue does not allow."""
    bad = ~F.coalesce(F.col("event").isin(*catalogue) & F.col("tier").isin(*TIERS), F.lit(False))
    return events.where(bad).groupBy("event", "tier").agg(F.count("*").alias("n"))


def grant_decisions(requests: DataFrame, granted: DataFrame) -> DataFrame:
    """(request_id, n_covered, refused): a request is refused if a grant of its act, role and space still covers any of its ids.

    requests(request_id, ts, act, role, space, he_ids), granted(ts, expires_at, act, role, space, he_ids).
    """
    by_id = ("act", "role", "space", "he_id")
    asked = requests.select("request_id", "ts", "act", "role", "space", F.explode_outer(F.array_distinct("he_ids")).alias("he_id"))
    live = granted.select(F.col("ts").alias("from"), "expires_at", "act", "role", "space", F.explode(F.array_distinct("he_ids")).alias("he_id"))
    held = asked.join(live, list(by_id)).where((F.col("from") <= F.col("ts")) & (F.col("ts") < F.col("expires_at"))).groupBy("request_id").agg(F.count_distinct("he_id").alias("n_covered"))
    out = requests.select("request_id").join(held, "request_id", "left").na.fill(0, ["n_covered"])
    return out.withColumn("refused", F.col("n_covered") > 0)


def active_grants(granted: DataFrame, as_of: Column) -> DataFrame:
    """(act, space, he_ids): sorted distinct ids of grants not yet expired."""
    live = granted.where((F.col("expires_at") > as_of) & (F.col("ts") <= as_of))
    return live.select("act", "space", F.explode("he_ids").alias("he_id")).distinct().groupBy("act", "space").agg(F.sort_array(F.collect_list("he_id")).alias("he_ids"))


def request_state(changes: DataFrame) -> DataFrame:
    """(request_id, state, changes): the last change wins; a request that left pending stays where it went first."""
    moved = F.min_by("state", F.when(F.col("state") != "pending", F.struct("ts", "event_id")))
    return changes.groupBy("request_id").agg(F.coalesce(moved, F.lit("pending")).alias("state"), F.count("*").alias("changes"))
