"""Measurement suite over graph snapshots: n-ary ratios, composition risk, ranks, distributions, recall, alias mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.keys import key_type, rank_of
from veilgraph.functions.text import grouping_key
from veilgraph.model import NARY_ROLES, SENSITIVE_RANK, SLOTS
from veilgraph.sources.held import held


def ratio(a: Column, b: Column) -> Column:
    """Four places; null over nothing."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)


def n_roles(slot: Column) -> Column:
    """Aggregate: how many of the roles occur, as a set of bits."""
    return F.bit_count(F.bit_or(F.coalesce(*[F.when(slot == s, 1 << i) for i, s in enumerate(SLOTS)]))).cast("long")


def ranked(snapshot: DataFrame, doc_types: DataFrame) -> DataFrame:
    """Adds rank: of the key's type, or the highest of the contributing documents where there is no key.

    snapshot(he_id, filter_key, ...), doc_types(he_id, doc_no, ctype).
    """
    highest = doc_types.groupBy("he_id").agg(F.max(rank_of(F.col("ctype"))).alias("_doc_rank"))
    return snapshot.join(highest, "he_id", "left").withColumn("rank", F.coalesce(rank_of(key_type(F.col("filter_key"))), "_doc_rank")).drop("_doc_rank")


def nary_ratios(rows: DataFrame) -> DataFrame:
    """One row: counts and ratios of n-ary hyperedges, overall and among sensitive ones; rows(he_id, n_roles, rank)."""
    nary, hot = F.col("n_roles") >= NARY_ROLES, F.col("rank") >= SENSITIVE_RANK
    counts = rows.agg(F.count("*").alias("n"), F.count_if(nary).alias("n_nary"), F.count_if(hot).alias("n_sensitive"), F.count_if(nary & hot).alias("n_sensitive_nary"))
    return counts.select("*", ratio(F.col("n_nary"), F.col("n")).alias("nary_ratio"), ratio(F.col("n_sensitive_nary"), F.col("n_sensitive")).alias("sensitive_ratio"))


def composition_risk(rows: DataFrame, incidence: DataFrame, scopes: DataFrame) -> DataFrame:
    """(he_id, n_entities, n_exposed, at_risk) of sensitive hyperedges.

    An entity of a sensitive hyperedge is exposed where a hyperedge that is not sensitive holds it
    in one of the same scopes; the hyperedge is at risk when all its entities are.
    rows(he_id, rank), incidence(he_id, entity_id), scopes(he_id, scope).
    """
    own = scopes.select("he_id", "scope").distinct().groupBy("he_id").agg(F.collect_set("scope").alias("scopes")).join(rows.select("he_id", "rank"), "he_id")  # a space has few scopes
    placed = held(incidence.select("he_id", "entity_id").distinct().join(own, "he_id"), "placed")
    low = placed.where(F.col("rank") < SENSITIVE_RANK).select("entity_id", F.explode("scopes").alias("scope")).distinct()
    hot = placed.where(F.col("rank") >= SENSITIVE_RANK).join(low.groupBy("entity_id").agg(F.collect_set("scope").alias("open")), "entity_id", "left")
    counts = hot.groupBy("he_id").agg(F.count("*").alias("n_entities"), F.count_if(F.arrays_overlap("scopes", "open")).alias("n_exposed"))
    return counts.withColumn("at_risk", F.col("n_entities") == F.col("n_exposed"))


def distributions(rows: DataFrame, incidence: DataFrame) -> DataFrame:
    """(kind, value, n): hyperedges by number of roles, role, and rank."""
    part = lambda kind, frame, column: frame.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return part("roles", rows, "n_roles").unionByName(part("rank", rows, "rank")).unionByName(part("slot", incidence.select("he_id", "slot").distinct(), "slot"))


def run_range(runs: DataFrame, group: str, value: str) -> DataFrame:
    """(group, low, high, amplitude, mean): groups with two runs or more."""
    out = runs.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")).where("n >= 2")
    return out.select(group, F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round(F.col("high") - F.col("low"), 4).alias("amplitude"), F.round("mean", 4).alias("mean"))


def restrict(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """he_ids whose every document is kept; documents(he_id, doc_no), kept(doc_no)."""
    marked = documents.join(kept.select("doc_no", F.lit(True).alias("_kept")).distinct(), "doc_no", "left")
    return marked.groupBy("he_id").agg(F.every(F.col("_kept").isNotNull()).alias("_all")).where("_all").select("he_id")


def multi_source(rows: DataFrame) -> DataFrame:
    """(entity_id, n_docs, n_edges, roles): entities of two documents or more; rows(entity_id, doc_no, he_id, slot).

    Documents are counted first, and edges and roles only of the entities that are left; all sets are distinct rows, which combine before the shuffle.
    """
    docs = rows.where("doc_no is not null").select("entity_id", "doc_no").distinct().groupBy("entity_id").agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    several = held(docs, "several")
    cells = held(rows.join(several.select("entity_id"), "entity_id", "left_semi").select("entity_id", "he_id", "slot").distinct(), "several-cells")
    edges = cells.where("he_id is not null").select("entity_id", "he_id").distinct().groupBy("entity_id").agg(F.count("*").alias("n_edges"))
    roles = cells.where("slot is not null").select("entity_id", "slot").distinct().groupBy("entity_id").agg(F.sort_array(F.collect_list("slot")).alias("roles"))  # bounded by the slots
    none = F.array().cast("array<string>")
    return several.join(edges, "entity_id", "left").join(roles, "entity_id", "left").select("entity_id", "n_docs", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"), F.coalesce("roles", none).alias("roles"))


def alias_candidates(names: DataFrame) -> DataFrame:
    """(scope, group_key, canonical, variants): names(scope, name, n) that meet after folding; frequent, short, small names first."""
    grouped = names.withColumn("group_key", grouping_key(F.col("name"))).groupBy("scope", "group_key")
    order = F.struct(-F.col("n"), F.char_length("name"), F.col("name"))
    return grouped.agg(F.min_by("name", order).alias("canonical"), F.sort_array(F.collect_set("name")).alias("variants")).where(F.size("variants") > 1)


#: Rules that bring names together, by what they leave out.
RULES = ("case", "domain", "joints")


def alias_reasons(names: DataFrame) -> DataFrame:
    """(scope, group_key, reasons, n_scopes): the rules without which a group of alias_candidates() falls apart, and in how many scopes it is one.

    All variants of the rules are keyed in one pass and counted in one aggregation.
    """
    without = {rule: grouping_key(F.col("name"), **{rule: False}) for rule in RULES}
    keyed = names.select("scope", "name", grouping_key(F.col("name")).alias("group_key"), *[k.alias(f"no_{r}") for r, k in without.items()])
    sizes = keyed.groupBy("scope", "group_key").agg(F.count_distinct("name").alias("n"), *[F.size(F.collect_set(f"no_{r}")).alias(r) for r in RULES]).where("n > 1")
    reasons = F.array_compact(F.array(*[F.when(F.col(r) > 1, F.lit(r)) for r in RULES]))
    scopes = sizes.groupBy("group_key").agg(F.count("*").alias("n_scopes"))
    return sizes.select("scope", "group_key", reasons.alias("reasons")).join(scopes, "group_key").select("scope", "group_key", "reasons", "n_scopes")


#: Roles that a policy may have.
MAX_ROLES = 1_000


def recall(labels: DataFrame, levels: DataFrame) -> DataFrame:
    """(role, grp, n, n_found, n_scope, n_level, recall), totals of each role with grp null, and the grand total with both null.

    labels(question, grp, filter_key), levels(role, filter_key, level).  What a role does not find is lost
    to its scopes (no row of its policy) or to a level below L1.
    """
    roles = [r["role"] for r in levels.select("role").distinct().limit(MAX_ROLES + 1).collect()]
    if len(roles) > MAX_ROLES:
        raise ValueError(f"a policy has at most {MAX_ROLES} roles")
    asked = labels.withColumn("role", F.explode(F.array(*map(F.lit, roles)).cast("array<string>")))
    joined = asked.join(levels, ["role", "filter_key"], "left")
    hit = F.coalesce("level", F.lit("L0")) >= "L1"
    counts = joined.rollup("role", "grp").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("n_found"), F.count_if(F.col("level").isNull()).alias("n_scope"), F.count_if(F.col("level") < "L1").alias("n_level")
    )
    return counts.withColumn("recall", ratio(F.col("n_found"), F.col("n")))


def confusion(pairs: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(gold, one column a role and extra): counts of predicted against gold roles."""
    return pairs.groupBy(F.coalesce("gold", F.lit("missing")).alias("gold")).pivot("pred", [*roles, "extra"]).agg(F.count(F.lit(1))).na.fill(0)


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; null over nothing."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
