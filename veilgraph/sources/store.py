"""Stored dimensions and snapshots: accounts, batch status, ledgers, graph snapshots, measurement files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.model import SLOTS
from veilgraph.sources.held import held


def sync_accounts(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """Accounts after a seed: seed attributes win, other accounts stay."""
    return stored.join(seed.select("account"), "account", "left_anti").unionByName(seed)


def batch_status(runs: DataFrame, costs: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` rows of document states with cost; running rows show no code or reason."""
    order = (F.desc("started"), "doc_key")
    top = held(runs.orderBy(*order).limit(keep), "newest")  # a report of `keep` rows
    own = costs.join(F.broadcast(top.select("doc_key")), "doc_key", "left_semi")
    hidden = lambda c: F.when(F.col("status") != "running", F.col(c)).alias(c)
    return top.join(own, "doc_key", "left").select("doc_key", "started", "status", hidden("code"), hidden("reason"), "cost").orderBy(*order).limit(keep)


def snapshot(incidence: DataFrame) -> DataFrame:
    """(he_id, slots): values of each slot as sorted sets; incidence(he_id, slot, entity_id)."""
    each = incidence.groupBy("he_id", "slot").agg(F.sort_array(F.collect_set("entity_id")).alias("values"))
    return each.groupBy("he_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("slot", "values")))).alias("slots"))


def check_snapshot(rows: DataFrame) -> DataFrame:
    """(he_id, problem) of snapshot rows that break the closed schema."""
    unknown = F.size(F.array_except(F.map_keys("slots"), F.array(*map(F.lit, SLOTS)))) > 0
    empty = F.exists(F.map_values("slots"), lambda v: F.size(v) == 0)
    problem = F.when(unknown, "UNKNOWN_SLOT").when(empty, "EMPTY_SLOT").when(F.size("slots") == 0, "NO_SLOTS")
    return rows.select("he_id", problem.alias("problem")).where("problem is not null")


def write_report(counters: DataFrame, path: str) -> None:
    """Per-batch counters as JSON lines."""
    counters.write.mode("append").json(path)


def read_measurements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Measurement files, newest first; unreadable lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt").orderBy(F.desc("day"))
