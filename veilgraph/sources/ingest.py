"""Incremental ingest: classify, write, provenance delete, reconcile, all through versions of a space.

Keys and sources of artifacts are always those of the documents that still hold them, since they are merged from
provenance when read.  Provenance, ledger, chunks and the audit row of a change become visible together,
in one version; a change whose audit row cannot be written does not happen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions.keys import merge_by, merged_key
from veilgraph.model import RANKS
from veilgraph.sources.held import held
from veilgraph.sources.versions import Version, commit, latest, rows_of, vacuum

STATUSES = ("new", "reingest", "unchanged", "duplicate", "unknown_rank", "no_facts")


def classify(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_key, status): batch(doc_key, scope, ctype, body) against ledger(doc_key, sha, scope, ctype).

    unknown_rank, duplicate (same content under another key), unchanged (same content and labels),
    reingest or new.
    """
    return _judged(batch.select("doc_key", "scope", "ctype", F.sha2("body", 256).alias("sha")), ledger)


def _judged(shown: DataFrame, ledger: DataFrame) -> DataFrame:
    """classify() of shown(doc_key, scope, ctype, sha)."""
    old = ledger.select("doc_key", F.col("sha").alias("old_sha"), F.col("scope").alias("old_scope"), F.col("ctype").alias("old_ctype"))
    others = ledger.groupBy("sha").agg(F.min("doc_key").alias("low_key"), F.max("doc_key").alias("high_key"))
    joined = shown.join(old, "doc_key", "left").join(others, "sha", "left")
    status = (
        F.when(~F.col("ctype").isin(*RANKS), "unknown_rank")
        .when((F.col("low_key") != F.col("doc_key")) | (F.col("high_key") != F.col("doc_key")), "duplicate")
        .when((F.col("old_sha") == F.col("sha")) & (F.col("old_scope") == F.col("scope")) & (F.col("old_ctype") == F.col("ctype")), "unchanged")
        .when(F.col("old_sha").isNotNull(), "reingest")
        .otherwise("new")
    )
    return joined.select("doc_key", status.alias("status"))


def artifacts_on_delete(provenance: DataFrame, gone: DataFrame) -> DataFrame:
    """(art_id, fate, filter_key): provenance(art_id, doc_key, filter_key), gone(doc_key).

    private artifacts only had the deleted documents; shared ones keep their other sources and get
    the key those merge to.
    """
    marked = provenance.join(gone.select("doc_key", F.lit(True).alias("_gone")), "doc_key", "left")
    # counts of an artifact's keys are hashed; of each key one row is left for the merge of strings
    each = marked.groupBy("art_id", "filter_key").agg(F.count_if("_gone").alias("n_gone"), F.count_if(F.col("_gone").isNull()).alias("n_left"))
    left = F.col("n_left") > 0
    merged = each.groupBy("art_id").agg(F.sum("n_gone").alias("n_gone"), F.sum("n_left").alias("n_left"), merged_key(F.col("filter_key"), left).alias("filter_key"))
    return merged.where("n_gone > 0").select("art_id", F.when(F.col("n_left") == 0, "private").otherwise("shared").alias("fate"), "filter_key")


def reconcile(reports: DataFrame, expected: DataFrame) -> DataFrame:
    """(id_join, n_states, missing): ids whose stores disagree or whose expected store is silent.

    reports(id_join, store, state, ambiguous): state is a key, NONE or ABSENT; an ambiguous ABSENT
    may also be NONE.  expected(id_join, store).
    """
    options = F.when(F.col("ambiguous") & (F.col("state") == "ABSENT"), F.array(F.lit("ABSENT"), F.lit("NONE"))).otherwise(F.array("state"))
    stores = reports.groupBy("id_join").agg(F.count_distinct("store").alias("stores"))
    possible = reports.select("id_join", "store", F.explode(options).alias("state")).groupBy("id_join", "state").agg(F.count_distinct("store").alias("n")).groupBy("id_join").agg(F.max("n").alias("agree"))
    kinds = reports.groupBy("id_join").agg(F.count_distinct("state").alias("n_states"))
    silent = expected.join(reports.select("id_join", "store").distinct(), ["id_join", "store"], "left_anti").groupBy("id_join").agg(F.count("*").alias("missing"))
    joined = stores.join(possible, "id_join").join(kinds, "id_join").join(silent, "id_join", "full")
    return joined.where("agree < stores or missing > 0").select("id_join", F.coalesce("n_states", F.lit(0)).alias("n_states"), F.coalesce("missing", F.lit(0)).alias("missing"))


def drop_duplicate_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of chunks(chunk_id, doc_key, filter_key, content) without those whose document stored has with the same chunk_id already, each once."""
    fresh = chunks.join(stored.select("chunk_id", "doc_key"), ["chunk_id", "doc_key"], "left_anti")
    return fresh.groupBy("chunk_id", "doc_key").agg(F.min(F.struct("filter_key", "content")).alias("x")).select("chunk_id", "doc_key", "x.*")


def stored_chunks(spark: SparkSession, version: Version) -> DataFrame:
    """(chunk_id, filter_key, sources, content): one row a content, with the key its documents merge to."""
    rows = rows_of(spark, version, "chunks")
    return rows.groupBy("chunk_id").agg(merged_key(F.col("filter_key")).alias("filter_key"), F.sort_array(F.collect_set("doc_key")).alias("sources"), F.min("content").alias("content"))


def _audit(spark: SparkSession, event: str, act: str, at: Column, counts: DataFrame) -> DataFrame:
    """One mutation row whose details are counts as JSON."""
    return counts.select(F.lit(event).alias("event"), F.lit(act).alias("act"), at.cast("timestamp").alias("at"), F.to_json(F.struct("*")).alias("details"))


def ingest(batch: DataFrame, artifacts: DataFrame, store: str, space: str, chunks: DataFrame | None = None, act: str = "ingest", at: Column | None = None, base: Version | None = None) -> DataFrame:
    """(doc_key, status) after batch(doc_key, scope, ctype, body) with its artifacts(doc_key, art_id, filter_key) is committed.

    Statuses are those of classify(); of documents with one content in the batch the first doc_key is
    taken and the others are duplicates; a taken document without artifacts is no_facts and leaves
    nothing behind.  A re-ingested document loses all it had before.  A doc_key that repeats in the
    batch is an error; so is a commit by another writer since base (the newest version, if not given).
    """
    spark = batch.sparkSession
    if not batch.groupBy("doc_key").count().where("count > 1").isEmpty():
        raise ValueError("a doc_key repeats in the batch")
    base = base or latest(spark, store, space)
    shown = held(batch.select("doc_key", "scope", "ctype", F.sha2("body", 256).alias("sha")), "ingest-batch")  # bodies are read once
    firsts = shown.groupBy("sha").agg(F.min("doc_key").alias("first_key"))
    with_facts = artifacts.select("doc_key", F.lit(True).alias("has_facts")).distinct()
    known = _judged(shown, rows_of(spark, base, "ledger")).join(shown, "doc_key").join(firsts, "sha").join(with_facts, "doc_key", "left")
    arriving = F.col("status").isin("new", "reingest")
    status = F.when(arriving & (F.col("first_key") != F.col("doc_key")), "duplicate").when(arriving & F.col("has_facts").isNull(), "no_facts").otherwise(F.col("status"))
    judged = held(known.select("doc_key", "sha", "scope", "ctype", status.alias("status"), arriving.alias("replaced"), (F.col("status") == "reingest").alias("had")), "ingest-status")
    taken = judged.where("status in ('new', 'reingest')")
    own = taken.select("doc_key")
    adds = {
        # whatever arrives with new content replaces what its key had, even if nothing of it is taken
        "gone": judged.where("had and status <> 'duplicate'").select("doc_key"),
        "provenance": artifacts.join(own, "doc_key", "left_semi").select("art_id", "doc_key", "filter_key").distinct(),
        "ledger": taken.select("doc_key", "sha", "scope", "ctype"),
        "audit": _audit(spark, "ingest", act, at if at is not None else F.current_timestamp(), judged.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])),
    }
    if chunks is not None:
        # chunks of a replaced document go with it, so only those of documents that stay can be there already
        staying = rows_of(spark, base, "chunks").join(adds["gone"], "doc_key", "left_anti")
        adds["chunks"] = drop_duplicate_chunks(chunks.join(own, "doc_key", "left_semi"), staying)
    commit(spark, base, adds)
    return judged.select("doc_key", "status")


def remove(gone: DataFrame, store: str, space: str, act: str = "remove", at: Column | None = None, base: Version | None = None) -> DataFrame:
    """artifacts_on_delete() of gone(doc_key), after the documents are taken out of the store."""
    spark = gone.sparkSession
    base = base or latest(spark, store, space)
    keys = held(gone.select("doc_key").distinct(), "delete-keys")
    fates = held(artifacts_on_delete(rows_of(spark, base, "provenance"), keys), "delete-fates")
    counts = fates.agg(F.count_if(F.col("fate") == "private").alias("private"), F.count_if(F.col("fate") == "shared").alias("shared"))
    commit(spark, base, {"gone": keys, "audit": _audit(spark, "remove", act, at if at is not None else F.current_timestamp(), counts)})
    return fates


def drop_space(spark: SparkSession, store: str, space: str, act: str = "drop", at: Column | None = None) -> None:
    """A tenant goes: a version without documents, then everything that older ones hold; the audit rows stay."""
    base = latest(spark, store, space)
    row = _audit(spark, "drop_space", act, at if at is not None else F.current_timestamp(), spark.range(1).select(F.lit(base.number).alias("last_version")))
    commit(spark, base, {"audit": rows_of(spark, base, "audit").union(row)}, replace=True)
    vacuum(spark, store, space)


def stored_artifacts(spark: SparkSession, version: Version) -> DataFrame:
    """(art_id, filter_key, sources): artifacts with the key and the sorted sources that their documents merge to."""
    rows = rows_of(spark, version, "provenance")
    return rows.groupBy("art_id").agg(merged_key(F.col("filter_key")).alias("filter_key"), F.sort_array(F.collect_set("doc_key")).alias("sources"))


def artifact_sizes(spark: SparkSession, version: Version) -> DataFrame:
    """(art_id, filter_key, n_sources): stored_artifacts() with sources counted; rows are hashed, no list of them is made."""
    rows = rows_of(spark, version, "provenance")
    merged = merge_by(rows, "art_id").withColumnRenamed("art_id", "of_id")
    sizes = rows.groupBy("art_id").agg(F.count_distinct("doc_key").alias("n_sources"))
    return sizes.join(merged, F.col("art_id").eqNullSafe(F.col("of_id"))).select("art_id", "filter_key", "n_sources")
