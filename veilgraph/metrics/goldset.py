"""Counts and integrity of gold sets and corpora; every check returns its violations as rows (check, doc_key, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.keys import rank_of
from veilgraph.functions.text import collapse, fold
from veilgraph.model import SLOTS
from veilgraph.sources.held import small_batches


def _filled(gold: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("value")) for s in SLOTS])
    return gold.select("doc_key", "fact_id", F.explode(F.filter(cells, lambda x: x["value"].isNotNull())).alias("x")).select("doc_key", "fact_id", "x.slot", "x.value")


def gold_counts(gold: DataFrame) -> DataFrame:
    """(kind, value, n): facts, filled slots, slots by role, and fact ids that occur in several documents."""
    row = lambda frame, kind, value, n: frame.select(F.lit(kind).alias("kind"), value.cast("string").alias("value"), n.alias("n"))
    slots = _filled(gold).groupBy("slot").agg(F.count("*").alias("n"))
    shared = gold.groupBy("fact_id").agg(F.count_distinct("doc_key").alias("n")).where("n > 1")
    nothing = F.lit(None)
    return (
        row(gold.agg(F.count("*").alias("c")), "facts", nothing, F.col("c"))
        .union(row(slots.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("c")), "slots", nothing, F.col("c")))
        .union(row(slots, "role", F.col("slot"), F.col("n")))
        .union(row(shared.agg(F.count("*").alias("c")), "shared_ids", nothing, F.col("c")))
    )


def gold_violations(gold: DataFrame, documents: DataFrame) -> DataFrame:
    """Faults of gold(doc_key, fact_id, sentence, slots) against documents(doc_key, ctype, text).

    NO_DOCUMENT; NOT_NORMAL, a value that normalising changes; NOT_IN_BODY, a value that the folded text
    lacks; NOT_VERBATIM, a sentence that the text lacks as it stands; DUPLICATE, a fact id twice in a
    document; UNKNOWN_TYPE, a document type without a rank; UNCOVERED, a role that no fact fills.  A null
    text has no values and no sentences.  A document's facts are gathered before its text is
    joined to them, once, and looked for in it by array functions.
    """
    small_batches(gold.sparkSession)
    out = lambda frame, check, item: frame.select(F.lit(check).alias("check"), "doc_key", item.cast("string").alias("item"))
    known = documents.select("doc_key", F.lit(True).alias("_known"))
    facts = gold.join(known, "doc_key", "left")
    values = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("value"), collapse(s).alias("plain"), fold(s).alias("folded")) for s in SLOTS])
    gathered = gold.select("doc_key", "fact_id", "sentence", values.alias("values")).groupBy("doc_key").agg(F.collect_list(F.struct("fact_id", "sentence", "values")).alias("facts"))
    whole = documents.select("doc_key", F.coalesce("text", F.lit("")).alias("text")).join(gathered, "doc_key").withColumn("body", fold("text"))
    fault = lambda check, item: F.struct(F.lit(check).alias("check"), item.alias("item"))

    def of_fact(f: Column) -> Column:
        cell = lambda check: lambda x: fault(check, F.concat_ws(":", f["fact_id"], x["slot"]))
        strange = F.filter(f["values"], lambda x: x["value"].isNotNull() & (x["value"] != x["plain"]))
        lacking = F.filter(f["values"], lambda x: x["value"].isNotNull() & ~F.contains(F.col("body"), x["folded"]))
        unsaid = F.filter(F.array(f["sentence"]), lambda x: ~F.contains(F.col("text"), x))
        return F.concat(F.transform(strange, cell("NOT_NORMAL")), F.transform(lacking, cell("NOT_IN_BODY")), F.transform(unsaid, lambda _: fault("NOT_VERBATIM", f["fact_id"].cast("string"))))

    judged = whole.select("doc_key", F.explode(F.flatten(F.transform("facts", of_fact))).alias("x")).select("x.check", "doc_key", "x.item")
    twice = gold.groupBy("doc_key", "fact_id").agg(F.count("*").alias("n")).where("n > 1")
    types = documents.where(F.col("ctype").isNotNull() & rank_of(F.col("ctype")).isNull())
    roles = gold.sparkSession.createDataFrame([(None, s) for s in SLOTS], "doc_key string, slot string")
    return (
        out(facts.where("_known is null"), "NO_DOCUMENT", F.col("fact_id"))
        .union(judged)
        .union(out(twice, "DUPLICATE", F.col("fact_id")))
        .union(out(types, "UNKNOWN_TYPE", F.col("ctype")))
        .union(out(roles.join(_filled(gold).select("slot").distinct(), "slot", "left_anti"), "UNCOVERED", F.col("slot")))
    )


def corpus_violations(declared: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """Faults of a corpus: declared and found are (doc_key, scope, ctype), facts(doc_key, sentence).

    UNDECLARED and ABSENT documents, a different SCOPE or TYPE (item: what was found), and REPEATED
    sentences, which several documents state (doc_key: the first).
    """
    side = lambda frame, p: frame.select("doc_key", F.col("scope").alias(f"{p}_scope"), F.col("ctype").alias(f"{p}_type"), F.lit(True).alias(p))
    both = side(declared, "a").join(side(found, "b"), "doc_key", "full")
    differ = lambda c: F.col("a") & F.col("b") & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    check: Column = F.array_compact(F.array(
        F.when(F.col("a").isNull(), F.struct(F.lit("UNDECLARED").alias("check"), F.col("b_type").alias("item"))),
        F.when(F.col("b").isNull(), F.struct(F.lit("ABSENT").alias("check"), F.col("a_type").alias("item"))),
        F.when(differ("scope"), F.struct(F.lit("SCOPE").alias("check"), F.col("b_scope").alias("item"))),
        F.when(differ("type"), F.struct(F.lit("TYPE").alias("check"), F.col("b_type").alias("item"))),
    ))
    shared = facts.groupBy("sentence").agg(F.count_distinct("doc_key").alias("n"), F.min("doc_key").alias("doc_key")).where("n > 1")
    return both.select("doc_key", F.explode(check).alias("x")).select("x.check", "doc_key", "x.item").union(shared.select(F.lit("REPEATED"), "doc_key", "sentence"))
