"""Integrity checks and extraction statistics; every check returns its violations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.metrics.ratios import ratio


def extraction_stats(parsed: DataFrame) -> DataFrame:
    """One row of counts over parsed(chunk, broken, code, raw_id, he_id): raw_id before and he_id after aliases."""
    good = F.col("broken").isNull() & F.col("code").isNull() & F.col("he_id").isNotNull()
    per_chunk = parsed.groupBy("chunk").agg(F.max(F.col("broken").isNotNull().cast("int")).alias("bad"), F.count_if(F.col("broken").isNull()).alias("raw"), F.count_if(good).alias("valid"), F.count_distinct(F.when(good, F.col("raw_id"))).alias("before"), F.count_distinct(F.when(good, F.col("he_id"))).alias("after"))
    out = per_chunk.agg(F.count("*").alias("chunks"), F.sum("bad").alias("broken"), F.sum("raw").alias("raw"), F.sum("valid").alias("valid"), F.sum(F.col("valid") - F.col("before")).alias("repeated"), F.sum(F.col("before") - F.col("after")).alias("merged_by_alias"))
    return out.withColumn("reject_ratio", ratio(F.col("raw") - F.col("valid"), F.col("raw")))


def alias_clashes(aliases: DataFrame) -> DataFrame:
    """(alias, n): aliases that stand for more than one value; aliases(value, alias)."""
    return aliases.groupBy("alias").agg(F.count_distinct("value").alias("n")).where("n > 1")


def label_violations(questions: DataFrame, labels: DataFrame, known: DataFrame, sizes: DataFrame) -> DataFrame:
    """(check, item): duplicate questions, labels without question, questions without label, labelled ids that are gone, groups of the wrong size."""
    row = lambda frame, check, column: frame.select(F.lit(check).alias("check"), F.col(column).cast("string").alias("item"))
    twice = questions.groupBy("question").count().where("count > 1")
    wrong = questions.groupBy("grp").agg(F.count("*").alias("n")).join(sizes, "grp", "full").where("not n <=> size")
    return (
        row(twice, "DUPLICATE", "question")
        .union(row(labels.select("question").distinct().join(questions, "question", "left_anti"), "NO_QUESTION", "question"))
        .union(row(questions.join(labels, "question", "left_anti"), "NO_LABEL", "question"))
        .union(row(labels.join(known, "he_id", "left_anti"), "GONE", "he_id"))
        .union(row(wrong, "GROUP_SIZE", "grp"))
    )


def fragments(rows: DataFrame, separator: str = "<SEP>") -> DataFrame:
    """(entity_id, n_fragments): non-blank parts of joined descriptions."""
    parts = F.filter(F.split("description", F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E"))), lambda x: F.trim(x) != "")
    return rows.select("entity_id", F.size(parts).cast("long").alias("n_fragments"))


def fingerprint(incidence: DataFrame) -> DataFrame:
    """(n, pair_ratio, repeated_ratio, modal_roles): how an extractor fills slots; incidence(he_id, slot, entity_id)."""
    own = incidence.select("he_id", "slot", "entity_id").distinct()
    each = own.groupBy("he_id").agg(F.count_distinct("slot").alias("roles"), (F.count("*") > F.count_distinct("entity_id")).alias("repeated"))
    mode = each.groupBy("roles").agg(F.count("*").alias("c")).agg(F.min_by("roles", F.struct(-F.col("c"), F.col("roles"))).alias("modal_roles"))
    counts = each.agg(F.count("*").alias("n"), ratio(F.count_if(F.col("roles") == 2), F.count("*")).alias("pair_ratio"), ratio(F.count_if("repeated"), F.count("*")).alias("repeated_ratio"))
    return counts.crossJoin(F.broadcast(mode))  # one row each


def token_ratio(measured: DataFrame) -> DataFrame:
    """(model, latest, low, high): out tokens over in tokens; measured(model, day, tokens_in, tokens_out)."""
    r = F.try_divide(F.col("tokens_out").cast("double"), F.col("tokens_in").cast("double"))
    rows = measured.withColumn("r", r)
    return rows.groupBy("model").agg(F.round(F.max_by("r", F.struct("day", "run")), 4).alias("latest"), F.round(F.min("r"), 4).alias("low"), F.round(F.max("r"), 4).alias("high"))
