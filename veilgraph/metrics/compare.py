"""Comparing graph snapshots of several extractors on the documents they share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.metrics.ratios import nary_ratios, ratio, restrict
from veilgraph.model import SLOTS
from veilgraph.sources.held import held


def common(column: str, *frames: DataFrame) -> DataFrame:
    """Distinct values of a column that every frame has."""
    every = reduce(DataFrame.union, [f.select(column).distinct().withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)])
    return every.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") == len(frames)).select(column)


def shared_values(column: str, *frames: DataFrame) -> DataFrame:
    """(column, in_all): the union of distinct values, and whether every frame has them."""
    every = reduce(DataFrame.union, [f.select(column).distinct() for f in frames])
    return every.groupBy(column).agg((F.count("*") == len(frames)).alias("in_all"))


def controlled(snapshots: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(snapshot, part, counts and ratios): each snapshot whole, and cut to the documents all of them have.

    A snapshot is rows(he_id, n_roles, rank) and documents(he_id, doc_no); a hyperedge stays in the common
    part when all its documents do.
    """
    kept = held(common("doc_no", *[docs for _, docs in snapshots.values()]), "common-documents")
    parts = []
    for name, (rows, docs) in snapshots.items():
        own = rows.join(restrict(docs.select("he_id", "doc_no"), kept), "he_id", "left_semi")
        parts += [nary_ratios(part).select(F.lit(name).alias("snapshot"), F.lit(which).alias("part"), "*") for which, part in (("all", rows), ("common", own))]
    return reduce(DataFrame.union, parts)


def fill_rates(incidence: DataFrame) -> DataFrame:
    """(slot, rate): share of hyperedges that fill a role, each role named; incidence(he_id, slot)."""
    own = incidence.select("he_id", "slot").distinct()
    filled = [F.max((F.col("slot") == s).cast("int")).alias(s) for s in SLOTS]
    sums = own.groupBy("he_id").agg(*filled).agg(F.count("*").alias("_n"), *[F.sum(s).alias(s) for s in SLOTS])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), ratio(F.coalesce(s, F.lit(0)), F.col("_n")).alias("rate")) for s in SLOTS]))
    return sums.select(each.alias("x")).select("x.*")


def fill_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """(slot, one, two, difference, over_filled): fill rates side by side; over_filled marks the role with the largest difference two - one."""
    both = fill_rates(one).withColumnRenamed("rate", "one").join(fill_rates(two).withColumnRenamed("rate", "two"), "slot")
    places = F.create_map(*[F.lit(x) for i, s in enumerate(SLOTS) for x in (s, i)])
    apart = both.withColumn("difference", F.round(F.col("two") - F.col("one"), 4))
    most = apart.agg(F.min_by("slot", F.struct(-F.col("difference"), F.element_at(places, F.col("slot")))).alias("over_filled"))
    return apart.join(most, F.col("slot") == F.col("over_filled"), "left").withColumn("over_filled", F.col("over_filled").isNotNull())
