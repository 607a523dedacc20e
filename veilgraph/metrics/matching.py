"""Greedy one-to-one matching of predicted to gold facts within a document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.facts import incidence
from veilgraph.metrics import documents
from veilgraph.sources.held import held


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs sorted by document and then in the order of matching: each is taken if both of its facts are still free."""
    document, left, right = object(), set(), set()
    for batch in batches:
        taken = []
        for place, (doc, gold, pred) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
            if doc != document:
                document, left, right = doc, set(), set()
            if gold not in left and pred not in right:
                left.add(gold)
                right.add(pred)
                taken.append(place)
        yield batch.take(pa.array(taken, pa.int64()))


#: Pairs of a document that one task may take; larger documents are cut down by rounds first.
GROUP = 10_000

_PAIR = ("doc_key", "gold_id", "pred_id", "score")


def _dominant(rows: DataFrame, ties: tuple[str, str]) -> DataFrame:
    """Pairs that are the first of both their facts: under a total order, greedy matching takes them whatever else it takes."""
    ranked = rows.withColumn("_key", F.struct((-F.col("score")).alias("s"), *ties))
    first = {side: ranked.groupBy("doc_key", side).agg(F.min("_key").alias(f"_{side}")) for side in ("gold_id", "pred_id")}
    both = ranked.join(first["gold_id"], ["doc_key", "gold_id"]).join(first["pred_id"], ["doc_key", "pred_id"])
    return both.where((F.col("_key") == F.col("_gold_id")) & (F.col("_key") == F.col("_pred_id"))).select(*_PAIR)


def greedy_match(candidates: DataFrame, ties: tuple[str, str] = ("gold_id", "pred_id")) -> DataFrame:
    """candidates(doc_key, gold_id, pred_id, score), each pair once, taken by falling score, then by the ids in the order of `ties`.

    A document of up to GROUP pairs is matched in one task, which reads its documents one after the other.  Of larger ones the pairs that are first for both of
    their facts are taken, what competes with them goes, and so on until GROUP are left.
    """
    rows = candidates.select(*_PAIR)
    sized = rows.join(rows.groupBy("doc_key").agg(F.count("*").alias("_n")), "doc_key")
    small, big = sized.where(F.col("_n") <= GROUP).drop("_n"), held(sized.where(F.col("_n") > GROUP).drop("_n"), "large-documents")
    taken = []
    while not big.isEmpty():
        won = held(_dominant(big, ties), "matched")
        taken.append(won)
        left = held(big.join(won.select("doc_key", "gold_id"), ["doc_key", "gold_id"], "left_anti").join(won.select("doc_key", "pred_id"), ["doc_key", "pred_id"], "left_anti").select(*_PAIR), "unmatched")
        sized = left.join(left.groupBy("doc_key").agg(F.count("*").alias("_n")), "doc_key")
        small, big = small.union(sized.where(F.col("_n") <= GROUP).select(*_PAIR)), sized.where(F.col("_n") > GROUP).select(*_PAIR)
    out = small.select(*_PAIR).repartition("doc_key").sortWithinPartitions("doc_key", F.desc("score"), *ties).mapInArrow(_greedy, rows.schema)
    for won in taken:
        out = out.union(won)
    return out


def match_by_values(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_key, gold_id, pred_id, score): facts of a document matched greedily by how many values they share in the same role.

    gold and pred are (doc_key, fact_id, one column a slot), a fact_id once in a document; values are compared as they are.
    Documents are matched one by one inside the tasks, those of more than `documents.GROUP` facts by a join.
    """
    return documents.by_document(gold, pred, documents.by_shared_values, "gold_id string, pred_id string, score double", _match_joined, documents.plain_facts)


def _match_joined(gold: DataFrame, pred: DataFrame) -> DataFrame:
    side = lambda rows, name: incidence(rows, "doc_key", "fact_id").withColumnRenamed("fact_id", name)
    pairs = side(gold, "gold_id").join(side(pred, "pred_id"), ["doc_key", "slot", "entity_id"]).groupBy("doc_key", "gold_id", "pred_id").agg(F.count("*").cast("double").alias("score"))
    return greedy_match(pairs)
