"""Scoring of extracted facts against a gold set: fact pairs by subject, slots in passes, document level, ledgers.

gold and pred are (doc_key, fact_id, one column a slot), a fact_id once in a document on each side (see
`facts.first_seen`).  Values are compared folded; a null or blank value is no slot.  Two values agree
exactly when equal, loosely when one contains the other.

Documents are scored one by one inside the tasks (`documents`), after one shuffle; those of more than `documents.GROUP`
facts by the joins written here, which give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.grams import containing, pieces
from veilgraph.functions.text import fold
from veilgraph.metrics import documents
from veilgraph.metrics.documents import EXTRA, MISSING, by_document
from veilgraph.metrics.matching import greedy_match
from veilgraph.metrics.ratios import ratio
from veilgraph.model import SLOTS
from veilgraph.sources.held import held

_PLACE = {s: i for i, s in enumerate(SLOTS)}
_CELL = "gold_role string, pred_role string, kind string"
_SLOT = "array<struct<role:string,value:string>>"
_HIT = "array<struct<gold_role:string,pred_role:string,kind:string>>"


def agree(a: Column, b: Column) -> Column:
    """exact, loose, or null."""
    return F.when(a == b, "exact").when(a.contains(b) | b.contains(a), "loose")


def folded(facts: DataFrame) -> DataFrame:
    return facts.select("doc_key", "fact_id", *[F.nullif(fold(s), F.lit("")).alias(s) for s in SLOTS])


def subject_candidates(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_key, gold_id, pred_id, gold, pred): facts of one document whose subjects agree; folded input.

    Subjects are compared once each in a document, however many facts have them.
    """
    side = lambda frame, name: frame.select("doc_key", F.col("subject").alias(f"{name}_subject"), F.col("fact_id").alias(f"{name}_id"), F.struct(*SLOTS).alias(name)).where(f"{name}_subject is not null")
    g, p = side(gold, "gold"), side(pred, "pred")
    golds, preds = (held(f.select("doc_key", F.col(c).alias("text")).distinct(), "subjects") for f, c in ((g, "gold_subject"), (p, "pred_subject")))
    # subjects of one document meet if one contains the other: looked up by their rarest piece, not pair by pair
    within = lambda needles, texts: containing(needles.withColumnRenamed("text", "needle"), pieces(texts, "text", "doc_key", "text"), texts, "doc_key")
    near = within(golds, preds).select("doc_key", F.col("needle").alias("gold_subject"), F.col("text").alias("pred_subject"))
    near = near.union(within(preds, golds).select("doc_key", F.col("text").alias("gold_subject"), F.col("needle").alias("pred_subject"))).distinct()
    return near.join(g, ["doc_key", "gold_subject"]).join(p, ["doc_key", "pred_subject"]).select("doc_key", "gold_id", "pred_id", "gold", "pred")


def slot_matches(rows: DataFrame) -> DataFrame:
    """Adds hits, the slots of gold and pred matched one to one: same role exactly, same role loosely, across roles exactly, then loosely.

    gold and pred are structs of folded slots.  Same-role passes can't compete, as a fact has a role once;
    across roles each gold slot in role order takes the first slot still free.
    """
    pairs = F.array(*[F.struct(F.lit(s).alias("role"), F.col(f"gold.{s}").alias("gold"), F.col(f"pred.{s}").alias("pred"), agree(F.col(f"gold.{s}"), F.col(f"pred.{s}")).alias("kind")) for s in SLOTS])
    same = F.transform(F.filter("_pairs", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["role"].alias("gold_role"), x["role"].alias("pred_role"), x["kind"].alias("kind")))
    free = lambda side: F.transform(F.filter("_pairs", lambda x: x["kind"].isNull() & x[side].isNotNull()), lambda x: F.struct(x["role"].alias("role"), x[side].alias("value")))
    first = F.struct(free("gold").alias("golds"), free("pred").alias("preds"), same.cast(_HIT).alias("hits"))
    steps = rows.withColumn("_pairs", pairs).withColumn("_free", first).withColumn("_free", _across(F.col("_free"), "exact")).withColumn("_free", _across(F.col("_free"), "loose"))
    return steps.withColumn("hits", F.col("_free.hits")).drop("_pairs", "_free")


def _across(state: Column, kind: str) -> Column:
    """State (golds, preds, hits) after one pass across roles."""
    start = F.struct(F.array().cast(_SLOT).alias("golds"), state["preds"].alias("preds"), state["hits"].alias("hits"))

    def step(s: Column, g: Column) -> Column:
        fits = F.slice(F.filter(s["preds"], lambda p: agree(g["value"], p["value"]) == kind), 1, 1)
        rows = F.transform(fits, lambda p: F.struct(g["role"].alias("gold_role"), p["role"].alias("pred_role"), F.lit(kind).alias("kind")))
        left = F.filter(F.array(g), lambda _: F.size(fits) == 0)
        return F.struct(F.concat(s["golds"], left).alias("golds"), F.array_except(s["preds"], fits).alias("preds"), F.concat(s["hits"], rows).alias("hits"))

    return F.aggregate(state["golds"], start, step)


def scored_candidates(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_key, gold_id, pred_id, n_same, n_any): slots matched in their own role, and in any."""
    fields = "gold_id string, pred_id string, n_same long, n_any long"
    return by_document(gold, pred, documents.scored_candidates, fields, lambda g, p: _scored(folded(g), folded(p)))


def same_role_candidates(facts: DataFrame, by: str) -> DataFrame:
    """(by, gold_id, pred_id, n_same): `scored_candidates` without slots matched across roles, of rows that lie sorted by document.

    facts is by, then fact_id and slots of a gold fact, then of a pred fact, in columns of any names; a side may be null.  Nothing
    is shuffled; documents are held whole, so those of more than `documents.GROUP` facts are not for it.
    """
    kind = facts.schema[by].dataType.simpleString()
    return facts.where(F.col(by).isNotNull()).mapInArrow(documents.same_roles, f"{by} {kind}, gold_id string, pred_id string, n_same long")


def _scored(gold: DataFrame, pred: DataFrame) -> DataFrame:
    own = F.size(F.filter("hits", lambda x: x["gold_role"] == x["pred_role"]))
    each = slot_matches(subject_candidates(gold, pred))
    return each.select("doc_key", "gold_id", "pred_id", own.cast("long").alias("n_same"), F.size("hits").cast("long").alias("n_any"))


def paired(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_key, gold_id, pred_id): pairs taken one to one by slots in role, then slots in any, then ids of pred and gold."""
    return _paired(folded(gold), folded(pred))


def _paired(gold: DataFrame, pred: DataFrame) -> DataFrame:
    scored = held(_scored(gold, pred), "candidates").withColumn("score", (F.col("n_same") * 16 + F.col("n_any")).cast("double"))
    return greedy_match(scored.select("doc_key", "gold_id", "pred_id", "score"), ("pred_id", "gold_id")).drop("score")


def _slots(facts: DataFrame, name: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(s).alias("role"), F.col(s).alias("value")) for s in SLOTS])
    rows = facts.select("doc_key", "fact_id", F.explode(F.filter(cells, lambda x: x["value"].isNotNull())).alias("x"))
    return rows.select("doc_key", F.col("fact_id").alias(f"{name}_id"), F.col("x.role").alias(f"{name}_role"), F.col("x.value").alias("value"))


def pair_level(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_key, gold_role, pred_role, kind): every slot once; slots of facts without a partner are missing or extra."""
    return by_document(gold, pred, documents.pair_level, _CELL, _pair_level)


def _pair_level(gold: DataFrame, pred: DataFrame) -> DataFrame:
    g, p = held(folded(gold), "gold"), held(folded(pred), "pred")
    pairs = held(_paired(g, p), "pairs")
    both = pairs.join(g.select("doc_key", F.col("fact_id").alias("gold_id"), F.struct(*SLOTS).alias("gold")), ["doc_key", "gold_id"])
    both = both.join(p.select("doc_key", F.col("fact_id").alias("pred_id"), F.struct(*SLOTS).alias("pred")), ["doc_key", "pred_id"])
    hits = slot_matches(both).select("doc_key", "gold_id", "pred_id", F.explode("hits").alias("x")).select("doc_key", "gold_id", "pred_id", "x.*")
    lost = _slots(g, "gold").join(hits, ["doc_key", "gold_id", "gold_role"], "left_anti")
    more = _slots(p, "pred").join(hits, ["doc_key", "pred_id", "pred_role"], "left_anti")
    return (
        hits.select("doc_key", "gold_role", "pred_role", "kind")
        .union(lost.select("doc_key", "gold_role", F.lit(MISSING), F.lit(MISSING)))
        .union(more.select("doc_key", F.lit(EXTRA), "pred_role", F.lit(EXTRA)))
    )


def document_level(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_key, gold_role, pred_role, kind): a gold value counts if any fact of its document has it in its role.

    Values of one role are matched one to one, exactly and then loosely (kind exact or loose).  A gold slot
    left over looks for its value in other roles, also among values already used (kind confused); if there
    is none it is repeated (an equal value of its role is used), used (one that contains it is) or missing.
    Slots of pred that nothing points at are extra.
    """
    return by_document(gold, pred, documents.document_level, _CELL, _document_level)


def _document_level(gold: DataFrame, pred: DataFrame) -> DataFrame:
    g = held(_slots(folded(gold), "gold").withColumnRenamed("gold_role", "role"), "gold")
    p = held(_slots(folded(pred), "pred").withColumnRenamed("pred_role", "role"), "pred")
    nth = lambda name: F.row_number().over(Window.partitionBy("doc_key", "role", "value").orderBy(f"{name}_id"))
    same = g.withColumn("n", nth("gold")).join(p.withColumn("n", nth("pred")), ["doc_key", "role", "value", "n"])
    exact = held(same.select("doc_key", "role", "gold_id", "pred_id", F.lit("exact").alias("kind")), "exact")
    g_left, p_left = g.join(exact, ["doc_key", "role", "gold_id"], "left_anti"), p.join(exact, ["doc_key", "role", "pred_id"], "left_anti")
    near = g_left.withColumnRenamed("value", "gv").join(p_left.withColumnRenamed("value", "pv"), ["doc_key", "role"]).where(agree(F.col("gv"), F.col("pv")) == "loose")
    taken = greedy_match(near.select(F.struct("doc_key", "role").alias("doc_key"), "gold_id", "pred_id", F.lit(1.0).alias("score")), ("gold_id", "pred_id"))
    loose = held(taken.select("doc_key.doc_key", "doc_key.role", "gold_id", "pred_id", F.lit("loose").alias("kind")), "loose")
    hits = exact.union(loose)
    lost = g_left.join(loose, ["doc_key", "role", "gold_id"], "left_anti")
    values = p.groupBy("doc_key", F.col("role").alias("other"), F.col("value").alias("pv")).agg(F.min("pred_id").alias("pred_id"))
    kind = agree(F.col("value"), F.col("pv"))
    order = F.element_at(F.create_map(*[F.lit(x) for pair in _PLACE.items() for x in pair]), F.col("other"))
    blame = lost.join(values, "doc_key", "left").withColumn("kind", kind).groupBy("doc_key", "role", "gold_id").agg(
        F.min(F.when(F.col("kind").isNotNull() & (F.col("other") != F.col("role")), F.struct("kind", order.alias("place"), "pred_id", "other"))).alias("far"),
        F.min(F.when(F.col("other") == F.col("role"), F.col("kind"))).alias("near"),
    )
    fate = F.when(F.col("far").isNotNull(), "confused").when(F.col("near") == "exact", "repeated").when(F.col("near") == "loose", "used").otherwise(MISSING)
    told = blame.select("doc_key", "role", F.coalesce("far.other", F.lit(MISSING)).alias("pred_role"), fate.alias("kind"))
    blamed = blame.where("far is not null").select("doc_key", F.col("far.other").alias("role"), "far.pred_id")
    more = p_left.join(loose, ["doc_key", "role", "pred_id"], "left_anti").join(blamed, ["doc_key", "role", "pred_id"], "left_anti")
    return (
        hits.select("doc_key", F.col("role").alias("gold_role"), F.col("role").alias("pred_role"), "kind")
        .union(told.select("doc_key", "role", "pred_role", "kind"))
        .union(more.select("doc_key", F.lit(EXTRA), "role", F.lit(EXTRA)))
    )


def cells(rows: DataFrame) -> DataFrame:
    """(gold_role, pred_role, kind, n): the whole matrix in long form, at most a few hundred rows."""
    return rows.groupBy("gold_role", "pred_role", "kind").agg(F.count("*").alias("n"))


def top_confusions(matrix: DataFrame, keep: int) -> DataFrame:
    """(gold_role, pred_role, n): the `keep` pairs of roles most often taken for one another; a report."""
    mixed = matrix.where((F.col("gold_role") != F.col("pred_role")) & F.col("gold_role").isin(*SLOTS) & F.col("pred_role").isin(*SLOTS))
    places = F.create_map(*[F.lit(x) for pair in _PLACE.items() for x in pair])
    sums = mixed.groupBy("gold_role", "pred_role").agg(F.sum("n").alias("n"))
    return sums.orderBy(F.desc("n"), F.element_at(places, F.col("gold_role")), F.element_at(places, F.col("pred_role"))).limit(keep)


def ledger(matrix: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(role, n_gold, n_pred, exact, loose, and precision, recall and f1 of exact and of all matches); ratios are null over nothing.

    One row a role, `all`, and `no_subject`, the sum of the other seven.  Counters add up, so ledgers of
    parts of a corpus may be summed before the ratios are taken.
    """
    count = lambda frame, name: _slots(folded(frame), name).groupBy(F.col(f"{name}_role").alias("role")).agg(F.count("*").alias(f"n_{name}"))
    hit = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)
    hits = matrix.where("gold_role = pred_role").groupBy(F.col("gold_role").alias("role")).agg(hit("exact"), hit("loose"))
    names = gold.sparkSession.createDataFrame([(s,) for s in SLOTS], "role string")
    each = names.join(count(gold, "gold"), "role", "left").join(count(pred, "pred"), "role", "left").join(hits, "role", "left").na.fill(0)
    groups = F.when(F.col("role") == "subject", F.array("role", F.lit("all"))).otherwise(F.array("role", F.lit("all"), F.lit("no_subject")))
    counters = ("n_gold", "n_pred", "exact", "loose")
    total = each.withColumn("role", F.explode(groups)).groupBy("role").agg(*[F.sum(c).alias(c) for c in counters])
    for name, hits in (("strict", F.col("exact")), ("lenient", F.col("exact") + F.col("loose"))):
        total = total.withColumns({
            f"{name}_precision": ratio(hits, F.col("n_pred")), f"{name}_recall": ratio(hits, F.col("n_gold")), f"{name}_f1": ratio(2 * hits, F.col("n_gold") + F.col("n_pred")),
        })
    return total
