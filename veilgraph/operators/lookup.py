"""Point reads and context assembly: reads by id, three-state keys, anchors, grant expansion, narrowing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.grams import GRAM, containing, pieces
from veilgraph.functions.keys import key_state, merged_key
from veilgraph.functions.text import fold
from veilgraph.metrics import documents
from veilgraph.plans.context import Context, secure
from veilgraph.sources.held import held


def get_by_ids(ids: DataFrame, rows: DataFrame, context: Context, namespace: str, *fields: str) -> DataFrame:
    """ids(pos, id) with the named fields; what the context may not read looks missing."""
    seen = secure(rows, context, namespace).select("id", *fields)
    return ids.join(seen, "id", "left").select("pos", "id", *fields)


def keys_by_id(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, filter_key, key_state): ABSENT, NONE and KEY told apart."""
    found = rows.select("id", "filter_key", F.lit(True).alias("_found"))
    return ids.select("id").distinct().join(found, "id", "left").select("id", "filter_key", key_state(F.col("_found"), F.col("filter_key")).alias("key_state"))


def exists(ids: DataFrame, rows: DataFrame, context: Context, namespace: str) -> DataFrame:
    """(id, found): distinct ids; what the context may not read is not there."""
    seen = secure(rows, context, namespace).select("id", F.lit(True).alias("_found")).distinct()
    return ids.select("id").distinct().join(seen, "id", "left").select("id", F.col("_found").isNotNull().alias("found"))


def id_collisions(rows: DataFrame) -> DataFrame:
    """(point_id, n): points that several ids map to; rows(id, point_id)."""
    return rows.groupBy("point_id").agg(F.count_distinct("id").alias("n")).where("n > 1")


def needs_write(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids that are new, or whose merged key would differ from the stored one."""
    merged = stored.select("id", "filter_key").union(incoming.select("id", "filter_key")).join(incoming.select("id").distinct(), "id", "left_semi").groupBy("id").agg(merged_key(F.col("filter_key")).alias("now"))
    return merged.join(stored.select("id", "filter_key", F.lit(True).alias("_old")), "id", "left").where("_old is null or not (now <=> filter_key)").select("id", F.col("now").alias("filter_key"))


def by_anchor(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """(anchor_id, he_id): facts whose subject equals the anchor; only where there is none, those that contain it.

    anchors(anchor_id, anchor), facts(he_id, subject).  Containment is an equi-join: an anchor is found
    at the places where a subject's GRAM characters equal the anchor's first ones, then compared whole;
    subjects are taken once each, however many facts have them.  Anchors shorter than GRAM characters
    are joined on pieces of their own length.
    """
    exact = anchors.join(facts, F.col("anchor") == F.col("subject")).select("anchor_id", "he_id")
    rest = anchors.where("length(anchor) > 0").join(exact.select("anchor_id").distinct(), "anchor_id", "left_anti")
    lead = rest.withColumn("size", F.least(F.char_length("anchor"), F.lit(GRAM))).withColumn("piece", F.substring("anchor", 1, GRAM))
    sizes = F.array(*[F.lit(k) for k in range(1, GRAM + 1)])
    subjects = facts.where("length(subject) > 0").select("subject").distinct()
    cut = subjects.select("subject", F.explode(sizes).alias("size")).where(F.col("size") <= F.char_length("subject"))
    placed = cut.select("subject", "size", F.explode(F.sequence(F.lit(1), F.char_length("subject") - F.col("size") + 1)).alias("at"))
    pieces = placed.select("subject", "size", F.col("subject").substr(F.col("at"), F.col("size")).alias("piece")).distinct()
    found = pieces.join(lead, ["size", "piece"]).where(F.col("subject").contains(F.col("anchor"))).select("anchor_id", "subject").distinct()
    return exact.union(found.join(facts, "subject").select("anchor_id", "he_id")).distinct()


def anchor_links(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """Every link of by_anchor(), equal texts taken together: (kind, anchor_id, anchor, subject, he_id, tier, n, first_he).

    pair rows link a distinct anchor text to a distinct subject; anchor rows give each linked anchor's text with how many facts
    it finds and the smallest; fact rows give each linked fact's subject.  An anchor finds a fact where a pair links their texts.
    """
    of = facts.where("length(subject) > 0").select("he_id", "subject").distinct()
    subjects = of.groupBy("subject").agg(F.count("*").alias("n"), F.min("he_id").alias("first_he"))
    texts = anchors.select(F.col("anchor").alias("anchor_id"), "anchor").distinct()
    found = by_anchor(texts, subjects.select(F.col("subject").alias("he_id"), "subject"))
    tier = F.when(F.col("anchor_id") == F.col("he_id"), "equal").otherwise("contains")
    pairs = held(found.select(F.col("anchor_id").alias("anchor"), F.col("he_id").alias("subject"), tier.alias("tier")), "anchor-pairs")
    sums = pairs.join(subjects, "subject").groupBy("anchor", "tier").agg(F.sum("n").alias("n"), F.min("first_he").alias("first_he"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    kind = anchors.schema["anchor_id"].dataType
    each = anchors.join(sums, "anchor").select(F.lit("anchor").alias("kind"), "anchor_id", "anchor", *none("string", "subject", "he_id"), "tier", "n", "first_he")
    links = pairs.select(F.lit("pair"), *none(kind, "anchor_id"), "anchor", "subject", *none("string", "he_id"), "tier", *none("long", "n"), *none("string", "first_he"))
    held_by = of.join(pairs.select("subject").distinct(), "subject", "left_semi")
    members = held_by.select(F.lit("fact"), *none(kind, "anchor_id"), *none("string", "anchor"), "subject", "he_id", *none("string", "tier"), *none("long", "n"), *none("string", "first_he"))
    return each.union(links).union(members)


def _labels_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    doc, side, first, second = (batch.column(i).to_pylist() for i in range(4))
    anchor, beside = documents.folded(batch.column(4), ""), documents.folded(batch.column(5), "")
    others = batch.column(6)
    texts = documents.folded(others.flatten(), "")
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(others), 0)).to_pylist()
    each = (texts[a:b] for a, b in zip([0, *ends], ends, strict=False))
    return ((d, s, x) for d, s, *x in zip(doc, side, first, second, anchor, beside, each, strict=True))


def _pointed(labels: list[tuple], facts: list[tuple]) -> Iterator[tuple]:
    """(label_id, he_id, n, least, equal) of the labels of one document."""
    subjects = [(he, subject) for he, _, subject, _, _ in facts if subject is not None]
    texts = subjects + [(he, text) for he, *_, others in facts for text in others]
    for label, own, anchor, second, _ in labels:
        near: dict[str, bool] = {}
        for he, text in subjects:
            if anchor and anchor in text:
                near[he] = near.get(he, False) or text == anchor
        equal = any(near.values())
        kept = {he for he, same in near.items() if same or not equal}
        if second is not None and kept:
            kept &= {he for he, text in texts if second and second in text}
        yield label, own, len(kept), min((he for he in kept if he is not None), default=None), equal


_POINTED = pa.schema([("doc_key", pa.string()), ("label_id", pa.string()), ("he_id", pa.string()), ("n", pa.int64()), ("least", pa.string()), ("equal", pa.bool_())])


def resolve_labels(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(label_id, tier, n, he_id, found, status): the facts that each label's anchors point to within its document.

    labels(label_id, he_id, doc_key, anchor, second), a label_id once; values(he_id, doc_key, slot, value) or, a row a fact,
    values(he_id, doc_key, subject, others).  A null second anchor narrows nothing, an empty one leaves nothing.  Texts are
    compared folded.  Facts whose subject equals the anchor come first (tier equal); only where there are none, those that
    contain it; of these stay those with the second anchor in any slot.  Documents are resolved one by one inside the tasks,
    after one shuffle; those of more than `documents.GROUP` rows by a gram index.

    status: OK; AMBIGUOUS (several facts); DRIFTED (one other fact, the id is gone), MOVED (one other fact,
    the id is there); STALE (none, but the id is there); LOST (none, and the id is gone).  found is the only fact.
    """
    if "others" not in values.columns:
        is_subject = F.col("slot") == "subject"
        one = F.when(is_subject | F.col("value").isNull(), F.array().cast("array<string>")).otherwise(F.array("value"))
        values = values.select("he_id", "doc_key", F.when(is_subject, F.col("value")).alias("subject"), one.alias("others"))
    kind = labels.schema["label_id"].dataType
    labels = labels.select("doc_key", F.col("label_id").cast("string").alias("label_id"), "he_id", "anchor", "second")
    large = documents.large_documents(labels, values)
    facts, asked, rest = values, labels, None
    if not large.isEmpty():
        rest = _resolved_by_grams(labels.join(large, "doc_key", "left_semi"), values.join(large, "doc_key", "left_semi"))
        facts, asked = values.join(large, "doc_key", "left_anti"), labels.join(large, "doc_key", "left_anti")
    none = F.array().cast("array<string>")
    rows = asked.select("doc_key", F.lit(0).alias("side"), "label_id", "he_id", "anchor", "second", none.alias("others"))
    rows = rows.union(facts.select("doc_key", F.lit(1), "he_id", F.lit(None), "subject", F.lit(None), "others"))
    out = rows.repartition("doc_key").sortWithinPartitions("doc_key").mapInArrow(documents.stream(_labels_of, _pointed, _POINTED), "doc_key string, label_id string, he_id string, n long, least string, equal boolean")
    out = out.drop("doc_key") if rest is None else out.drop("doc_key").union(rest)
    there = values.where("subject is not null or size(others) > 0").select(F.col("he_id").alias("there")).distinct()
    out = out.join(there, F.col("he_id") == F.col("there"), "left")
    n, known = F.col("n"), F.col("there").isNotNull()
    status = F.when(n > 1, "AMBIGUOUS").when((n == 0) & known, "STALE").when(n == 0, "LOST").when(F.col("least") == F.col("he_id"), "OK").when(known, "MOVED").otherwise("DRIFTED")
    tier = F.when(n == 0, "none").when(F.col("equal"), "equal").otherwise("contains")
    return out.select(F.col("label_id").cast(kind).alias("label_id"), tier.alias("tier"), n.alias("n"), "he_id", F.when(n == 1, F.col("least")).alias("found"), status.alias("status"))


def _resolved_by_grams(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(label_id, he_id, n, least, equal) of large documents: a gram index over all values of a document serves both anchors, each
    looked up by its gram with the shortest list, then compared whole."""
    cells = F.concat(F.array(F.struct(F.lit("subject").alias("slot"), F.col("subject").alias("value"))), F.transform("others", lambda x: F.struct(F.lit("other").alias("slot"), x.alias("value"))))
    values = values.select("he_id", "doc_key", F.explode(cells).alias("x")).select("he_id", "doc_key", "x.*").where("value is not null")
    folded = held(values.select("value").distinct().select("value", fold("value").alias("text")), "folded")
    index = held(values.join(folded, "value").select("doc_key", "he_id", "slot", "text").distinct(), "label-values")
    asked = held(labels.select("label_id", "he_id", "doc_key", fold("anchor").alias("anchor"), fold("second").alias("second")), "labels")
    texts = index.select("doc_key", "text").distinct()
    grams = held(pieces(texts, "text", "doc_key", "text"), "label-grams")

    def holding(which: str) -> DataFrame:
        """(label_id, text): values of the label's document that contain an anchor."""
        found = containing(asked.select("doc_key", F.col(which).alias("needle")), grams, texts, "doc_key")
        return asked.select("label_id", "doc_key", F.col(which).alias("needle")).join(found, ["doc_key", "needle"]).select("label_id", "text")

    first = holding("anchor").join(asked.select("label_id", "doc_key", "anchor", "second"), "label_id").join(index.where("slot = 'subject'"), ["doc_key", "text"])
    tiered = first.select("label_id", "second", "he_id", (F.col("text") == F.col("anchor")).alias("equal")).groupBy("label_id", "second", "he_id").agg(F.max("equal").alias("equal"))
    best = tiered.groupBy("label_id").agg(F.max("equal").alias("any_equal"))
    near = held(tiered.join(best, "label_id").where("equal or not any_equal").select("label_id", "second", "he_id", "equal"), "label-candidates")
    beside = holding("second").join(asked.select("label_id", "doc_key"), "label_id").join(index, ["doc_key", "text"]).select("label_id", "he_id").distinct()
    kept = near.where("second is null").unionByName(near.where("second is not null").join(beside, ["label_id", "he_id"], "left_semi").select(*near.columns))
    counted = kept.groupBy("label_id").agg(F.count("*").alias("n"), F.min("he_id").alias("least"), F.first("equal").alias("equal"))
    return asked.join(counted, "label_id", "left").select("label_id", "he_id", F.coalesce("n", F.lit(0)).alias("n"), "least", "equal")


def expand_by_grants(context_rows: DataFrame, granted: DataFrame) -> DataFrame:
    """Granted rows replace their masked twins and the rest follow; rank starts anew per request. Both: (request, he_id, text, rank)."""
    kept = context_rows.join(granted.select("request", "he_id"), ["request", "he_id"], "left_anti").withColumn("_side", F.lit(0))
    every = kept.unionByName(granted.withColumn("_side", F.lit(1)))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("_side", "rank", "he_id"))).drop("_side")


def narrow(citations: DataFrame, declared: DataFrame, granted: DataFrame) -> DataFrame:
    """Citations the answer declares or that were granted; a request that declares none of its own keeps all. All by (request, he_id)."""
    wanted = declared.select("request", "he_id").union(granted.select("request", "he_id")).distinct()
    hit = citations.join(wanted, ["request", "he_id"], "left_semi")
    bare = citations.join(hit.select("request").distinct(), "request", "left_anti")
    return hit.unionByName(bare)


def context_csv(rows: DataFrame, *columns: str) -> DataFrame:
    """(request, block): one CSV line a row in order of rank; a request's rows are bounded by its token budget."""
    line = F.to_csv(F.struct(*columns), {"escape": '"'})
    return rows.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))
