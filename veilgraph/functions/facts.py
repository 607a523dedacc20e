"""N-ary facts: canonical ids, sentences, validation, parsing, alias replacement, explosion to entities."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.functions.text import collapse_py
from veilgraph.model import SLOTS
from veilgraph.sources.held import held

MAX_VALUE = 300
MIN_ROLES = 2
#: Reasons to reject one fact: the item, its cells in order, what it lacks.
CODES = ("NOT_OBJECT", "UNKNOWN_ROLE", "WRONG_TYPE", "EMPTY_VALUE", "TOO_LONG", "NO_SUBJECT", "TOO_FEW_ROLES")

# Role labels of rendered sentences.
LABELS = {"subject": "chủ thể", "symptom": "triệu chứng", "cause": "nguyên nhân", "condition": "điều kiện", "remediation": "cách xử lý", "source": "nguồn", "time": "thời gian", "owner": "người phụ trách"}


def fact_id(prefix: str = "") -> Column:
    """he- and 24 hex digits of the canonical JSON of the slots (null slots left out)."""
    body = F.to_json(F.struct(*[F.col(f"{prefix}{s}").alias(s) for s in SLOTS]))
    return F.concat(F.lit("he-"), F.substring(F.sha2(body, 256), 1, 24))


def sentence() -> Column:
    """label: value parts in role order; empty slots are left out."""
    return F.concat_ws("; ", *[F.when(F.col(s) != "", F.concat(F.lit(f"{LABELS[s]}: "), F.col(s))) for s in SLOTS])


def fact_counts(facts: DataFrame, near: str) -> DataFrame:
    """(he_id, n) of facts whose source fixes the column near: rows of one id hold one source, so what lies by near stays where it is."""
    return facts.select(near, fact_id().alias("he_id")).groupBy(near, "he_id").agg(F.count("*").alias("n")).select("he_id", "n")


def incidence(facts: DataFrame, *keep: str, slots: tuple[str, ...] = SLOTS) -> DataFrame:
    """One row per filled slot: keep columns, slot, entity_id."""
    pairs = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("entity_id")) for s in slots])
    return facts.select(*keep, F.inline(pairs)).where("entity_id is not null").select(*keep, "slot", "entity_id")


_CELL = T.StructType([T.StructField("role", T.StringType()), T.StructField("is_text", T.BooleanType()), T.StructField("value", T.StringType())])
_OPENED = T.StructType([T.StructField("broken", T.StringType()), T.StructField("items", T.ArrayType(T.StructType([T.StructField("is_object", T.BooleanType()), T.StructField("cells", T.ArrayType(_CELL))])))])


def _opened(text: str | None) -> tuple[str | None, list[tuple[bool, list[tuple[str, bool, str]]]]]:
    """What is wrong with a response as a whole, and its items with their cells in order of the text: Spark's own JSON types sort keys."""
    lines = (text or "").strip().split("\n")
    if lines[0].startswith("```"):
        lines = "\n".join(lines[1:]).rsplit("```", 1)[:1]
    try:
        items = json.loads("\n".join(lines))
    except (ValueError, RecursionError):
        return "NOT_JSON", []
    items = items.get("facts") if isinstance(items, dict) else None
    if not isinstance(items, list):
        return "NO_FACTS", []
    cell = lambda role, value: (role, True, collapse_py(value)) if isinstance(value, str) else (role, False, "")
    return None, [(True, [cell(r, v) for r, v in x.items()]) if isinstance(x, dict) else (False, []) for x in items]


@F.pandas_udf(_OPENED)
def _open(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_opened(t) for t in texts], columns=["broken", "items"])


def fact_code(is_object: Column, cells: Column) -> Column:
    """The reason to reject an item, null for none: its first cell with one, then what the item as a whole lacks."""
    of_cell = lambda c: F.coalesce(*[F.when(bad, code) for bad, code in zip((~c["role"].isin(*SLOTS), ~c["is_text"], ~c["value"].rlike("[\\p{L}\\p{N}]"), F.char_length(c["value"]) > MAX_VALUE), CODES[1:5], strict=True)])
    first = F.get(F.array_compact(F.transform(cells, of_cell)), 0)
    has_subject = F.exists(cells, lambda c: c["role"] == SLOTS[0])
    return F.when(~is_object, CODES[0]).otherwise(F.coalesce(first, F.when(~has_subject, CODES[5]), F.when(F.size(cells) < MIN_ROLES, CODES[6])))


def parse_responses(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, code, broken, eight slots): one row a fact, or one row with broken for a broken response."""
    opened = held(rows.select(key, _open(F.col(text)).alias("r")), "opened")  # written, or each filter on it would parse again
    each = opened.where("r.broken is null").select(key, F.posexplode("r.items").alias("pos", "item")).select(key, "pos", fact_code(F.col("item.is_object"), F.col("item.cells")).alias("code"), F.col("item.cells").alias("cells"))
    slot = lambda s: F.when(F.col("code").isNull(), F.get(F.filter("cells", lambda c: c["role"] == s), 0)["value"]).alias(s)
    none = lambda kind: F.lit(None).cast(kind)
    broken = opened.where("r.broken is not null").select(key, none("int").alias("pos"), none("string").alias("code"), F.col("r.broken").alias("broken"), *[none("string").alias(s) for s in SLOTS])
    return each.select(key, "pos", "code", none("string").alias("broken"), *[slot(s) for s in SLOTS]).union(broken)


def reject_counts(rows: DataFrame, text: str) -> DataFrame:
    """(code, broken, n) over parse_responses(): equal responses are counted first and parsed once."""
    each = held(rows.groupBy(F.col(text).alias("text")).agg(F.count("*").alias("n")), "responses").withColumn("key", F.struct("text", "n"))
    return parse_responses(each, "key", "text").groupBy("code", "broken").agg(F.sum("key.n").alias("n"))


def apply_aliases(facts: DataFrame, aliases: DataFrame, slot: str) -> DataFrame:
    """Replace slot values that fully match an alias of their scope, one step; (scope, alias, canonical) is a small dimension."""
    rules = aliases.select(F.col("scope").alias("_scope"), F.col("alias").alias("_alias"), F.col("canonical").alias("_to"))
    hit = (F.col("_scope") == F.col("scope")) & (F.col("_alias") == F.col(slot))
    return facts.join(rules, hit, "left").withColumn(slot, F.coalesce("_to", slot)).drop("_scope", "_alias", "_to")


def keep_first(rows: DataFrame, group: str, pos: str, *key: str) -> DataFrame:
    """The first row of each key in its group, by position; combines before the shuffle."""
    names = [c for c in rows.columns if c not in (group, *key)]
    first = rows.groupBy(group, *key).agg(F.min(F.struct(pos, *[c for c in names if c != pos])).alias("_first"))
    return first.select(group, *key, *[F.col(f"_first.{c}").alias(c) for c in names])


def first_seen(rows: DataFrame, group: str, pos: str, key: str = "he_id") -> DataFrame:
    """Adds seen: 1 for the first row of a fact id in its group, by position; later ones repeat it."""
    from pyspark.sql import Window

    return rows.withColumn("seen", F.row_number().over(Window.partitionBy(group, key).orderBy(pos)))
