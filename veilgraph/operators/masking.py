"""Masking projections: after the joins that need real ids, before anything a user sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.keys import key_type
from veilgraph.model import GROUPS, OWNER, SLOTS
from veilgraph.plans.context import Context, readable


def marker(name: str, reason: str) -> str:
    return f"[{name}:{reason}]"


SLOT_MARKS = {s: marker(s, "group" if s == OWNER else "masked") for s in SLOTS}
NO_KEY_MARK = marker("neighbor_id", "no_key")
DESCRIPTION_MARK = marker("description", "l2_only")


def owner_mark(group: str | None) -> str:
    """The owner's marker, with the group's name where it is known."""
    if group is None:
        return SLOT_MARKS[OWNER]
    if not group or group != group.strip() or set(group) & set("[]:"):
        raise ValueError(f"group name {group!r} can't be a marker")
    return marker(OWNER, group)


def _table(pairs: dict[str, object]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v))])


def owner_of(ctype: Column) -> Column:
    named = F.element_at(_table({t: owner_mark(g) for t, g in GROUPS.items()}), ctype)
    return F.coalesce(named, F.lit(SLOT_MARKS[OWNER]))


def masked_slots(context: Context, key: Column, he_id: Column | None = None) -> Column:
    """Slots to mask on a hyperedge: policy's and owner; a granted one masks owner only."""
    own = F.lit(None).cast("array<string>")
    if context.masks:
        own = F.element_at(_table({t: tuple(m) for t, m in context.masks.items()}), key_type(key))
    every = F.array_union(F.coalesce(own, F.array().cast("array<string>")), F.array(F.lit(OWNER)))
    return every if he_id is None or not context.grants else F.when(he_id.isin(sorted(context.grants)), F.array(F.lit(OWNER))).otherwise(every)


def effective_level(context: Context, key: Column, he_id: Column | None = None) -> Column:
    """L2 where the key also shows in a namespace of that level or the hyperedge is granted, else L1; null outside permission."""
    full = readable(context, "chunks", key)
    if he_id is not None and context.grants:
        full = full | he_id.isin(sorted(context.grants))
    return F.when(readable(context, "hyperedges", key), F.when(full, "L2").otherwise("L1"))


def mask_facts(rows: DataFrame, context: Context, he_id: str = "he_id", key: str = "filter_key") -> DataFrame:
    """Slot values replaced by markers, columns kept; owner always carries its group's marker."""
    if context.system:
        return rows
    hidden = masked_slots(context, F.col(key), F.col(he_id))
    cells = {s: F.when(F.col(s).isNotNull() & F.array_contains("_hidden", s), SLOT_MARKS[s]).otherwise(F.col(s)) for s in SLOTS[:-1]}
    return rows.withColumn("_hidden", hidden).withColumns(cells | {OWNER: owner_of(key_type(F.col(key)))}).drop("_hidden")


def mask_edges(rows: DataFrame, context: Context, he_key: str = "filter_key", entity_key: str = "entity_key") -> DataFrame:
    """Neighbour names of incidence rows (he_id, slot, entity_id): no-key neighbours are masked whatever the slot."""
    if context.system:
        return rows
    hidden = F.array_contains(masked_slots(context, F.col(he_key), F.col("he_id")), F.col("slot"))
    name = F.when(F.col("slot") == OWNER, owner_of(key_type(F.col(he_key)))).otherwise(F.element_at(_table(SLOT_MARKS), F.col("slot")))
    return rows.withColumn("neighbor", F.when(F.col(entity_key).isNull(), NO_KEY_MARK).when(hidden, name).otherwise(F.col("entity_id")))


def mask_roles(roles: Column, hidden: Column) -> Column:
    """Merged edges lose masked roles, so that nothing can be counted."""
    return F.array_except(roles, hidden)


def mask_description(context: Context, key: Column, text: Column) -> Column:
    return F.when(readable(context, "entities", key), text).otherwise(DESCRIPTION_MARK)


def masked_nodes(ids: DataFrame) -> DataFrame:
    """(id, name, description): what a lookup of marker ids shows, a node made up of markers; other ids give no row."""
    return ids.where(is_marker(F.col("id"))).select("id", F.col("id").alias("name"), F.lit(DESCRIPTION_MARK).alias("description"))


def check_masked(before: DataFrame, after: DataFrame) -> DataFrame:
    """after, if masking dropped no column and changed no type; the plan is enough to know."""
    kinds = lambda frame: {f.name: f.dataType for f in frame.schema}
    lost = [name for name, kind in kinds(before).items() if kinds(after).get(name) != kind]
    if lost:
        raise ValueError(f"masking lost {lost}")
    return after


def is_marker(value: Column) -> Column:
    """Whether a value is one of the markers masking can make."""
    known = sorted({*SLOT_MARKS.values(), NO_KEY_MARK, DESCRIPTION_MARK, *map(owner_mark, set(GROUPS.values()))})
    return value.isin(known)
