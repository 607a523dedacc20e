"""Permission contexts: frozen, passed explicitly to every operator, never kept in a session."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilgraph.model import NAMESPACE_LEVEL, OWNER
from veilgraph.plans.policy import KEY_CEILING, Policy

#: Levels that a row left out may have.
DROPPED = ("L0", "L1")


class NoContext(PermissionError):
    """A read without a context."""


@dataclass(frozen=True)
class Context:
    """What one request may see: keys per namespace, masked slots per type, granted hyperedges."""

    space: str
    role: str | None
    keys: dict[str, frozenset[str]] = field(default_factory=dict)
    masks: dict[str, tuple[str, ...]] = field(default_factory=dict)
    grants: frozenset[str] = frozenset()
    system: bool = False
    as_of: datetime | None = None
    policy_version: str = ""

    def slots_to_mask(self, ctype: str) -> tuple[str, ...]:
        return (*self.masks.get(ctype, ()), OWNER)


def user_context(policy: Policy, role: str, space: str, grants: frozenset[str] = frozenset(), as_of: datetime | None = None) -> Context:
    if role not in policy.roles:
        raise PermissionError(f"unknown role {role}")
    own = policy.roles[role]
    keys = {n: frozenset(f"{s}:{t}" for s in own.scopes for t in own.disclosure if own.level(t) >= least) for n, least in NAMESPACE_LEVEL.items()}
    return Context(space, role, keys, dict(own.masks), grants, False, as_of, policy.version)


def system_context(space: str) -> Context:
    """Reads everything; for ingest only."""
    return Context(space, None, system=True)


def readable(context: Context | None, namespace: str, key: Column) -> Column:
    """Predicate of the rows a context reads: a null key never matches; an empty key set matches nothing."""
    if context is None:
        raise NoContext("no permission context")
    if context.system:
        return F.lit(True)
    keys = sorted(context.keys.get(namespace, ()))
    return key.isin(keys) if keys else F.lit(False)


def secure(rows: DataFrame, context: Context | None, namespace: str, key: str = "filter_key") -> DataFrame:
    """The gate: rows the context may read.  Small key sets become literals that reach the scan, larger ones a broadcast semi-join."""
    allowed = () if context is None or context.system else sorted(context.keys.get(namespace, ()))
    if len(allowed) > KEY_CEILING:
        dim = rows.sparkSession.createDataFrame([(k,) for k in allowed], f"`{key}` string")
        return rows.join(F.broadcast(dim), key, "left_semi")
    return rows.where(readable(context, namespace, F.col(key)))


def dropped_level(context: Context, key: Column) -> Column:
    """Level of a row that was left out: L1 where its key shows at hyperedge level, else L0."""
    return F.when(readable(context, "hyperedges", key), "L1").otherwise("L0")


def secure_counted(rows: DataFrame, context: Context | None, namespace: str, key: str = "filter_key") -> tuple[DataFrame, Observation]:
    """secure(), and an observation of what it leaves out: filled by the first action over the result, in the same pass.

    The counts are taken where the rows are filtered, so nothing is read twice; the price is that the
    predicate does not reach the scan, since rows that are left out must be seen to be counted.
    """
    seen = Observation()
    keep = F.coalesce(readable(context, namespace, F.col(key)), F.lit(False))
    if context is None or context.system:
        lost = {level: F.sum(F.lit(0)) for level in DROPPED}
    else:
        lost = {level: F.count_if(~keep & (dropped_level(context, F.col(key)) == level)) for level in DROPPED}
    watched = rows.observe(seen, F.count(F.lit(1)).alias("read"), *[n.alias(level) for level, n in lost.items()])
    return watched.where(keep), seen


def dropped_rows(spark: SparkSession, counters: list[tuple[str | None, str, Context, Observation]]) -> DataFrame:
    """(request_id, role, space, namespace, dropped, n) of observations (request_id, namespace, context, observation) whose reads are done.

    Reads of one request and namespace are summed; what dropped nothing has no row.  Bounded by the requests at hand.
    """
    total: dict[tuple, int] = {}
    for request, namespace, context, seen in counters:
        for level in DROPPED:
            n = seen.get[level] or 0
            if n:
                at = (request, context.role, context.space, namespace, level)
                total[at] = total.get(at, 0) + n
    return spark.createDataFrame([(*at, n) for at, n in sorted(total.items(), key=repr)], "request_id string, role string, space string, namespace string, dropped string, n long")
