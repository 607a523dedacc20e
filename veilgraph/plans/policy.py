"""Role policies: validation, compilation to flat dimensions, and the four disclosure variants."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.model import LEVELS, MASKABLE, NAMESPACE_LEVEL, OWNER, RANKS, SCOPES, TYPES

KEY_CEILING = 50


class PolicyError(ValueError):
    """A policy that breaks a rule; code says which."""

    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Role:
    scopes: tuple[str, ...]
    disclosure: dict[str, str]
    masks: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def level(self, ctype: str) -> str:
        return self.disclosure.get(ctype, "L0")


@dataclass(frozen=True)
class Policy:
    name: str
    roles: dict[str, Role]

    @property
    def version(self) -> str:
        body = {r: [x.scopes, x.disclosure, x.masks] for r, x in self.roles.items()}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def build_policy(name: str, roles: dict[str, Role], ranks: dict[str, int] = RANKS) -> Policy:
    """A checked policy: known levels, types and slots; masks at L1 only and never of owner; levels fall and masks grow with rank."""
    if len(set(ranks.values())) != len(ranks) or not all(isinstance(r, int) for r in ranks.values()):
        raise PolicyError("RANKS_NOT_UNIQUE", name)
    order = sorted(ranks, key=ranks.get)
    for label, role in roles.items():
        if not role.scopes:
            raise PolicyError("NO_SCOPES", label)
        if set(role.disclosure) != set(ranks):
            raise PolicyError("TYPES_DIFFER", f"{label}: {sorted(set(role.disclosure) ^ set(ranks))}")
        if bad := set(role.disclosure.values()) - set(LEVELS):
            raise PolicyError("UNKNOWN_LEVEL", f"{label}: {sorted(bad)}")
        for ctype, slots in role.masks.items():
            if role.level(ctype) != "L1":
                raise PolicyError("MASK_NOT_AT_L1", f"{label}: {ctype}")
            if OWNER in slots or not set(slots) <= set(MASKABLE):
                raise PolicyError("MASK_UNKNOWN_SLOT", f"{label}: {ctype}")
        levels = [role.level(t) for t in order]
        if any(a < b for a, b in zip(levels, levels[1:], strict=False)):
            raise PolicyError("LEVEL_NOT_MONOTONE", label)
        partly = [set(role.masks.get(t, ())) for t in order if role.level(t) == "L1"]
        if any(not a <= b for a, b in zip(partly, partly[1:], strict=False)):
            raise PolicyError("MASK_NOT_MONOTONE", label)
    return Policy(name, roles)


def _role(scopes: Iterable[str], open_to: int, part_to: int) -> Role:
    """L2 up to rank open_to, L1 up to part_to with masks that grow with rank, L0 beyond."""
    level = {t: "L2" if r <= open_to else "L1" if r <= part_to else "L0" for t, r in RANKS.items()}
    grow = lambda r: ("source",) if r <= 16 else ("source", "condition") if r <= 24 else ("source", "condition", "cause", "remediation")
    return Role(tuple(scopes), level, {t: grow(RANKS[t]) for t in TYPES if level[t] == "L1"})


#: The default policy: five roles over thirteen types.
DEFAULT = build_policy(
    "full",
    {
        "staff": _role(SCOPES[:1], 4, 10),
        "support": _role(SCOPES[1:], 10, 18),
        "engineer": _role(SCOPES[:2], 16, 24),
        "security": _role(SCOPES, 20, 27),
        "admin": _role(SCOPES, 30, 30),
    },
)


def variant(policy: Policy, kind: str) -> Policy:
    """off: everything at L2 in every scope; binary: L1 becomes L0; full: as is; min_l1: L0 becomes L1 with every slot masked."""
    out = {}
    for name, role in policy.roles.items():
        if kind == "off":
            out[name] = Role(SCOPES, dict.fromkeys(role.disclosure, "L2"))
        elif kind == "binary":
            out[name] = Role(role.scopes, {t: "L0" if x == "L1" else x for t, x in role.disclosure.items()})
        elif kind == "min_l1":
            masks = role.masks | {t: MASKABLE for t, x in role.disclosure.items() if x == "L0"}
            out[name] = Role(role.scopes, {t: "L1" if x == "L0" else x for t, x in role.disclosure.items()}, masks)
        elif kind == "full":
            out[name] = role
        else:
            raise PolicyError("UNKNOWN_VARIANT", kind)
    return build_policy(kind, out)


VARIANTS = ("off", "binary", "full", "min_l1")


def flat(policy: Policy) -> list[tuple[str, str, str, int, str, list[str]]]:
    """(role, scope, ctype, rank, level, mask) rows; mask holds owner too."""
    return [(r, s, t, RANKS[t], role.level(t), [*role.masks.get(t, ()), OWNER]) for r, role in policy.roles.items() for s in role.scopes for t in role.disclosure]


def dimension(spark: SparkSession, policy: Policy) -> DataFrame:
    """The policy as a table with one row a role, scope and type: roles x scopes x types, a few hundred rows."""
    return spark.createDataFrame(flat(policy), "role string, scope string, ctype string, rank int, level string, mask array<string>").withColumn("filter_key", F.concat_ws(":", "scope", "ctype"))


def allowed_keys(spark: SparkSession, policy: Policy) -> DataFrame:
    """(role, namespace, keys): sorted keys a role sees in each namespace."""
    wanted = spark.createDataFrame(list(NAMESPACE_LEVEL.items()), "namespace string, least string")
    rows = dimension(spark, policy)
    return rows.join(F.broadcast(wanted), rows["level"] >= wanted["least"]).groupBy("role", "namespace").agg(F.sort_array(F.collect_set("filter_key")).alias("keys"))


def over_ceiling(keys: DataFrame) -> DataFrame:
    """Roles and namespaces with more keys than a literal list should hold."""
    return keys.where(F.size("keys") > KEY_CEILING).select("role", "namespace", F.size("keys").alias("n_keys"))


def monotone_check(rows: DataFrame) -> DataFrame:
    """Per role and type: the level of the next lower rank, and whether the level does not rise."""
    one = rows.select("role", "ctype", "rank", "level").distinct()
    before = F.lag("level").over(Window.partitionBy("role").orderBy("rank"))
    return one.withColumn("prev_level", before).withColumn("ok", F.coalesce(F.col("prev_level") >= F.col("level"), F.lit(True)))
