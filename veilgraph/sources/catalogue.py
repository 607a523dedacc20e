"""Policies as stored: checked JSON documents in versions of a space, one of them current.

A policy document is {"name", "ranks": {type: rank}, "groups": {type: owner group}, "roles": {role: {"scopes",
"disclosure": {type: level}, "masks": {type: [slots]}}}}.  Repeated keys are refused, so is anything that build_policy()
refuses.  swap() writes the document and the audit row of the change in one version of the space: a document that
does not load never becomes current, and a swap whose audit row fails does not happen.  Reads of an older version
of the space see the policy that was current then.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.plans.policy import Policy, PolicyError, Role, build_policy, flat
from veilgraph.sources.versions import Version, commit, history_of, latest

_KEYS = {"name", "ranks", "groups", "roles"}
_ROLE_KEYS = {"scopes", "disclosure", "masks"}


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        names = [k for k, _ in pairs]
        raise PolicyError("REPEATED_KEY", ", ".join(sorted({k for k in names if names.count(k) > 1})))
    return found


def _texts(value: object, where: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) and x for x in value) or len(set(value)) != len(value):
        raise PolicyError("NOT_A_LIST_OF_NAMES", where)
    return tuple(value)


def parse(body: str) -> tuple[Policy, dict[str, int], dict[str, str]]:
    """(policy, ranks, groups) of a document, or PolicyError."""
    try:
        found = json.loads(body, object_pairs_hook=_once)
    except ValueError as broken:
        if isinstance(broken, PolicyError):
            raise
        raise PolicyError("NOT_JSON", str(broken)) from None
    if not isinstance(found, dict) or set(found) != _KEYS or not isinstance(found["name"], str) or not found["name"]:
        raise PolicyError("SHAPE", f"a policy has the keys {sorted(_KEYS)}")
    ranks, groups, roles = found["ranks"], found["groups"], found["roles"]
    if not isinstance(ranks, dict) or not ranks or not all(isinstance(r, int) and not isinstance(r, bool) for r in ranks.values()):
        raise PolicyError("RANKS_NOT_NUMBERS", found["name"])
    if not isinstance(groups, dict) or not all(isinstance(g, str) and g for g in groups.values()) or set(groups) - set(ranks):
        raise PolicyError("UNKNOWN_TYPE", f"groups of {found['name']}")
    if not isinstance(roles, dict) or not roles:
        raise PolicyError("NO_ROLES", found["name"])
    built = {}
    for label, role in roles.items():
        if not isinstance(role, dict) or set(role) - _ROLE_KEYS or not {"scopes", "disclosure"} <= set(role):
            raise PolicyError("SHAPE", f"role {label}")
        disclosure, masks = role["disclosure"], role.get("masks", {})
        if not isinstance(disclosure, dict) or not all(isinstance(x, str) for x in disclosure.values()) or not isinstance(masks, dict):
            raise PolicyError("SHAPE", f"role {label}")
        built[label] = Role(_texts(role["scopes"], f"scopes of {label}"), disclosure, {t: _texts(s, f"mask {t} of {label}") for t, s in masks.items()})
    return build_policy(found["name"], built, ranks), ranks, groups


def document(policy: Policy, ranks: dict[str, int], groups: dict[str, str]) -> str:
    """The document of a policy; parse() gives it back."""
    roles = {r: {"scopes": list(x.scopes), "disclosure": x.disclosure, "masks": {t: list(s) for t, s in x.masks.items()}} for r, x in policy.roles.items()}
    return json.dumps({"name": policy.name, "ranks": ranks, "groups": groups, "roles": roles}, ensure_ascii=False, sort_keys=True)


def swap(spark: SparkSession, store: str, space: str, body: str, act: str, at: Column | None = None, base: Version | None = None) -> Version:
    """Make a document current.  The same document again changes nothing."""
    policy, _, _ = parse(body)
    base = base or latest(spark, store, space)
    sha = hashlib.sha256(body.encode()).hexdigest()
    before = _rows(spark, base).first()
    if before is not None and before["sha"] == sha:
        return base
    when = (at if at is not None else F.current_timestamp()).cast("timestamp").alias("at")
    details = json.dumps({"from": before["sha"] if before is not None else None, "to": sha, "policy_version": policy.version})
    audit = spark.range(1).select(F.lit("policy_swap").alias("event"), F.lit(act).alias("act"), when, F.lit(details).alias("details"))
    row = spark.createDataFrame([(policy.name, sha, body)], "name string, sha string, body string")
    return commit(spark, base, {"audit": audit, "policies": row})


def _rows(spark: SparkSession, version: Version) -> DataFrame:
    """Documents of a version of the space, the current one first."""
    return history_of(spark, version, "policies").orderBy(F.desc("since"))


def current(spark: SparkSession, version: Version) -> Policy:
    """The policy that is current in a version; its document must still be the one that was written."""
    row = _rows(spark, version).first()
    if row is None:
        raise PolicyError("NO_POLICY", f"space {version.space}")
    if hashlib.sha256(row["body"].encode()).hexdigest() != row["sha"]:
        raise PolicyError("CHANGED", row["name"])
    return parse(row["body"])[0]


def dimensions(spark: SparkSession, version: Version) -> DataFrame:
    """(since, until, name, role, scope, ctype, level, filter_key): every policy the space has had, with the versions it was current in (until: not any more; null: still)."""
    rows, after = [], Window.orderBy("since")  # one row a swap
    for r in history_of(spark, version, "policies").withColumn("until", F.lead("since").over(after)).collect():
        rows += [(r["since"], r["until"], r["name"], role, scope, ctype, level) for role, scope, ctype, _, level, _ in flat(parse(r["body"])[0])]
    return spark.createDataFrame(rows, "since long, until long, name string, role string, scope string, ctype string, level string").withColumn("filter_key", F.concat_ws(":", "scope", "ctype"))
