"""Policies as stored, swaps, and metered completions."""

import json

import pytest

from veilgraph import model as m
from veilgraph.operators import completion
from veilgraph.plans import policy as pol
from veilgraph.sources import catalogue, versions

GOOD = json.loads(catalogue.document(pol.DEFAULT, m.RANKS, m.GROUPS))


def _changed(**more):
    return json.dumps(GOOD | more)


def test_documents_are_checked():
    assert catalogue.parse(json.dumps(GOOD))[0] == pol.DEFAULT
    role = GOOD["roles"]["staff"]
    bad = {
        "{": "NOT_JSON", "[]": "SHAPE", json.dumps({k: v for k, v in GOOD.items() if k != "groups"}): "SHAPE", _changed(more=1): "SHAPE", _changed(name=""): "SHAPE", _changed(ranks={"faq": "4"}): "RANKS_NOT_NUMBERS", _changed(ranks={"faq": True}): "RANKS_NOT_NUMBERS",
        _changed(groups={"nowhere": "g"}): "UNKNOWN_TYPE", _changed(roles={}): "NO_ROLES", _changed(roles={"staff": role | {"scopes": "internal"}}): "NOT_A_LIST_OF_NAMES", _changed(roles={"staff": role | {"scopes": []}}): "NO_SCOPES",
        _changed(roles={"staff": role | {"scopes": ["internal", "internal"]}}): "NOT_A_LIST_OF_NAMES", _changed(roles={"staff": role | {"other": 1}}): "SHAPE", _changed(roles={"staff": role | {"disclosure": {"faq": "L2"}}}): "TYPES_DIFFER",
        _changed(roles={"staff": role | {"disclosure": role["disclosure"] | {"faq": "L9"}}}): "UNKNOWN_LEVEL", _changed(roles={"staff": role | {"disclosure": role["disclosure"] | {"secret_infra": "L2"}}}): "LEVEL_NOT_MONOTONE",
        json.dumps(GOOD).replace('"name"', '"name": "x", "name"'): "REPEATED_KEY", json.dumps(GOOD).replace('"faq": "L2"', '"faq": "L0", "faq": "L2"', 1): "REPEATED_KEY",
    }
    for body, code in bad.items():
        with pytest.raises(pol.PolicyError) as found:
            catalogue.parse(body)
        assert found.value.code == code, body[:80]


def test_a_broken_document_never_becomes_current(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(pol.PolicyError, match="NO_POLICY"):
        catalogue.current(spark, versions.latest(spark, path, "s"))
    first = catalogue.swap(spark, path, "s", json.dumps(GOOD), "owner")
    with pytest.raises(pol.PolicyError):
        catalogue.swap(spark, path, "s", _changed(roles={}), "owner")
    assert versions.latest(spark, path, "s").number == 1 and catalogue.swap(spark, path, "s", json.dumps(GOOD), "owner").number == 1
    binary = pol.variant(pol.DEFAULT, "binary")
    second = catalogue.swap(spark, path, "s", catalogue.document(binary, m.RANKS, m.GROUPS), "owner")
    with pytest.raises(versions.Conflict):
        catalogue.swap(spark, path, "s", _changed(name="late"), "other", base=first)
    assert catalogue.current(spark, second) == binary and catalogue.current(spark, first) == pol.DEFAULT
    dims = catalogue.dimensions(spark, second)
    assert {(r["since"], r["until"], r["name"]) for r in dims.select("since", "until", "name").distinct().collect()} == {(1, 2, "full"), (2, None, "binary")}
    rows = versions.rows_of(spark, second, "audit").collect()
    assert sorted(json.loads(r["details"])["policy_version"] for r in rows) == sorted([pol.DEFAULT.version, binary.version])
    # other changes of the space leave it current
    third = versions.commit(spark, second, {"gone": spark.createDataFrame([("a",)], "doc_key string")})
    assert catalogue.current(spark, third) == binary


def test_completions_are_metered(spark):
    class Odd:
        name, local = "odd", False

        def complete(self, prompts):
            if "boom" in prompts[0]:
                raise OSError("no line")
            if "few" in prompts[0]:
                return []
            return [completion.Reply(p, 1, 2) if "good" in p else completion.Reply(p, -1, 2) if "minus" in p else p for p in prompts]

    rows = spark.createDataFrame([(1, "a b c"), (2, None), (3, "  "), (4, "x")], "id int, p string")
    done = completion.complete(rows, "id", "p", completion.EchoProvider(), real=True)
    found = {r["id"]: (r["reply"], r["error"], r["prompt_tokens"]) for r in done.collect()}
    assert found == {1: ("c b a", None, 3), 2: (None, "EMPTY_PROMPT", 0), 3: (None, "EMPTY_PROMPT", 0), 4: ("x", None, 1)}
    assert [tuple(r) for r in completion.usage(done).collect()] == [("echo", 2, 0, 4, 4)]
    with pytest.raises(completion.ForeignProvider):
        completion.complete(rows, "id", "p", Odd(), real=True)
    odd = spark.createDataFrame(list(enumerate(["boom", "few", "good", "minus", "other"])), "id int, p string").repartitionByRange(5, "id")  # a call each
    done = completion.complete(odd, "id", "p", Odd(), real=False)
    assert [(r["error"], r["reply"]) for r in done.orderBy("id").collect()] == [("PROVIDER", None), ("REPLY_COUNT", None), (None, "good"), ("REPLY_SHAPE", None), ("REPLY_SHAPE", None)]
    assert [tuple(r) for r in completion.usage(done).collect()] == [("odd", 5, 4, 1, 2)]
    assert completion.complete(rows.limit(0), "id", "p", Odd(), real=False).count() == 0
