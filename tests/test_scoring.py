"""Extraction scoring against plain loops over all pairs of slots."""

import random
from collections import Counter

import pytest

from veilgraph.metrics import scoring
from veilgraph.model import SLOTS

SCHEMA = "doc_key string, fact_id string, " + ", ".join(f"`{s}` string" for s in SLOTS)


def _agree(a, b):
    a, b = a.casefold(), b.casefold()
    return "exact" if a == b else "loose" if a in b or b in a else None


def _fill(fact):
    return [(s, v, fact[1]) for s, v in zip(SLOTS, fact[2:], strict=True) if v]


def _match(golds, preds, passes):
    """Greedy over passes of (same role?, kind): [(gold index, pred index, kind)]."""
    used_g, used_p, out = set(), set(), []
    order = lambda x: (SLOTS.index(x[1][0]), x[1][2])
    for same, kind in passes:
        for i, g in sorted(enumerate(golds), key=order):
            for j, p in sorted(enumerate(preds), key=order):
                if i not in used_g and j not in used_p and (g[0] == p[0]) == same and _agree(g[1], p[1]) == kind:
                    used_g.add(i)
                    used_p.add(j)
                    out.append((i, j, kind))
    return out


FOUR = [(True, "exact"), (True, "loose"), (False, "exact"), (False, "loose")]


def _pair_level(golds, preds):
    options = []
    for i, g in enumerate(golds):
        for j, p in enumerate(preds):
            if g[2] and p[2] and _agree(g[2], p[2]):
                gs, ps = _fill(g), _fill(p)
                hits = _match(gs, ps, FOUR)
                options.append((-sum(gs[a][0] == ps[b][0] for a, b, _ in hits), -len(hits), p[1], g[1], i, j))
    used_g, used_p, rows = set(), set(), Counter()
    for *_, i, j in sorted(options):
        if i in used_g or j in used_p:
            continue
        used_g.add(i)
        used_p.add(j)
        gs, ps = _fill(golds[i]), _fill(preds[j])
        hits = _match(gs, ps, FOUR)
        rows.update((gs[a][0], ps[b][0], kind) for a, b, kind in hits)
        rows.update((gs[a][0], "missing", "missing") for a in set(range(len(gs))) - {a for a, _, _ in hits})
        rows.update(("extra", ps[b][0], "extra") for b in set(range(len(ps))) - {b for _, b, _ in hits})
    rows.update((s, "missing", "missing") for i, g in enumerate(golds) if i not in used_g for s, *_ in _fill(g))
    rows.update(("extra", s, "extra") for j, p in enumerate(preds) if j not in used_p for s, *_ in _fill(p))
    return rows


def _document_level(golds, preds):
    gs, ps = [x for g in golds for x in _fill(g)], [x for p in preds for x in _fill(p)]
    hits = _match(gs, ps, FOUR[:2])
    rows = Counter((gs[i][0], ps[j][0], kind) for i, j, kind in hits)
    blamed = set()
    for i in set(range(len(gs))) - {i for i, _, _ in hits}:
        role, value, _ = gs[i]
        far = sorted((_agree(value, v) != "exact", SLOTS.index(r), f, j) for j, (r, v, f) in enumerate(ps) if r != role and _agree(value, v))
        near = {_agree(value, v) for r, v, _ in ps if r == role} - {None}
        if far:
            blamed.add(far[0][-1])
            rows[role, ps[far[0][-1]][0], "confused"] += 1
        else:
            rows[role, "missing", "repeated" if "exact" in near else "used" if near else "missing"] += 1
    rows.update(("extra", ps[j][0], "extra") for j in set(range(len(ps))) - {j for _, j, _ in hits} - blamed)
    return rows


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(11)
    words = ["ab", "ABC", "abcd", "x", "xy", "Đà", "đà nẵng", "q", "  ", None, None]

    def fact(doc, side, n):
        return (f"d{doc}", f"{side}{rng.randrange(10)}{n}", rng.choice(words[:6]), *[rng.choice(words) for _ in SLOTS[1:]])

    golds = [fact(d, "g", n) for d in range(12) for n in range(d % 5)]
    preds = [fact(d, "p", n) for d in range(13) for n in range((d + 2) % 5)]
    return golds, preds


def _clean(rows):
    return [tuple(v.strip() or None if isinstance(v, str) else v for v in r) for r in rows]


@pytest.mark.parametrize(("call", "plain"), [(scoring.pair_level, _pair_level), (scoring.document_level, _document_level)])
def test_like_plain_loops(spark, sets, call, plain):
    golds, preds = sets
    found = Counter(tuple(r) for r in call(spark.createDataFrame(golds, SCHEMA), spark.createDataFrame(preds, SCHEMA)).collect())
    wanted = Counter()
    for doc in {r[0] for r in golds + preds}:
        own = lambda rows: [r for r in _clean(rows) if r[0] == doc]  # noqa: B023, E731
        wanted.update({(doc, *k): n for k, n in plain(own(golds), own(preds)).items()})
    assert found == wanted


def test_ledger_and_empty_sets(spark, sets):
    gold, pred = (spark.createDataFrame(x, SCHEMA) for x in sets)
    matrix = scoring.cells(scoring.pair_level(gold, pred))
    rows = {r["role"]: r for r in scoring.ledger(matrix, gold, pred).collect()}
    assert rows["all"]["n_gold"] == sum(len(_fill(r)) for r in _clean(sets[0]))
    assert rows["all"]["n_gold"] - rows["subject"]["n_gold"] == rows["no_subject"]["n_gold"]
    top = scoring.top_confusions(matrix, 5).collect()
    assert [r["n"] for r in top] == sorted((r["n"] for r in top), reverse=True)
    none = gold.limit(0)
    empty = scoring.ledger(scoring.cells(scoring.document_level(none, none)), none, none).collect()
    assert len(empty) == 10 and all(r["strict_f1"] is None and r["exact"] == 0 for r in empty)
