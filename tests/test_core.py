"""Unit tests of policy, keys, masking, facts, text, graph, ingest and streaming operators."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from veilgraph import model as m
from veilgraph.functions import facts, keys, redaction, text
from veilgraph.metrics import cost, matching, ratios
from veilgraph.operators import audit, graph, lookup, masking, vector
from veilgraph.plans import policy as pol
from veilgraph.plans.context import Context, NoContext, readable, secure, system_context, user_context
from veilgraph.sources import ingest, scan, versions
from veilgraph.streaming import audit as stream


def _fold(old, new):
    """The pairwise merge: absorbing null, scope conflict to null, higher rank wins."""
    if old == "absent":
        return new
    if old is None or new is None or old.split(":")[0] != new.split(":")[0]:
        return None
    return old if m.RANKS[old.split(":")[1]] >= m.RANKS[new.split(":")[1]] else new


def test_merge_is_the_fold_in_any_order(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for i in range(60):
        scopes = m.SCOPES[:1] if i % 2 else m.SCOPES
        own = [f"{rng.choice(scopes)}:{rng.choice(m.TYPES)}" if rng.random() > 0.05 else None for _ in range(rng.randint(1, 5))]
        state = "absent"
        for k in own:
            state = _fold(state, k)
        expected[i] = state
        rng.shuffle(own)
        rows += [(i, k) for k in own]
    rng.shuffle(rows)
    got = keys.merge_by(spark.createDataFrame(rows, "id int, filter_key string").repartition(5), "id").collect()
    assert {r["id"]: r["filter_key"] for r in got} == expected


def test_key_parts(spark):
    row = spark.sql("select ' a ' s, 'b' t, 'x:y' bad, '' nothing").select(keys.filter_key(F.col("s"), F.col("t")).alias("k"), keys.filter_key(F.col("bad"), F.col("t")).alias("b"), keys.filter_key(F.col("s"), F.col("nothing")).alias("n")).first()
    assert (row["k"], row["b"], row["n"]) == ("a:b", None, None)


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (lambda r: pol.Role((), r.disclosure, r.masks), "NO_SCOPES"),
        (lambda r: pol.Role(r.scopes, r.disclosure | {"faq": "L9"}, r.masks), "UNKNOWN_LEVEL"),
        (lambda r: pol.Role(r.scopes, r.disclosure, r.masks | {"faq": ("cause",)}), "MASK_NOT_AT_L1"),
        (lambda r: pol.Role(r.scopes, r.disclosure, r.masks | {"access_log": ("owner",)}), "MASK_UNKNOWN_SLOT"),
        (lambda r: pol.Role(r.scopes, r.disclosure | {"secret_infra": "L2"}, r.masks), "LEVEL_NOT_MONOTONE"),
        (lambda r: pol.Role(r.scopes, r.disclosure, r.masks | {"access_log": ()}), "MASK_NOT_MONOTONE"),
        (lambda r: pol.Role(r.scopes, {k: v for k, v in r.disclosure.items() if k != "faq"}, r.masks), "TYPES_DIFFER"),
    ],
)
def test_policy_rules(change, code):
    with pytest.raises(pol.PolicyError) as failure:
        pol.build_policy("p", {"support": change(pol.DEFAULT.roles["support"])})
    assert failure.value.code == code


def test_gate_fails_closed(spark):
    rows = spark.createDataFrame([("internal:faq",), (None,), ("customer_a:faq",)], "filter_key string")
    with pytest.raises(NoContext):
        secure(rows, None, "chunks")
    assert secure(rows, Context("s", "r"), "chunks").count() == 0
    assert secure(rows, system_context("s"), "chunks").count() == 3
    staff = user_context(pol.DEFAULT, "staff", "s")
    assert [r[0] for r in secure(rows, staff, "chunks").collect()] == ["internal:faq"]
    wide = Context("s", "r", {"chunks": frozenset(f"internal:{i}" for i in range(60)) | {"internal:faq"}})
    assert secure(rows, wide, "chunks").count() == 1
    with pytest.raises(PermissionError):
        user_context(pol.DEFAULT, "nobody", "s")


def test_filter_reaches_the_scan(spark, small, tmp_path):
    path = str(tmp_path / "docs")
    m.documents(spark, small).write.parquet(path)
    plan = secure(spark.read.parquet(path), user_context(pol.DEFAULT, "staff", "s"), "chunks").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(filter_key" in plan and "text" not in plan.split("ReadSchema")[1]


def test_mask_is_below_user_filters(spark):
    ctx = user_context(pol.DEFAULT, "support", "s")
    rows = spark.createDataFrame([("h1", "customer_a:access_log", *["v"] * 7, "Ann"), ("h2", "customer_a:access_log", *["v"] * 5, None, "v", None)], "he_id string, filter_key string, " + ", ".join(f"{s} string" for s in m.SLOTS))
    out = masking.mask_facts(rows, ctx)
    assert out.columns == rows.columns
    assert out.where("condition = 'v'").count() == 0  # masked at this rank; the filter sees the marker
    assert {r["source"] for r in out.collect()} == {"[source:masked]", None}
    assert {r["owner"] for r in out.collect()} == {masking.owner_mark(m.GROUPS["access_log"])}
    granted = masking.mask_facts(rows, user_context(pol.DEFAULT, "support", "s", frozenset({"h1"}))).where("he_id = 'h1'").first()
    assert granted["condition"] == "v" and granted["owner"].startswith("[owner:")
    assert out.select(F.bool_and(masking.is_marker(F.col("owner")))).first()[0]
    for bad in ("", " a", "a]", "a:b"):
        with pytest.raises(ValueError):
            masking.owner_mark(bad)


def test_bridge_entity_is_masked_but_walks(spark):
    he = spark.createDataFrame([("a", "internal:faq"), ("b", "internal:faq")], "he_id string, filter_key string")
    ent = spark.createDataFrame([("e", None)], "entity_id string, filter_key string")
    inc = spark.createDataFrame([("a", "e", "cause"), ("b", "e", "cause")], "he_id string, entity_id string, slot string")
    ctx = user_context(pol.DEFAULT, "staff", "s")
    assert graph.visible_edges(he, ent, inc, ctx).count() == 0
    edges = graph.visible_edges(he, ent, inc, ctx, strict=False)
    assert [r["he_id"] for r in graph.adjacent(edges, he.where("he_id = 'a'")).collect()] == ["b"]
    assert {r["neighbor"] for r in masking.mask_edges(edges, ctx).collect()} == {masking.NO_KEY_MARK}


def test_fact_checks(spark):
    import json

    cases = [
        ({"subject": ' "a  b" ', "cause": "c"}, None), (5, "NOT_OBJECT"), ({"x": "y"}, "UNKNOWN_ROLE"), ({"subject": 1}, "WRONG_TYPE"), ({"subject": "---"}, "EMPTY_VALUE"), ({"subject": "a" * 301}, "TOO_LONG"), ({"cause": "c", "time": "t"}, "NO_SUBJECT"),
        ({"subject": "s"}, "TOO_FEW_ROLES"), ({"subject": "---", "nope": "x"}, "EMPTY_VALUE"), ({"nope": "x", "subject": "---"}, "UNKNOWN_ROLE"), ({}, "NO_SUBJECT"), ({"subject": "a", "cause": None}, "WRONG_TYPE"), ([], "NOT_OBJECT"), ({"subject": "ab", "cause": "١"}, None),
    ]  # fmt: skip  # the first wrong key decides
    bodies = {1: json.dumps({"facts": [x for x, _ in cases]}), 2: '```json\n{"facts": []}\n```', 3: "", 4: None, 5: "[1]", 6: '{"facts": {}}', 7: "[" * 100_000, 8: '```\n{"facts": [{"subject": "a", "cause": "b", "cause": "c"}]}\n``` more'}
    found = facts.parse_responses(spark.createDataFrame(list(bodies.items()), "id int, t string"), "id", "t").collect()
    assert [r["code"] for r in sorted((r for r in found if r["id"] == 1), key=lambda r: r["pos"])] == [c for _, c in cases]
    good = next(r for r in found if r["id"] == 1 and r["pos"] == 0)
    assert (good["subject"], good["cause"], good["time"]) == ("a b", "c", None) and all(r["subject"] is None for r in found if r["code"])
    assert {r["id"]: r["broken"] for r in found if r["id"] > 2} == {3: "NOT_JSON", 4: "NOT_JSON", 5: "NO_FACTS", 6: "NO_FACTS", 7: "NOT_JSON", 8: None}
    assert not [r for r in found if r["id"] == 2] and [r["cause"] for r in found if r["id"] == 8] == ["c"]


def test_ids(spark):
    rows = spark.createDataFrame([("Straße", "x")], "a string, b string")
    out = rows.select(text.point_id(F.col("a")).alias("p"), text.fold("a").alias("f"), text.collapse(F.lit(' "a   é" ')).alias("c")).first()
    assert out["p"] == str(uuid.uuid5(uuid.UUID(text.ID_NAMESPACE), "Straße"))
    assert out["f"] == "strasse" and out["c"] == "a é"
    with pytest.raises(ValueError):
        text.pseudonym("short", F.lit("k"), F.lit("v"))


def _redacted(spark, rows, names=None, known=None):
    frame = spark.createDataFrame(rows, "id int, t string")
    names = spark.createDataFrame(names, "value string, alias string") if names else None
    known = spark.createDataFrame(known, "kind string, value string, alias string") if known else None
    out, aliases = redaction.redact(frame, "id", "t", names, known)
    return sorted(out.collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["redacted"])), sorted(tuple(r) for r in aliases.collect())


def test_redaction(spark):
    body = 'mail bob@corp.de or ann@corp.de, 10.0.0.1 and 93.1.2.3, call 0912345678, password: "two words", bob@corp.de Bearer abcdefgh12 see www.corp.de'
    out, aliases = _redacted(spark, [(1, body), (2, "ann@corp.de"), (3, None)])
    assert out[0]["redacted"] == "mail mail02@example.invalid or mail01@example.invalid, 10.0.0.1 and 203.0.113.1, call 0900000001, password: <CREDENTIAL>, mail02@example.invalid Bearer <CREDENTIAL> see customer01.example"
    assert out[1]["redacted"] == "mail01@example.invalid" and out[2]["redacted"] == ""
    assert [out[0][f"n_{k}"] for k in (*redaction.KINDS, "name")] == [2, 3, 1, 1, 1, 0]
    assert aliases == [("domain", "www.corp.de", "customer01.example"), ("email", "ann@corp.de", "mail01@example.invalid"), ("email", "bob@corp.de", "mail02@example.invalid"), ("ip", "93.1.2.3", "203.0.113.1"), ("phone", "0912345678", "0900000001")]
    again, more = _redacted(spark, [(1, out[0]["redacted"])])
    assert again[0]["redacted"] == out[0]["redacted"] and more == []


def test_redaction_of_names(spark):
    names = [("Nguyễn Văn A", "P1"), ("Nguyễn Văn", "P2"), ("Anna Smith", "P3"), ("Trần", "P4"), ("CongTyX", "O1"), ("CongTyXcloud", "O1"), ("ACME (VN).", "O2")]
    import unicodedata

    texts = ["Nguyễn Văn A, Nguyễn  Văn\nB; Trần", "ask Anna\tSmith or Annabel Smith", "CongTyXcloud va CongTyX", unicodedata.normalize("NFD", "Trần Nguyễn Văn A"), "Trầnx _Trần the ACME (VN). end", "AnnaSmith Anna, Smith"]
    out, _ = _redacted(spark, list(enumerate(texts)), names)
    assert [r["redacted"] for r in out] == ["P1, P2\nB; P4", "ask P3 or Annabel Smith", "O1 va O1", "P4 P1", "Trầnx _Trần the O2). end", "AnnaSmith Anna, Smith"]
    assert [r["n_name"] for r in out] == [3, 1, 2, 2, 1, 0]
    for bad in ([("A", "x"), ("A", "y")], [("--", "x")]):
        with pytest.raises(ValueError):
            _redacted(spark, [(1, "A")], bad)


def test_aliases_skip_what_is_there(spark):
    rows = [(1, "real 0900000001 and 0912345678, 0912345679"), (2, "mail02@example.invalid a@b.vn c@b.vn"), (3, "203.0.113.1 93.1.2.3 240.0.0.0 customer01.example x.vn")]
    out, aliases = _redacted(spark, rows, known=[("email", "old@b.vn", "mail01@example.invalid"), ("phone", "0999999999", "0900000003")])
    assert [r["redacted"] for r in out] == ["real 0900000001 and 0900000002, 0900000004", "mail02@example.invalid mail03@example.invalid mail04@example.invalid", "203.0.113.1 203.0.113.2 240.0.0.0 customer01.example customer02.example"]
    assert len({(k, a) for k, _, a in aliases}) == len(aliases) == 8
    many = [(i, f"host 93.{i // 200}.{i % 200}.7") for i in range(600)]
    out, aliases = _redacted(spark, many)
    found = {a for _, _, a in aliases}
    assert len(found) == 600 and all(max(map(int, a.split("."))) < 256 for a in found) and not any("93." in r["redacted"] for r in out)
    assert _redacted(spark, [(1, " ".join(sorted(found)))])[1] == []
    with pytest.raises(ValueError):
        _redacted(spark, rows, known=[("email", "a", "mail01@example.invalid"), ("email", "b", "mail01@example.invalid")])


def test_credentials():
    cases = {
        "password: Mau@98765x": ["Mau@98765x"], 'SECRET="00000000-1111"': ['"00000000-1111"'], "Authorization: Bearer abc123 rest": ["Bearer abc123"], "mật  khẩu = bí mật": [], "mật khẩu: matkhau1": ["matkhau1"],
        "api-key=abcd api_key=abcd apikey=abcd API KEY: abcd": ["abcd"] * 4, "api--key=abcd": [], "pass: abc": [], "pass='ab cd' x": ["'ab cd'"], 'pass="ab\ncd"': [], "basic QWxhZGRpbjpvcGVu": ["QWxhZGRpbjpvcGVu"],
        "token=<CREDENTIAL>": [], "token = token=abcd": ["token=abcd"], "compass: north": ["north"], "bearer short": [], "secret:": [], "Bearer abcdefgh": ["abcdefgh"], "authorization: Basic abc": ["Basic"],
    }
    for text_, want in cases.items():
        assert [text_[s:e] for s, e in redaction.credentials(text_)] == want, text_
    long = "a: b = c " * 50_000
    assert redaction.credentials(long + "token=abcdef") == [(len(long) + 6, len(long) + 12)]


def test_redaction_fails_closed(spark):
    rows = [(None, "amy@corp.vn 0912345678"), (1, "amy@corp.vn"), (1, "amy@corp.vn and bob@corp.vn"), (1, "amy@corp.vn"), (2, ""), (3, "ask Anna or Annabel, x.bob@corp.vn")]
    out, _ = _redacted(spark, rows, [("Anna", "Person A")], [("email", "amy@corp.vn", "first@example.invalid")])
    assert len(out) == 6 and not any("corp.vn" in r["redacted"] or "0912345678" in r["redacted"] for r in out)
    assert sorted((r["n_email"], r["n_phone"]) for r in out) == [(0, 0), (1, 0), (1, 0), (1, 0), (1, 1), (2, 0)]
    texts = {r["redacted"] for r in out}
    assert "first@example.invalid" in texts and any(x.startswith("ask Person A or Annabel") for x in texts)
    assert redaction.redact(spark.createDataFrame([], "id int, t string"), "id", "t")[0].count() == 0


def test_kept_values():
    cases = {"172.16.0.9": True, "172.32.0.1": False, "8.8.8.8": True, "8.8.8.9": False, "300.1.1.1": True, "203.0.113.7": True, "93.1.2.3": False}
    assert {v: redaction._kept("ip", v) for v in cases} == cases


def test_unicode_forms_of_a_name_are_one(spark):
    rows = spark.createDataFrame([("Caf\u00e9 ",), ("Cafe\u0301",)], "n string")
    quoted = spark.createDataFrame([('" "Caf\u00e9""',)], "n string")
    assert rows.union(quoted).select(text.point_id(F.col("n")).alias("p")).distinct().count() == 1
    assert rows.select(text.grouping_key(F.col("n")).alias("g")).distinct().count() == 1
    with pytest.raises(Exception, match="empty"):
        spark.createDataFrame([("  ",)], "n string").select(text.normal_id(F.col("n")).alias("x")).collect()


def test_anchors(spark):
    facts = spark.createDataFrame([("a", "pump station north"), ("b", "pump"), ("c", "north pump station"), ("d", None), ("e", "")], "he_id string, subject string")
    anchors = spark.createDataFrame([(1, "pump"), (2, "station"), (3, "no"), (4, "absent"), (5, "")], "anchor_id int, anchor string")
    found = {tuple(r) for r in lookup.by_anchor(anchors, facts).collect()}
    assert found == {(1, "b"), (2, "a"), (2, "c"), (3, "a"), (3, "c"), (5, "e")}


def test_front_matter(spark):
    cases = {"---\na: 1\nb: 'x: y'\n---\nbody\n": ({"a": "1", "b": "x: y"}, "body\n"), "---\na: 1\nno end": ({}, "---\na: 1\nno end"), "plain": ({}, "plain")}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("f", text.front_matter(F.col("t"))).collect()
    for r in rows:
        assert (dict(r["f"]["meta"]), r["f"]["body"]) == cases[r["t"]]


def test_scan_reads_a_folder(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("---\nscope: s\ncontent_type: t\n---\nhello".encode("utf-8-sig"))
    (tmp_path / ".hidden.md").write_text("x")
    (tmp_path / "b.pdf").write_text("x")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    out = {r["doc_key"]: r for r in scan.check_files(scan.read_files(spark, str(tmp_path))).collect()}
    assert set(out) == {"a.md", "b.pdf", "c.txt"}
    assert out["a.md"]["filter_key"] == "s:t" and out["a.md"]["body"] == "hello"
    assert (out["b.pdf"]["reject_code"], out["c.txt"]["reject_code"]) == ("UNKNOWN_FORMAT", "NOT_UTF8")


def test_vectors(spark):
    rows = vector.embed(spark.createDataFrame([(i, f"t{i}") for i in range(4)], "vec_id long, t string"), "t", vector.HashEmbedder())
    own = rows.select("vec_id", F.lit("chunks").alias("namespace"), F.when(F.col("vec_id") < 3, "internal:faq").alias("filter_key"), "embedding")
    found = vector.top_k(own, vector.HashEmbedder().embed(["t1"])[0], user_context(pol.DEFAULT, "staff", "s"), "chunks", 2).collect()
    assert found[0]["vec_id"] == 1 and found[0]["score"] == pytest.approx(1.0, abs=1e-6) and all(r["vec_id"] < 3 for r in found)
    new = own.where("vec_id < 2").withColumn("filter_key", F.when(F.col("vec_id") == 0, "customer_a:faq").otherwise("internal:runbook")).withColumn("written", F.lit(1))
    again = new.withColumn("written", F.lit(2)).withColumn("filter_key", F.lit("internal:faq")).withColumn("embedding", F.array(F.lit(9.0).cast("float")))
    last = vector.upsert(own.where("vec_id < 3"), new.union(again)).where("vec_id = 1").first()
    assert last["embedding"] == [9.0] and last["filter_key"] == "internal:runbook"
    after = {r["vec_id"]: r["filter_key"] for r in vector.upsert(own.where("vec_id < 3"), new).collect()}
    assert after == {1: "internal:runbook", 2: "internal:faq"}


def test_ingest_writes_and_removes(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = lambda *rows: spark.createDataFrame([(k, "internal", t, b) for k, t, b in rows], "doc_key string, scope string, ctype string, body string")
    arts = lambda *rows: spark.createDataFrame(list(rows), "doc_key string, art_id string, filter_key string")
    status = lambda frame: {r["doc_key"]: r["status"] for r in frame.collect()}
    stored = lambda space="s": {r["art_id"]: (r["filter_key"], r["sources"]) for r in ingest.stored_artifacts(spark, versions.latest(spark, path, space)).collect()}
    first = batch(("a", "faq", "one"), ("b", "runbook", "two"), ("c", "faq", "one"), ("d", "nonsense", "x"), ("e", "faq", "no facts here"))
    facts = arts(("a", "h1", "internal:faq"), ("a", "h2", "internal:faq"), ("b", "h2", "internal:runbook"), ("c", "h9", "internal:faq"), ("d", "h9", "internal:faq"))
    assert status(ingest.ingest(first, facts, path, "s")) == {"a": "new", "b": "new", "c": "duplicate", "d": "unknown_rank", "e": "no_facts"}
    assert stored() == {"h1": ("internal:faq", ["a"]), "h2": ("internal:runbook", ["a", "b"])}
    ingest.ingest(first, facts, path, "other")
    again = batch(("a", "faq", "one, changed"), ("b", "runbook", "two"))
    assert status(ingest.ingest(again, arts(("a", "h3", "internal:faq"), ("b", "h4", "internal:faq")), path, "s")) == {"a": "reingest", "b": "unchanged"}
    assert stored() == {"h2": ("internal:runbook", ["b"]), "h3": ("internal:faq", ["a"])}
    assert status(ingest.ingest(batch(("a", "faq", "now empty")), arts(("z", "h5", "internal:faq")), path, "s")) == {"a": "no_facts"}
    assert set(stored()) == {"h2"} and {r["doc_key"] for r in versions.rows_of(spark, versions.latest(spark, path, "s"), "ledger").collect()} == {"b"}
    assert {r["art_id"]: r["fate"] for r in ingest.remove(spark.createDataFrame([("b",)], "doc_key string"), path, "s").collect()} == {"h2": "private"}
    assert stored() == {} and set(stored("other")) == {"h1", "h2"}
    with pytest.raises(ValueError, match="repeats"):
        ingest.ingest(batch(("a", "faq", "x"), ("a", "faq", "y")), facts, path, "s")
    ingest.drop_space(spark, path, "other")
    assert stored("other") == {}


def test_greedy_match(spark):
    rows = [("d", "g1", "p1", 0.9), ("d", "g1", "p2", 0.8), ("d", "g2", "p1", 0.85), ("d", "g2", "p2", 0.1)]
    got = matching.greedy_match(spark.createDataFrame(rows, "doc_key string, gold_id string, pred_id string, score double")).collect()
    assert {(r["gold_id"], r["pred_id"]) for r in got} == {("g1", "p1"), ("g2", "p2")}


def test_greedy_match_by_rounds(spark, monkeypatch):
    """Large documents are matched as small ones are, with chains and ties."""
    rng = random.Random(2)
    rows = {(f"d{i % 3}", f"g{rng.randrange(12)}", f"p{rng.randrange(12)}"): float(rng.randrange(4)) for i in range(300)}
    rows |= {("chain", f"g{k:02d}", f"p{k + j:02d}"): float(20 - k) for k in range(15) for j in (0, 1)}
    frame = spark.createDataFrame([(*k, v) for k, v in rows.items()], "doc_key string, gold_id string, pred_id string, score double")
    for ties in (("gold_id", "pred_id"), ("pred_id", "gold_id")):
        place, used, want = {"gold_id": 1, "pred_id": 2}, set(), []
        for (d, g, p), v in sorted(rows.items(), key=lambda r: (-r[1], *[r[0][place[t]] for t in ties])):
            if (d, 1, g) not in used and (d, 2, p) not in used:
                used |= {(d, 1, g), (d, 2, p)}
                want.append((d, g, p, v))
        for group in (10_000, 5):
            monkeypatch.setattr(matching, "GROUP", group)
            assert sorted(map(tuple, matching.greedy_match(frame, ties).collect())) == sorted(want)


def test_composition_needs_every_entity(spark):
    rank = spark.createDataFrame([("hot", 24), ("cold", 4)], "he_id string, rank int")
    inc = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("cold", "a")], "he_id string, entity_id string")
    scopes = spark.createDataFrame([("hot", "s"), ("cold", "s")], "he_id string, scope string")
    assert [(r["n_exposed"], r["at_risk"]) for r in ratios.composition_risk(rank, inc, scopes).collect()] == [(1, False)]
    inc = inc.union(spark.createDataFrame([("cold", "b")], inc.schema))
    assert ratios.composition_risk(rank, inc, scopes).first()["at_risk"]
    assert not ratios.composition_risk(rank, inc, scopes.withColumn("scope", F.col("he_id"))).first()["at_risk"]


def test_cost(spark):
    lines = spark.createDataFrame([("extract", 10, 1000, 2.0)], "line string, calls int, tokens int, price double")
    assert cost.extrapolate(lines, 3.0).first()["cost"] == pytest.approx(0.06)


def test_stream_counts(spark, small, tmp_path):
    source = str(tmp_path / "in")
    m.table(spark, small, "events").repartition(3).write.parquet(source)
    stream.run_once(stream.windowed_counts(stream.deduplicated(stream.read_events(spark, source, 1), "90 days"), "1 day", None).select("start", "event_type", "n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = m.table(spark, small, "events").groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.exceptAll(batch).count() == 0


def test_grants_expire(spark):
    rows = spark.sql("select 'a' act, 's' space, timestamp '2024-01-01 00:00:00' ts, array('h2','h1') he_ids")
    at = lambda t: audit.active_grants(audit.grants(rows), F.to_timestamp(F.lit(t)))
    assert at("2024-01-01 00:59:59").first()["he_ids"] == ["h1", "h2"] and at("2024-01-01 01:00:00").count() == 0


def test_readable_null_key_never_matches(spark):
    ctx = user_context(pol.DEFAULT, "admin", "s")
    assert spark.sql("select cast(null as string) k").where(readable(ctx, "hyperedges", F.col("k"))).count() == 0
