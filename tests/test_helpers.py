"""Small helpers that no query reaches."""

import hashlib

from pyspark.sql import functions as F

from veilgraph.functions import text
from veilgraph.plans import policy as pol
from veilgraph.sources import store


def test_keys_over_the_ceiling(spark):
    keys = spark.createDataFrame([("a", "chunks", [str(i) for i in range(pol.KEY_CEILING + 1)]), ("b", "chunks", ["x"]), ("c", "chunks", [str(i) for i in range(pol.KEY_CEILING)])], "role string, namespace string, keys array<string>")
    assert [(r["role"], r["n_keys"]) for r in pol.over_ceiling(keys).collect()] == [("a", pol.KEY_CEILING + 1)]
    assert pol.over_ceiling(pol.allowed_keys(spark, pol.DEFAULT)).count() == 0


def test_prefixed_ids(spark):
    rows = spark.createDataFrame([(" a b ",), (None,), ("",)], "v string")
    want = ["chunk-" + hashlib.md5(v.encode()).hexdigest() for v in ("a b", "")]
    assert [r["x"] for r in rows.select(text.prefixed_md5("chunk-", F.col("v")).alias("x")).collect()] == [want[0], None, want[1]]


def test_snapshots_are_checked(spark):
    rows = [("ok", {"subject": ["a"]}), ("unknown", {"subject": ["a"], "nope": ["b"]}), ("empty", {"subject": []}), ("none", {})]
    found = {r["he_id"]: r["problem"] for r in store.check_snapshot(spark.createDataFrame(rows, "he_id string, slots map<string,array<string>>")).collect()}
    assert found == {"unknown": "UNKNOWN_SLOT", "empty": "EMPTY_SLOT", "none": "NO_SLOTS"}


def test_reports_and_measurements(spark, tmp_path):
    path = str(tmp_path / "runs")
    for day in ("2024-01-01", "2024-01-03", "2024-01-02"):
        store.write_report(spark.createDataFrame([(day, 5)], "day string, n int"), path)
    (tmp_path / "runs" / "broken.json").write_text('{"day": \n')
    found = store.read_measurements(spark, path, "day string, n int")
    assert [(r["day"], r["n"]) for r in found.collect()] == [("2024-01-03", 5), ("2024-01-02", 5), ("2024-01-01", 5)]
