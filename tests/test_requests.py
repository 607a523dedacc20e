"""Request states: by hand, as a table against a plain loop, and as a stream against the table."""

import datetime as dt
import random

import pytest

from veilgraph.streaming import requests


def _rows(n, seed=3):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    actions = ["create"] * 4 + ["approve", "approve", "reject", "cancel", "grant", "odd", None]
    return [(i, start + dt.timedelta(minutes=3 * i), rng.choice(actions), f"u{rng.randrange(3)}", "s", f"he-{rng.randrange(3)}") for i in range(n)]


COLUMNS = "event_id long, ts timestamp, action string, act string, space string, he_id string"


def _loop(rows):
    state, out = {}, {}
    for event_id, ts, action, *key in sorted(rows, key=lambda r: (r[1], r[0])):
        at = int(ts.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
        pending, expires = state.get(tuple(key), (None, requests._NEVER))
        pending, expires, outcome = requests.step(pending, expires, action, at, event_id)
        state[tuple(key)] = pending, expires
        out[event_id] = outcome, pending
    return out


def test_by_hand():
    minute, never = 60_000_000, requests._NEVER
    pending, expires, log = None, never, []
    for action, at in [("approve", 0), ("create", 1), ("create", 2), ("grant", 3), ("approve", 4), ("approve", 62), ("approve", 63), ("create", 64), ("create", 122), ("cancel", 123), ("create", 124), ("reject", 125), ("x", 126)]:
        pending, expires, outcome = requests.step(pending, expires, action, at * minute, at)
        log.append(outcome)
    assert log == ["NOT_PENDING", "OK", "PENDING_EXISTS", "OK", "GRANT_ACTIVE", "GRANT_ACTIVE", "OK", "GRANT_ACTIVE", "GRANT_ACTIVE", "NOT_PENDING", "OK", "OK", "UNKNOWN"]


def test_table_and_stream_agree(spark, tmp_path):
    rows = _rows(200)
    table = spark.createDataFrame(rows, COLUMNS)
    want = _loop(rows)
    found = {r["event_id"]: (r["outcome"], r["pending"]) for r in requests.outcomes(table).collect()}
    assert found == want and {"OK", "PENDING_EXISTS", "GRANT_ACTIVE", "NOT_PENDING", "UNKNOWN"} == {x for x, _ in want.values()}
    src, name = str(tmp_path / "src"), "spark.sql.streaming.stateStore.providerClass"
    for low in range(0, 200, 50):  # files in order of time
        table.where(f"event_id >= {low} and event_id < {low + 50}").coalesce(1).write.mode("append").parquet(src)
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = requests.stream_outcomes(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(src))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(240)
    finally:
        spark.conf.set(name, before)
    out = spark.read.parquet(str(tmp_path / "out"))
    columns = ("event_id", "outcome", "pending", "expires_at")
    assert sorted(map(tuple, out.select(*columns).collect()), key=repr) == sorted(map(tuple, requests.outcomes(table).select(*columns).collect()), key=repr)


def test_odd_rows(spark):
    rows = [(1, None, "create", "u", "s", "h"), (2, dt.datetime(2024, 1, 1), "create", None, "s", None), (3, dt.datetime(2024, 1, 1), "create", None, "s", None), (4, dt.datetime(2024, 1, 1), None, "u", "s", "h")]
    frame = spark.createDataFrame(rows, COLUMNS)
    assert {r["event_id"]: r["outcome"] for r in requests.outcomes(frame).collect()} == {1: "LATE", 2: "OK", 3: "PENDING_EXISTS", 4: "UNKNOWN"}
    assert requests.outcomes(frame.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 5])
def test_orders(spark, limit):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("r1", "g", "s", "pending", day(3), "u"), ("r2", "g", "s", "pending", day(1), "u"), ("r3", "g", "t", "pending", day(1), "u"), ("r4", "g", "s", "approved", day(1), "u"), ("r5", "g", "s", "pending", day(1), "w")]
    frame = spark.createDataFrame(rows, "request_id string, owner_group string, space string, state string, created timestamp, act string")
    assert [r["request_id"] for r in requests.queue(frame, "g", "s", limit).collect()] == ["r2", "r5", "r1"][:limit]
    assert [r["request_id"] for r in requests.mine(frame, "u", limit).collect()] == ["r1", "r4", "r3", "r2"][:limit]
