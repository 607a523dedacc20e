"""Break-glass requests as a keyed state machine, over a table or a stream.

A key is (space, act, he_id).  Commands come in order of (ts, event_id):

  create   OK: a request is pending.  GRANT_ACTIVE if a grant still runs, PENDING_EXISTS if one is pending.
  approve  OK: the request is closed and a grant runs for GRANT_MINUTES.  NOT_PENDING, or GRANT_ACTIVE
           if one runs: then the request stays pending.
  reject, cancel   OK: the request is closed.  NOT_PENDING.
  grant    OK: a grant without a request.  GRANT_ACTIVE.

Every command gets one outcome, whatever becomes of it; anything else is UNKNOWN.  A grant runs until, but not at, its
expiry.  The table is sorted by key and time within hash partitions and folded in one pass over Arrow
batches, with the state of one key in memory; the stream holds the same state in Spark's store, with a timer
that forgets a grant once the watermark has passed it.  In a stream a command older than its key's last one is LATE and
changes nothing.  Rows without ts are LATE; null parts of a key are a key of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilgraph.operators.audit import GRANT_MINUTES

KEY = ("space", "act", "he_id")
RUNS = GRANT_MINUTES * 60_000_000
OUTCOME = "space string, act string, he_id string, event_id long, ts timestamp, action string, outcome string, pending long, expires_at timestamp"
_NEVER = -(1 << 62)


def step(pending: int | None, expires: int, action: str | None, ts: int, event_id: int) -> tuple[int | None, int, str]:
    """(pending request, end of the grant that runs, outcome) after a command at ts, in microseconds."""
    runs = ts < expires
    expires = expires if runs else _NEVER
    if action == "create":
        return (pending, expires, "GRANT_ACTIVE") if runs else (pending, expires, "PENDING_EXISTS") if pending is not None else (event_id, expires, "OK")
    if action in ("approve", "reject", "cancel"):
        if pending is None:
            return pending, expires, "NOT_PENDING"
        if action != "approve":
            return None, expires, "OK"
        return (pending, expires, "GRANT_ACTIVE") if runs else (None, ts + RUNS, "OK")
    if action == "grant":
        return (pending, expires, "GRANT_ACTIVE") if runs else (pending, ts + RUNS, "OK")
    return pending, expires, "UNKNOWN"


def _schema(zone: str) -> pa.Schema:
    at = pa.timestamp("us", tz=zone)
    return pa.schema([(k, pa.string()) for k in KEY] + [("event_id", pa.int64()), ("ts", at), ("action", pa.string()), ("outcome", pa.string()), ("pending", pa.int64()), ("expires_at", at)])


def _fold(zone: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pending, expires = object(), None, _NEVER
        for batch in batches:
            columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name != "ts"}
            times = batch.column(batch.schema.get_field_index("ts")).cast(pa.int64()).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for i, ts in enumerate(times):
                own = tuple(columns[k][i] for k in KEY)
                if own != key:
                    key, pending, expires = own, None, _NEVER
                if ts is None:
                    outcome = "LATE"
                else:
                    pending, expires, outcome = step(pending, expires, columns["action"][i], ts, columns["event_id"][i])
                for values, value in zip(out, (outcome, pending, expires if expires != _NEVER else None), strict=True):
                    values.append(value)
            arrays = [pa.array(columns[k], pa.string()) for k in KEY] + [pa.array(columns["event_id"], pa.int64()), pa.array(times, pa.int64()).cast(pa.timestamp("us", tz=zone)), pa.array(columns["action"], pa.string())]
            arrays += [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()).cast(pa.timestamp("us", tz=zone))]
            yield pa.RecordBatch.from_arrays(arrays, schema=_schema(zone))

    return run


def _commands(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(k).cast("string").alias(k) for k in KEY], F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("action").cast("string").alias("action"))


def outcomes(commands: DataFrame) -> DataFrame:
    """Every command of a table (space, act, he_id, event_id, ts, action) with its outcome and the state after it."""
    ordered = _commands(commands).repartition(*KEY).sortWithinPartitions(*KEY, F.col("ts").asc_nulls_last(), "event_id")
    return ordered.mapInArrow(_fold(commands.sparkSession.conf.get("spark.sql.session.timeZone")), OUTCOME)


class _Requests(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "pending long, expires long, last_ts long, last_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # one trigger's commands of one key
        had = self.state.get() if self.state.exists() else (None, _NEVER, None, None)
        (pending, expires, last_ts, last_id), before = had, had[1]
        out = []
        for row in frame.itertuples(index=False):
            ts = None if pd.isna(row.ts) else pd.Timestamp(row.ts).value // 1000
            if ts is None or (last_ts is not None and (ts, row.event_id) < (last_ts, last_id)):
                outcome = "LATE"
            else:
                pending, expires, outcome = step(pending, expires, row.action, ts, row.event_id)
                last_ts, last_id = ts, row.event_id
            out.append((*key, row.event_id, row.ts, row.action, outcome, pending, pd.Timestamp(expires, unit="us") if expires != _NEVER else pd.NaT))
        self.state.update((pending, expires, last_ts, last_id))
        if expires != before:
            if before != _NEVER and before // 1000 in list(self.handle.listTimers()):
                self.handle.deleteTimer(before // 1000)
            self.handle.registerTimer(expires // 1000)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])
        frame["pending"] = frame["pending"].astype("Int64")
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending, expires, _, _ = self.state.get()
        if pending is None:
            self.state.clear()  # nothing can be late any more: the watermark is past it
        return iter(())

    def close(self) -> None:
        pass


def stream_outcomes(commands: DataFrame, late: str = "10 minutes") -> DataFrame:
    """outcomes() of a stream; spark.sql.streaming.stateStore.providerClass must name the RocksDB provider."""
    keyed = _commands(commands).withWatermark("ts", late).groupBy(*KEY)
    return keyed.transformWithStateInPandas(_Requests(), OUTCOME, "Append", "EventTime")


def queue(requests: DataFrame, group: str, space: str, limit: int) -> DataFrame:
    """Pending requests that a group of owners decides on, the oldest first; requests(request_id, owner_group, space, state, created)."""
    own = requests.where((F.col("owner_group") == group) & (F.col("space") == space) & (F.col("state") == "pending"))
    return own.orderBy("created", "request_id").limit(limit)


def mine(requests: DataFrame, act: str, limit: int) -> DataFrame:
    """A person's requests, the newest first."""
    return requests.where(F.col("act") == act).orderBy(F.desc("created"), F.desc("request_id")).limit(limit)
