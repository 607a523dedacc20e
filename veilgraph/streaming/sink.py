"""The audit log's sink: mutation rows exactly once, committed as versions of a space; observation rows best effort."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.sources.versions import Conflict, commit, latest

#: Commits are tried anew this often when other writers were faster.
ATTEMPTS = 5

log = logging.getLogger(__name__)


def audit_sink(store: str, space: str, name: str, observe: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for audit rows (tier, event, act, at, details).

    The number of a stream's last batch stands in the manifest beside its rows: a batch that is
    replayed finds its number there and changes nothing.  A batch whose mutation rows cannot be written
    fails.  observe gets the observation rows of each batch that was written; what it raises is logged and goes no further.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        for attempt in range(ATTEMPTS):
            base = latest(spark, store, space)
            if base.batches.get(name, -1) >= batch:
                return
            try:
                commit(spark, base, {"audit": rows.where("tier = 'mutation'").withColumn("at", F.col("at").cast("timestamp"))}, {name: batch})
                break
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
        if observe is not None:
            try:
                observe(rows.where("tier = 'observation'"), batch)
            except Exception:
                log.warning("observations of batch %d of %s were not written", batch, name, exc_info=True)

    return write


def run(stream: DataFrame, store: str, space: str, name: str, checkpoint: str, observe: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there and stop."""
    stream.writeStream.foreachBatch(audit_sink(store, space, name, observe)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
