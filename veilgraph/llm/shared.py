"""Shared folder, table access and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where it is unset in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veilgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, where the session has no smaller bound: a task and its Python worker hold a few of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(size: str) -> int:
    """Bytes of a Spark size such as 64m or 67108864b."""
    found = re.fullmatch(r"(-?\d+)([bkmg]?)b?", size.strip().lower())
    return int(found[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 0


def work_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: later plans read the rows from there and survive lost executors."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, what: str) -> DataFrame:
    """Write as Parquet into the shared folder and read again (smaller than a checkpoint for wide rows)."""
    path = work_path(frame.sparkSession, what)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
