"""Intermediate tables in the folder that driver and executors share: later plans read them and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veilgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def held(frame: DataFrame, what: str) -> DataFrame:
    """frame, written once as Parquet and read again."""
    path = f"{shared_dir(frame.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, where the session has no smaller bound: Python workers then hold texts by size, not by the 10,000."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(key).strip().lower())
    if not size or not 0 < int(size[1]) << {"k": 10, "m": 20, "g": 30}.get(size[2], 0) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
