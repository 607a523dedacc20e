"""Completions of a language model over a table: one metered call a row, answers and usage in one pass.

A provider is a picklable object with a name, whether it is local, and complete(prompts) -> replies.  Spaces that
hold real data may only use local providers, which is checked before any row is read.  Replies are checked
one by one: a provider that returns another number of replies, or one without text or counts, gives rows with an error, never
somebody else's answer.  Nothing is asked twice within a pass; a task that is run again asks again, and the
rows written are those of the attempt that was committed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prompts of one call.
CALL = 16

USAGE = "model string, prompt_tokens long, completion_tokens long, micros long"
ERRORS = ("EMPTY_PROMPT", "PROVIDER", "REPLY_COUNT", "REPLY_SHAPE")


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int
    completion_tokens: int


class Provider(Protocol):
    name: str
    local: bool

    def complete(self, prompts: list[str]) -> list[Reply]: ...


class ForeignProvider(PermissionError):
    """A provider outside for a space of real data."""


class EchoProvider:
    """Offline replies for tests: the words of a prompt backwards; counts are words."""

    name, local = "echo", True

    def complete(self, prompts: list[str]) -> list[Reply]:
        return [Reply(" ".join(p.split()[::-1]), len(p.split()), len(p.split())) for p in prompts]


def _asked(provider: Provider, prompts: list[str]) -> tuple[list[Reply | None], str | None]:
    try:
        replies = provider.complete(prompts)
    except Exception:
        return [None] * len(prompts), "PROVIDER"
    if not isinstance(replies, list) or len(replies) != len(prompts):
        return [None] * len(prompts), "REPLY_COUNT"
    count = lambda n: isinstance(n, int) and not isinstance(n, bool) and n >= 0
    fine = lambda r: isinstance(r, Reply) and isinstance(r.text, str) and count(r.prompt_tokens) and count(r.completion_tokens)
    return [r if fine(r) else None for r in replies], "REPLY_SHAPE"


def complete(rows: DataFrame, key: str, prompt: str, provider: Provider, real: bool) -> DataFrame:
    """(key, reply, error, model, prompt_tokens, completion_tokens, micros): micros is the row's share of its call.

    real says that the rows' space holds real data.  A null or blank prompt is not sent.  Write the result once: answers and
    usage() are both read from it.
    """
    if real and not provider.local:
        raise ForeignProvider(f"{provider.name} is not local, and the space holds real data")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column(1).to_pylist()
            out: list[tuple] = [(None, "EMPTY_PROMPT", 0, 0, 0)] * len(prompts)
            sent = [i for i, p in enumerate(prompts) if p is not None and p.strip()]
            for low in range(0, len(sent), CALL):
                here = sent[low : low + CALL]
                began = time.perf_counter_ns()
                replies, error = _asked(provider, [prompts[i] for i in here])
                share = (time.perf_counter_ns() - began) // 1000 // len(here)
                for i, r in zip(here, replies, strict=True):
                    out[i] = (r.text, None, r.prompt_tokens, r.completion_tokens, share) if r is not None else (None, error, 0, 0, share)
            columns = list(zip(*out, strict=True)) or [()] * 5
            arrays = [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array([provider.name] * len(prompts), pa.string()), *[pa.array(c, pa.int64()) for c in columns[2:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "reply", "error", "model", "prompt_tokens", "completion_tokens", "micros"])

    return rows.select(key, F.col(prompt).cast("string")).mapInArrow(run, f"`{key}` {kind}, reply string, error string, {USAGE}")


def usage(done: DataFrame) -> DataFrame:
    """(model, calls, failed, prompt_tokens, completion_tokens) of written completions; prompts that were not sent are no calls."""
    sent = done.where(~F.col("error").eqNullSafe(F.lit("EMPTY_PROMPT")))
    return sent.groupBy("model").agg(F.count("*").alias("calls"), F.count("error").alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
