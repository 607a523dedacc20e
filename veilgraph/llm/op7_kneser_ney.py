"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams of trusted text.

Trusted documents are labelled good and not toxic.  One in HELD of them, by a hash of doc_id, is held
out; the others train the model.  Lower orders use continuation counts, each order has its three
discounts; probabilities come from joins of hash-partitioned count tables, once per distinct n-gram of
the whole corpus.  Documents are scored by joining their (document, n-gram, count) rows with that
table on the n-gram.  The HOT most frequent n-grams are looked up in the map that makes those rows
instead, so what is shuffled is the rare rest, and no n-gram of the join holds more than one part in
HOT of all text.  Sums are whole micro-nats, so they do not depend on order.

Two figures judge a document against quantiles of the held-out trusted documents of its language: its
cross-entropy (perplexity) within LOW and HIGH, widened by MARGIN_ROOT over the root of its length, and
its rate of surprising bytes (more than SURPRISE nats), at most the RARE_HIGH quantile; a mean hides a
few foreign words in a good text, the rate does not.

Rules for odd input: a null or empty text has entropy zero and is rejected; a null language is a
language of its own; languages with fewer than MIN_TRUSTED held-out documents use the bounds of all;
with fewer than MIN_TRUSTED held-out documents in all, everything with text is kept; rows that repeat
each get a row; a null doc_id is never trusted; a label repeated with different values trusts if any
row does; an empty table gives no rows; a very long text is scored whole, in one piece; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.shared import small_batches, table, written
from veilgraph.llm.textbatch import lists, slices

ORDER = 5
#: n-grams looked up in the map (1 MB of keys, 1 MB of values, whatever the corpus); the rest is joined.
HOT = 1 << 17
#: Trusted ids and language bounds are broadcast up to this many rows, joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
HELD = 5
LOW, HIGH, RARE_HIGH = 0.002, 0.995, 0.97
#: Micro-nats a byte, over the root of the text's bytes.
MARGIN_ROOT = 3_000_000
SURPRISE = 7
#: Added to a text's bytes in its rate, so that one odd byte does not judge a short text.
RATE_BYTES = 256
MIN_TRUSTED = 30
MICRO = 1_000_000
SLICE = 256 << 10
MERGED = 1 << 18

_PARTS = "rid long, doc_id long, tk long, lang string, trusted boolean, held boolean, n_bytes long, hot long, rare long, g array<long>, k array<int>"


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER bytes up to each byte, packed big-endian; before a text's start lie zero bytes."""
    out = data.astype(np.int64)
    begins, sizes = offsets[:-1], np.diff(offsets)
    for k in range(1, ORDER):
        before = np.zeros(len(data), dtype=np.int64)
        before[k:] = data[:-k] if k < len(data) else 0
        for j in range(k):
            before[begins[sizes > j] + j] = 0
        out |= before << (8 * k)
    return out


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    sums = []
    for column in (1, 2):
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, at, np.concatenate([x[column] for x in held]))
        sums.append(total)
    return (keys, *sums)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n, c): n-grams with their counts in all texts and in those the model is fitted on, combined before the shuffle."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["g", "n", "c"])

    for batch in batches:
        for rows, data, offsets in slices(batch, limit=SLICE):
            grams = _grams(data, offsets)
            fit = np.repeat(np.asarray(rows.column(1)).astype(bool), np.diff(offsets))
            every, n = np.unique(grams, return_counts=True)
            mine, c = np.unique(grams[fit], return_counts=True)
            count = np.zeros(len(every), dtype=np.int64)
            count[np.searchsorted(every, mine)] = c
            held.append((every, n, count))
            size += len(every)
            if size > 2 * MERGED:
                held = [_merged(held)]
                if (size := len(held[0][0])) > MERGED:
                    yield emit()
                    held, size = [], 0
    if held:
        held = [_merged(held)]
        yield emit()


def _score(keys: np.ndarray, values: np.ndarray):
    """Per row of documents: the sum over its hot n-grams, and its other n-grams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, data, offsets in slices(batch, limit=SLICE):
                grams = _grams(data, offsets)
                at = np.searchsorted(keys, grams)
                at[at == len(keys)] = 0
                known = keys[at] == grams if len(keys) else np.zeros(len(grams), dtype=bool)
                part = np.where(known, values[at], 0) if len(keys) else np.zeros(len(grams), dtype=np.int64)
                total, rare = (np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (part, part < -SURPRISE * MICRO))
                place = np.flatnonzero(~known)
                row, g = np.searchsorted(offsets, place, side="right") - 1, grams[place]
                order = np.lexsort((g, row))
                row, g = row[order], g[order]
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])))) if len(g) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.concatenate((new, [len(g)]))) if len(g) else new
                cuts = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(rows)))))
                fixed = [rows.column(c) for c in range(5)]
                sums = [pa.array(x) for x in (np.diff(offsets), total[offsets[1:]] - total[offsets[:-1]], rare[offsets[1:]] - rare[offsets[:-1]])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid + np.arange(len(rows))), *fixed, *sums, lists(g[new], cuts, pa.int64()), lists(times, cuts, pa.int32())],
                    names=["rid", "doc_id", "tk", "lang", "trusted", "held", "n_bytes", "hot", "rare", "g", "k"],
                )
                rid += len(rows)

    return run


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts for counts of one, two, and three or more."""
    n = {int(r["c"]): r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}  # four rows at most
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(found)]


def _log_probabilities(grams: DataFrame) -> DataFrame:
    """(g, v): natural log probability in micro-nats of each distinct n-gram, from the counts c of trusted text."""

    def last(n: int) -> Column:
        return F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1))

    counts = {ORDER: grams.where("c > 0").select("g", "c")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = written(counts[n + 1].groupBy(last(n).alias("g")).agg(F.count("*").alias("c")), f"counts{n}")
    asked = {ORDER: grams.select("g")}
    for n in range(ORDER - 1, 0, -1):
        asked[n] = asked[n + 1].select(last(n).alias("g")).distinct()
    lower = None
    for n in range(1, ORDER + 1):
        d = _discounts(counts[n])
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = counts[n].groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("c").alias("total"), F.sum(less).alias("spare"))
        seen = asked[n].join(counts[n], "g", "left").withColumn("h", F.shiftright("g", 8)).join(context, "h", "left")
        if lower is None:
            based = seen.withColumn("below", F.lit(1 / 256))
        else:
            based = seen.withColumn("s", last(n - 1)).join(lower, "s")
        own = F.coalesce((F.col("c") - less) / F.col("total"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise(own + F.col("spare") / F.col("total") * F.col("below"))
        lower = written(based.select(F.col("g").alias("s"), p.alias("below")), f"order{n}")
    return lower.select(F.col("s").alias("g"), F.round(F.log("below") * MICRO).cast("long").alias("v"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0")
    return good.select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()


def _source(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, tk, lang, trusted, held, text): tk, a hash of the text, tells rows of one doc_id apart."""
    ids = trusted_ids(labels)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    text = F.col("text").cast("string")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), F.col("lang").cast("string").alias("lang"), F.coalesce(text, F.lit("")).alias("text")
    )
    trusted = F.col("trusted_id").isNotNull()
    held = trusted & (F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0)
    return rows.join(ids, F.col("doc_id") == F.col("trusted_id"), "left").select("doc_id", "tk", "lang", trusted.alias("trusted"), held.alias("held"), "text")


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, tk, lang, trusted, held, n_bytes, entropy, rare_rate): micro-nats a byte; surprising bytes in a million."""
    small_batches(documents.sparkSession)
    source = _source(documents, labels)
    fit = (F.col("trusted") & ~F.col("held")).alias("fit")
    counted = source.select("text", fit).mapInArrow(_count, "g long, n long, c long")
    grams = written(counted.groupBy("g").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "grams")
    model = written(_log_probabilities(grams), "model")
    most = grams.orderBy(F.desc("n"), "g").limit(HOT).select("g")
    hot = model.join(F.broadcast(most), "g").toArrow().combine_chunks()  # HOT rows at most
    keys, values = hot["g"].to_numpy(), hot["v"].to_numpy()
    order = np.argsort(keys)
    parts = written(source.mapInArrow(_score(keys[order], values[order]), _PARTS), "scored-parts")
    cold = parts.select("rid", F.explode(F.arrays_zip("g", "k")).alias("x")).select("rid", F.col("x.g").alias("g"), F.col("x.k").alias("k"))
    surprising = F.when(F.col("v") < -SURPRISE * MICRO, F.col("k")).otherwise(0)
    sums = cold.join(model, "g").groupBy("rid").agg(F.sum(F.col("v") * F.col("k")).alias("cold"), F.sum(surprising).alias("cold_rare"))
    whole = parts.drop("g", "k").join(sums, "rid", "left")
    total = F.col("hot") + F.coalesce("cold", F.lit(0))
    rare = F.col("rare") + F.coalesce("cold_rare", F.lit(0))
    entropy = F.when(F.col("n_bytes") > 0, F.floor(-total / F.col("n_bytes"))).otherwise(0).cast("long")
    rate = F.floor(rare * 1_000_000 / (F.col("n_bytes") + RATE_BYTES)).cast("long")
    return whole.select("doc_id", "tk", "lang", "trusted", "held", "n_bytes", entropy.alias("entropy"), rate.alias("rare_rate"))


def _quantiles(own: DataFrame, value: str, width: int, least: dict[str, float]) -> DataFrame:
    """Per language, the bin of `width` that each quantile falls in: by counts of bins, which the range of values bounds."""
    bins = own.groupBy("lang", F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    listed = bins.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))

    def reach(q: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))

        def step(a: Column, x: Column) -> Column:
            seen = a["seen"] + x["n"]
            return F.struct(seen.alias("seen"), F.coalesce(a["at"], F.when(seen >= q * F.col("total"), x["bin"])).alias("at"))

        return F.aggregate("bins", start, step)["at"]

    return listed.select("lang", "total", *((reach(q) * width).alias(name) for name, q in least.items()))


def bounds(scored: DataFrame) -> DataFrame:
    """(lang, low, high, rare_high, total): quantiles of held-out trusted documents of each language; lang '*' is all."""
    langs = F.array(F.coalesce("lang", F.lit("?")), F.lit("*"))
    own = scored.where("held and n_bytes > 0").select(F.explode(langs).alias("lang"), "entropy", "rare_rate")
    around = _quantiles(own, "entropy", 1_000, {"low": LOW, "high": HIGH})
    above = _quantiles(own, "rare_rate", 10, {"rare_high": RARE_HIGH})
    return around.join(above.drop("total"), "lang").select("lang", "low", (F.col("high") + 1_000).alias("high"), (F.col("rare_high") + 10).alias("rare_high"), "total")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """score() with low, high, rare_high and kept."""
    scored = written(score(documents, labels), "scored")
    limits = written(bounds(scored).where(F.col("total") >= MIN_TRUSTED), "language-bounds")
    every = limits.where("lang = '*'").first()
    free = {"low": -(1 << 62), "high": 1 << 61, "rare_high": 1 << 61}
    own = limits.where("lang <> '*'").select(F.col("lang").alias("_lang"), *(F.col(c).alias(f"_{c}") for c in free))
    own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    joined = scored.join(own, F.coalesce("lang", F.lit("?")) == F.col("_lang"), "left")
    filled = joined.select(*scored.columns, *(F.coalesce(f"_{c}", F.lit(every[c] if every else x)).cast("long").alias(c) for c, x in free.items()))
    slack = F.lit(MARGIN_ROOT) / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    likely = (F.col("entropy") >= F.col("low") - slack) & (F.col("entropy") <= F.col("high") + slack)
    return filled.withColumn("kept", (F.col("n_bytes") > 0) & likely & (F.col("rare_rate") <= F.col("rare_high")))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
    perplexity = F.round(F.exp(F.col("entropy") / MICRO), 6).alias("perplexity")
    return found.select("doc_id", "lang", "n_bytes", "entropy", perplexity, "rare_rate", "low", "high", "rare_high", "kept")
