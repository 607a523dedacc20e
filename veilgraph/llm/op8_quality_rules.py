"""Quality rules with a hashed n-gram log-likelihood ratio; DataFrame functions only.

Counts of hashed words and word pairs are taken over every document (raw corpus) and over fitted
trusted documents (labelled good and not toxic, less one in HELD of them, by a hash of doc_id): two
multinomials over buckets.  The buckets of words grow with the corpus's vocabulary, between the two
bounds WORD_BUCKETS; pairs have PAIR_BUCKETS.  A feature's weight is log p_trusted - log p_raw in whole
micro-units, so sums do not depend on order.  Two length-normalised figures judge a document:

* score, the mean weight of its features;
* low_rate, its words of a weight of LOW_WEIGHT or less in a million words: words that the raw corpus
  holds often and trusted text hardly ever.  A mean hides a few of them in a long text.

A document is kept if it passes the base rules, its score is at least the REJECT_SCORE quantile, and its
low_rate at most the 1 - REJECT_LOW quantile of all held-out trusted documents that pass the base rules.
Quantiles are taken in bins of 1,000 micro-units and of 100 in a million; both bounds are bin edges.

Rules for odd input: a null text has no words; texts without words score zero and fail the base
rules; with fewer than MIN_HELD held-out documents the base rules alone decide; rows that repeat each
get a row; a null doc_id is never trusted; repeated labels of a document count once (it is trusted if
any row says so); an empty table gives no rows; a very long text is judged whole; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.shared import table, written

#: Fewest and most buckets of words (powers of two); between them, one for each WORDS_A_BUCKET distinct words at least.
WORD_BUCKETS = (1 << 16, 1 << 20)
WORDS_A_BUCKET = 1
PAIR_BUCKETS = 1 << 16
#: Bound on the labelled rows the target is fitted on; beyond it, rows are drawn by a hash of doc_id.
MAX_TRUSTED = 200_000
#: Held-out ids are broadcast up to this many, joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
HELD = 5
MIN_HELD = 30
REJECT_SCORE, REJECT_LOW = 0.005, 0.02
MICRO = 1_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
LOW_WEIGHT = -2 * MICRO
#: Added to a text's words in its rate, so that one word does not judge a short text.
RATE_WORDS = 20

_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _features(words: Column, buckets: int) -> Column:
    """Buckets of all words, then of all pairs of neighbours."""

    def of(hashes: Column) -> Column:
        single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
        firsts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0)))
        pairs = F.transform(firsts, lambda h, i: (F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(PAIR_BUCKETS)) + buckets).cast("int"))
        return F.concat(single, pairs)

    return let(_hashes(words), of)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur more than once."""

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(ordered, places), spread)

    def windows(hashes: Column) -> Column:
        firsts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0)))
        return F.transform(firsts, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    grams = let(_hashes(words), windows)
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def _texts(documents: DataFrame) -> DataFrame:
    """(doc_id, tk, text): tk, a hash of the text, tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), F.coalesce(text, F.lit("")).alias("text"))


def base_counts(texts: DataFrame) -> DataFrame:
    """doc_id, tk and COUNTS of every row of _texts()."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return texts.withColumn("words", words_of(F.col("text"))).select(
        "doc_id",
        "tk",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def _trusted(labels: DataFrame) -> DataFrame:
    """(trusted_id, held) of every trusted document."""
    good = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0")
    ids = good.select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    return ids.withColumn("held", F.pmod(F.xxhash64("trusted_id"), F.lit(HELD)) == 0)


def _fitted(trusted: DataFrame) -> DataFrame:
    """trusted_id of the documents the target is fitted on, about MAX_TRUSTED at most."""
    ids = trusted.where("not held").select("trusted_id")
    n = ids.count()
    if n <= MAX_TRUSTED:
        return ids
    return ids.where(F.pmod(F.xxhash64("trusted_id", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * MAX_TRUSTED / n))


def feature_counts(texts: DataFrame, fitted: DataFrame) -> DataFrame:
    """(bucket, raw, target): how often the corpus and its fitted documents fill each bucket, with the most buckets of words."""
    flagged = texts.join(F.broadcast(fitted), texts["doc_id"] == fitted["trusted_id"], "left")  # about MAX_TRUSTED ids
    good = F.col("trusted_id").isNotNull().cast("long").alias("good")
    features = flagged.select(good, F.explode(let(words_of(F.col("text")), lambda w: _features(w, WORD_BUCKETS[1]))).alias("bucket"))
    return written(features.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")), "bucket-counts")


def word_buckets(counts: DataFrame) -> int:
    """Buckets of words for this corpus, from its distinct words as the filled ones of the most buckets tell them."""
    buckets, most = WORD_BUCKETS
    filled = counts.where(F.col("bucket") < most).count()
    distinct = -most * math.log(1 - filled / most) if filled < most else math.inf
    while buckets < most and buckets * WORDS_A_BUCKET < distinct:
        buckets *= 2
    return buckets


def weights(counts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, w): the log ratio, in micro-units, of every bucket that the corpus fills; buckets of words are folded (powers of two), pairs follow them."""
    most = WORD_BUCKETS[1]
    if buckets < most:
        folded = F.when(F.col("bucket") < most, F.col("bucket") % buckets).otherwise(F.col("bucket") - most + buckets).cast("int")
        counts = counts.groupBy(folded.alias("bucket")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = (x or 0 for x in counts.agg(F.sum("raw"), F.sum("target")).first())
    if not target:
        return counts.select("bucket", F.lit(0).alias("w"))
    size = buckets + PAIR_BUCKETS
    shift = math.log(raw + size) - math.log(target + size)
    weight = F.log(F.col("target") + 1.0) - F.log(F.col("raw") + 1.0) + F.lit(shift)
    return counts.select("bucket", F.round(weight * MICRO).cast("int").alias("w"))


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, score (micro-units a feature), low_rate, base_failed and kept, for every row."""
    texts = _texts(documents)
    trusted = _trusted(labels)
    counts = feature_counts(texts, _fitted(trusted))
    buckets = word_buckets(counts)
    weighed = weights(counts, buckets)
    # rows of one doc_id and text add up: their sums, features and words grow alike
    features = F.explode(let(words_of(F.col("text")), lambda w: _features(w, buckets))).alias("bucket")
    is_word = F.col("bucket") < buckets
    sums = (
        texts.select("doc_id", "tk", features)
        .join(F.broadcast(weighed), "bucket")  # at most WORD_BUCKETS[1] + PAIR_BUCKETS rows
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("tk").alias("of_tk"))
        .agg(F.sum("w").alias("w"), F.count("*").alias("features"), F.count_if(is_word).alias("all_words"), F.count_if(is_word & (F.col("w") <= LOW_WEIGHT)).alias("low"))
    )
    base = base_counts(texts)
    joined = base.join(sums, base["doc_id"].eqNullSafe(sums["of_doc"]) & (base["tk"] == sums["of_tk"]), "left")
    score = F.coalesce(F.floor(F.col("w") / F.col("features")), F.lit(0)).cast("long")
    low = F.coalesce(F.col("low") * F.col("n_words") / F.col("all_words"), F.lit(0))
    rate = F.floor(low * 1_000_000 / (F.col("n_words") + RATE_WORDS)).cast("long")
    scored = written(joined.select("doc_id", *COUNTS, score.alias("score"), rate.alias("low_rate"), F.expr(FAILED).alias("base_failed")), "quality-scores")
    least, most = _thresholds(scored, trusted.where("held"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)) & (F.col("low_rate") <= F.lit(most)))


def _thresholds(scored: DataFrame, held: DataFrame) -> tuple[int, int]:
    """Least score and most low_rate, from all held-out trusted rows that pass the base rules."""
    ids = F.broadcast(held) if held.count() <= BROADCAST_IDS else held
    own = scored.where("not base_failed").join(ids, scored["doc_id"] == held["trusted_id"], "left_semi")
    widths = {"score": 1_000, "low_rate": 100}
    figures = F.array(*(F.struct(F.lit(name).alias("of"), F.floor(F.col(name) / width).alias("bin")) for name, width in widths.items()))
    counted = own.select(F.explode(figures).alias("x")).groupBy("x.of", "x.bin").agg(F.count("*").alias("n"))
    bins = sorted(counted.collect())  # the range of both figures bounds the bins
    total = sum(n for of, _, n in bins if of == "score")
    if total < MIN_HELD:
        return -(1 << 62), 1 << 62

    def bin_of(name: str, share: float) -> int:
        seen = 0
        for of, at, n in bins:
            seen += n if of == name else 0
            if seen > share * total:
                return at
        raise AssertionError("a share under one is reached")

    return bin_of("score", REJECT_SCORE) * widths["score"], (bin_of("low_rate", 1 - REJECT_LOW) + 1) * widths["low_rate"]


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_quality_rules that SQL can express."""
    counted = base_counts(_texts(table(spark, sf_dir, "documents")))
    return counted.select("doc_id", *COUNTS, F.expr(FAILED).alias("base_failed"))
