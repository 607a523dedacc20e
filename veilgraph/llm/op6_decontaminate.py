"""Benchmark decontamination over a distributed positional inverted index of the training text.

Test items are taken in blocks of bounded size.  For a block: count its terms over the whole
corpus; pick the two rarest terms of every window; store the postings (term, document, positions)
of the picked terms; shift both lists by the term's offset in the item and intersect them per
document, which leaves alignments of an item to a document; check each alignment word by word.
Items shorter than WINDOW words count as one window of their own length.

Rules for odd input: a null text or one without words has no words and no hits; a benchmark row
with null item_id or no words is no item; rows of one doc_id are kept apart by a hash of their text;
equal item_ids count once; other columns are ignored; an empty benchmark leaves every row clean; an
empty table gives no rows; a very long text is indexed and checked whole, in memory of its own size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.shared import cut, small_batches, table, written
from veilgraph.llm.textbatch import ALNUM_WORDS, LOWER, Words, lists, raw, slices, strings, words_of

WINDOW = 10
BLOCK_CHARS = 4_000_000
#: Windows planned at once in the driver.
PLANNED = 1 << 18

_COUNTS = "term long, n long"
_POSTING = "term long, doc_id long, tk long, positions array<int>"
_VERDICT = "doc_id long, tk long, n_words long, n_hit long, items array<string>, spans array<int>"


def _members(sorted_terms: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Function from word hashes to (positions of known words, their index in sorted_terms)."""
    lead = np.zeros(1 << 16, dtype=bool)
    lead[(sorted_terms >> np.uint64(48)).astype(np.int64)] = True

    def find(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(lead[(values >> np.uint64(48)).astype(np.int64)])
        index = np.searchsorted(sorted_terms, values[at])
        index[index == len(sorted_terms)] = 0
        good = sorted_terms[index] == values[at]
        return at[good], index[good]

    return find


def _count(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = _members(terms), np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch):
                total += np.bincount(find(words_of(LOWER[data], offsets, ALNUM_WORDS).hash)[1], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(total[some])], names=["term", "n"])

    return run


def _post(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _members(terms)
        for batch in batches:
            for rows, data, offsets in slices(batch):
                words = words_of(LOWER[data], offsets, ALNUM_WORDS)
                at, index = find(words.hash)
                if not len(at):
                    continue
                row = np.searchsorted(words.first, at, side="right") - 1
                order = np.lexsort((at, index, row))
                at, index, row = at[order], index[order], row[order]
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (index[1:] != index[:-1]))))
                owner = pa.array(row[new])
                where = lists((at - words.first[row]).astype(np.int32), np.concatenate((new, [len(at)])), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(terms[index[new]].view(np.int64)), rows.column(0).take(owner), rows.column(1).take(owner), where], names=["term", "doc_id", "tk", "positions"])

    return run


def _texts(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession)
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def hash_terms(texts: list[str]) -> Words:
    """Word hashes of a few short texts, as the index uses them."""
    data, offsets = raw(strings(pa.array(texts, pa.large_string())))
    return words_of(LOWER[data], offsets, ALNUM_WORDS)


def postings(documents: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, doc_id, tk, positions) of the given term hashes (bounded by the caller) over all documents."""
    return _texts(documents).mapInArrow(_post(np.unique(terms)), _POSTING)


def term_counts(documents: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n): occurrences of the given term hashes over all documents."""
    return _texts(documents).select("text").mapInArrow(_count(np.unique(terms)), _COUNTS).groupBy("term").agg(F.sum("n").alias("n"))


def _rarest(words: Words, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rarest and second rarest term of each window of the items (ties by hash); number counts each word in the corpus.

    A window with a word that no document has cannot occur and is left out; one with a single
    term counts it twice.
    """
    place = np.lexsort((words.hash, number))
    ordered = words.hash[place]
    rank = np.zeros(len(place), dtype=np.int64)
    rank[place] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))) if len(place) else 0
    rank[number == 0] = -1
    sizes = np.minimum(WINDOW, np.diff(words.first))
    ones, twos = [], []
    for size in np.unique(sizes[sizes > 0]).tolist():
        low, high = words.first[:-1][sizes == size], words.first[1:][sizes == size]
        count = high - low - size + 1
        starts = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        for at in range(0, len(starts), PLANNED):
            begin = starts[at : at + PLANNED]
            window = rank[begin[:, None] + np.arange(size)]
            can = window.min(axis=1) >= 0
            begin, window = begin[can], window[can]
            one = window.argmin(axis=1)
            others = np.where(window == window.min(axis=1, keepdims=True), np.iinfo(np.int64).max, window)
            two = np.where(others.min(axis=1) == np.iinfo(np.int64).max, one, others.argmin(axis=1))
            ones.append(begin + one)
            twos.append(begin + two)
    empty = [np.zeros(0, dtype=np.int64)]
    return np.unique(np.concatenate(ones or empty)), np.unique(np.concatenate(twos or empty))


def _alignments(texts: DataFrame, ids: list[str], words: Words) -> DataFrame | None:
    """(doc_id, tk, item, words, diag): document positions at which an item may start, for one block of items."""
    spark = texts.sparkSession
    have = np.unique(words.hash)
    if not len(have):
        return None
    counted = {int(r["term"]) & (1 << 64) - 1: r["n"] for r in texts.select("text").mapInArrow(_count(have), _COUNTS).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most the block's terms
    number = np.array([counted.get(int(h), 0) for h in words.hash], dtype=np.int64)
    firsts, seconds = _rarest(words, number)
    if not len(firsts):
        return None

    def picked(which: np.ndarray) -> DataFrame:
        item = np.searchsorted(words.first, which, side="right") - 1
        rows = pd.DataFrame({"term": words.hash[which].view(np.int64), "item_no": item.astype(np.int32), "offset": (which - words.first[item]).astype(np.int32)})
        return F.broadcast(spark.createDataFrame(rows, "term long, item_no int, offset int"))  # bounded by the block

    used = np.unique(words.hash[np.concatenate((firsts, seconds))])
    index = written(texts.mapInArrow(_post(used), _POSTING), "postings")

    def shifted(which: np.ndarray) -> DataFrame:
        hit = index.join(picked(which), "term").select("doc_id", "tk", "item_no", "offset", F.explode("positions").alias("pos"))
        return hit.select("doc_id", "tk", "item_no", (F.col("pos") - F.col("offset")).alias("diag")).distinct()

    two = shifted(seconds).toDF("d", "k", "i", "g")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("k")) & (F.col("item_no") == F.col("i")) & (F.col("diag") == F.col("g"))
    both = shifted(firsts).join(two, same).select("doc_id", "tk", "item_no", "diag")
    names = spark.createDataFrame([(i, ids[i], [int(h) for h in words.hash[words.first[i] : words.first[i + 1]].view(np.int64)]) for i in range(words.rows)], "item_no int, item string, words array<long>")
    # written before the next block: one block's terms and items are broadcast at a time
    return written(both.join(F.broadcast(names), "item_no").select("doc_id", "tk", "item", "words", "diag"), "alignments")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in slices(batch):
            found = rows.column(rows.schema.get_field_index("found")).to_pylist()
            words = words_of(LOWER[data], offsets, ALNUM_WORDS, hashed=any(found))
            counts, hits, items, spans = np.diff(words.first), [], [], []
            for i in range(len(rows)):
                n, mine = int(counts[i]), set()
                hit = np.zeros(n, dtype=bool)
                here = words.hash[words.first[i] : words.first[i + 1]] if found[i] else None
                for x in found[i] or ():
                    item = np.array(x["words"], dtype=np.int64).view(np.uint64)
                    size = min(WINDOW, len(item))
                    low, high = max(0, x["diag"]), min(n, x["diag"] + len(item))
                    if high - low < size:
                        continue
                    same = here[low:high] == item[low - x["diag"] : high - x["diag"]]
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
                    for s, e in zip(edges[::2], edges[1::2], strict=True):
                        if e - s >= size:
                            hit[low + s : low + e] = True
                            mine.add(x["item"])
                hits.append(int(hit.sum()))
                items.append(sorted(mine))
                spans.append(np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))], names=["doc_id", "tk", "n_words", "n_hit", "items", "spans"])


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tk, n_words, n_hit, items, spans): hit words, item ids with an occurring window, and start and end words of hit runs."""
    texts = _texts(documents)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.char_length("text") + 32)).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    named = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(blocks, 1))))
    parts = []
    for block in range(blocks):
        rows = named.where(F.col("block") == block).select("item", "text").distinct().orderBy("item", "text").collect()  # about BLOCK_CHARS characters
        part = _alignments(texts, [r["item"] for r in rows], hash_terms([r["text"] for r in rows]))
        if part is not None:
            parts.append(part)
    if not parts:
        found = documents.sparkSession.createDataFrame([], "doc_id long, tk long, found array<struct<item string, words array<long>, diag int>>")
    else:
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        found = every.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("item", "words", "diag")).alias("found"))
    keyed = found.withColumnRenamed("doc_id", "of_doc").withColumnRenamed("tk", "of_tk")
    joined = texts.join(keyed, texts["doc_id"].eqNullSafe(keyed["of_doc"]) & (texts["tk"] == keyed["of_tk"]), "left")
    return joined.select("doc_id", "tk", "text", "found").mapInArrow(_verify, _VERDICT)


def proximity_matches(documents: DataFrame, query: str, slop: int) -> DataFrame:
    """(doc_id, position): places of the query's rarest term with every other term within slop words."""
    terms = np.unique(hash_terms([query]).hash)
    counted = sorted((r["n"], r["term"]) for r in term_counts(documents, terms).collect())
    if len(counted) < len(terms) or not len(terms):
        return documents.sparkSession.createDataFrame([], "doc_id long, position int")
    flat = cut(postings(documents, terms).select("term", "doc_id", "tk", F.explode("positions").alias("position")))
    out = flat.where(F.col("term") == counted[0][1]).select("doc_id", "tk", "position")
    for _, term in counted[1:]:
        other = flat.where(F.col("term") == term).select(F.col("doc_id").alias("d"), F.col("tk").alias("k"), F.col("position").alias("p"))
        out = out.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("k")) & (F.abs(F.col("position") - F.col("p")) <= slop), "left_semi")
    return out.select("doc_id", "position")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
